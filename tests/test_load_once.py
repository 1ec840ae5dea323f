"""A load does its costly choices once."""

from caselog.operators import loading
from caselog.plans import jobs
from checks import fixtures


def test_a_load_chooses_first_events_once(spark, sf, tmp_path, monkeypatch):
    """Events and rejected events of a load come from one stored choice."""
    calls, first = [], loading._first_wins
    monkeypatch.setattr(loading, "_first_wins", lambda e: calls.append(first(e)) or calls[-1])
    written = []
    timed = loading.timed_events
    monkeypatch.setattr(loading, "timed_events", lambda *a: written.append(timed(*a)) or written[-1])
    jobs.load_log(fixtures.order_traces(spark, sf), str(tmp_path / "log"))
    assert len(calls) == len(written) == 1
