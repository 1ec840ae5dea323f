"""An audit parses times once, when it stores what the rules read."""

import io
from contextlib import redirect_stdout

import pytest

from caselog.operators import quality

EVENT = "source_file string, trace_pos bigint, event_pos int, document_id string, event_id string, activity string, raw_time string"


@pytest.fixture(scope="module")
def log(spark):
    times = ["2024-01-01T10:00:00Z", " 2024-01-01T09:00:00Z ", "0001-01-02T00:00:00Z", "", "soon", None, "9999-12-31T23:59:59Z"]
    rows = [("f", 1, i, " a ", f"e{i}", "x", t) for i, t in enumerate(times)] + [("g", 1, 0, "b", "e0", " ", times[0])]
    events = spark.createDataFrame(rows, EVENT)
    return events.select(*quality.TRACE, "document_id").distinct(), events


def test_rules_read_stored_times(spark, log, tmp_path):
    quality.audited_traces(log[0]).write.parquet(str(tmp_path / "t"))
    quality.audited_events(log[1]).write.parquet(str(tmp_path / "e"))
    stored = [spark.read.parquet(str(tmp_path / name)) for name in "te"]
    issues = quality.audit(*stored, stored=True)
    with redirect_stdout(io.StringIO()) as plan:
        issues.explain()
    assert "RLIKE" not in plan.getvalue() and "regexp" not in plan.getvalue()
    assert stored[1].where("_time is not null and raw_time is not null").isEmpty()
    rows = lambda df: sorted(df.collect(), key=str)
    assert rows(issues) == rows(quality.audit(*log))


def test_run_finds_every_issue_and_counts_the_quarantine(log, tmp_path):
    done = quality.run(*log, str(tmp_path / "out"))
    found = {(r.rule, r.trace_pos, r.source_file, r.event_pos) for r in done.issues.collect() if r.severity != "info"}
    assert found == {
        ("missing_timestamp", 1, "f", 3), ("invalid_timestamp", 1, "f", 4),
        ("non_monotonic_event_time", 1, "f", 1), ("non_monotonic_event_time", 1, "f", 2),
        ("duplicate_event_id", 1, "g", 0), ("missing_activity", 1, "g", 0)}
    assert done.issues.where("rule = 'invalid_timestamp'").first().detail == "Unparseable timestamp: soon"
    assert done.head.first().quarantined_traces == done.quarantine.count() == 2
