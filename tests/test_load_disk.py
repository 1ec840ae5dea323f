"""A load holds on disk only what a later step reads, and gives the same tables in parts."""

import os
import time

import pytest

from caselog import session
from caselog.operators import loading
from caselog.plans import jobs
from caselog.sinks import snapshots
from caselog.sources import tables, xes
from checks import fixtures

import test_xes_and_quality as source


@pytest.fixture
def log(spark, tmp_path):
    def make(name, *traces):
        folder = tmp_path / name
        folder.mkdir()
        return xes.read_traces(spark, source.write(folder / "log.xes.gz", *traces))

    return make


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark, log, tmp_path, monkeypatch):
    traces, setting = log("one", source.trace("A", source.event("a"), source.event("b"))), spark.conf.get(session._CLEANUP)
    before, inside, store = shuffles(spark), [], jobs.stored
    with session.shuffles_dropped(spark):
        loading.timed_events(traces).write.parquet(str(tmp_path / "t"))
        end = time.time() + 20
        while shuffles(spark) - before and time.time() < end:
            time.sleep(0.2)
    assert not shuffles(spark) - before
    monkeypatch.setattr(jobs, "stored", lambda *a: inside.append(spark.conf.get(session._CLEANUP)) or store(*a))
    jobs.load_log(traces, str(tmp_path / "log"))
    assert inside and set(inside) == {"true"}
    assert spark.conf.get(session._CLEANUP) == setting


def test_traces_are_gone_before_events_are_sent(spark, log, tmp_path, monkeypatch):
    """Of the load's own folder only the events and the cases are left when they go to their buckets."""
    seen, asked, path = [], snapshots.in_buckets, []
    scratch = jobs.scratch_path
    monkeypatch.setattr(jobs, "scratch_path", lambda *a: path.append(scratch(*a)) or path[-1])
    monkeypatch.setattr(snapshots, "in_buckets", lambda *a: seen.append(sorted(os.listdir(path[-1].removeprefix("file:")))) or asked(*a))
    root = str(tmp_path / "log")
    jobs.load_log(log("one", source.trace("A", source.event("e1"), source.event("e2"))), root)
    jobs.load_log(log("two", source.trace("A", source.event("e3"), source.event("e3", "W_y"))), root)
    assert seen == [["cases", "every", "repeated"], ["cases", "first", "repeated"]]
    assert not os.path.exists(path[-1]) and not any(n.startswith("load-") for n in os.listdir(root))


@pytest.mark.parametrize("parts", [1, 4])
def test_loads_in_parts_give_the_same_events(spark, log, tmp_path, monkeypatch, parts):
    """Repeats inside a load and of known ids, unreadable times, a load without events."""
    monkeypatch.setattr(jobs, "PART_ROWS", 1)
    monkeypatch.setattr(jobs, "PART_BUCKETS", 16 // parts)
    root = str(tmp_path / "log")
    many = [source.event(f"e{i}", f"A_{i % 3}") for i in range(60)]
    first = [source.trace("A", *many), source.trace("B", source.event("e5", "W_late"), source.event("x", time="no"), source.event("x", "W_x"))]
    second = [source.trace("C", *[source.event(f"e{i}", "W_again") for i in range(40, 80)], source.event("e70", "W_third"))]
    jobs.load_log(log("one", *first), root)
    result = jobs.load_log(log("two", *second), root)
    assert tuple(result) == (3, 80, 0)
    jobs.load_log(log("none", source.trace("D")), root)
    got = {r.event_id: (r.application_id, r.activity) for r in tables.read_table(spark, root, "events").collect()}
    assert got == {f"e{i}": ("A", f"A_{i % 3}") if i < 60 else ("C", "W_again") for i in range(80)}
    partials = spark.read.schema(jobs.PARTIALS).parquet(f"{root}/partials")
    assert partials.agg({"n": "sum"}).first()[0] == 80
    assert [tuple(r) for r in spark.read.parquet(f"{root}/rejected").select("event_id", "raw_time").collect()] == [("x", "no")]
    assert tables.read_table(spark, root, "events").where("created_at is null").isEmpty()


def test_a_hash_that_two_ids_share(spark, log, monkeypatch):
    """Every id counts as repeated; each keeps its first event."""
    traces = log("one", source.trace("A", source.event("a"), source.event("b"), source.event("a", "W_y")))
    every = loading.timed_events(traces, False, True)
    shared = every.selectExpr("xxhash64(event_id) as _hash").distinct()
    got = loading.first_of_each(every, shared).select("event_id", "activity", "event_pos").collect()
    want = loading.timed_events(traces).select("event_id", "activity", "event_pos").collect()
    assert sorted(got) == sorted(want) == [("a", "A_x", 0), ("b", "A_x", 1)]
    assert [r[0] for r in loading.repeated_ids(every).collect()] == [every.selectExpr("xxhash64('a')").first()[0]]


def test_files_written_in_rounds(spark, sf, tmp_path, monkeypatch):
    """The same traces in as many files, whatever the rounds."""
    monkeypatch.setattr(fixtures, "FILE_CASES", 300)
    flat = lambda t: sorted(map(str, t.drop("source_file", "trace_pos").collect()))
    whole = fixtures.order_traces(spark, sf)
    monkeypatch.setattr(fixtures, "ROUND_FILES", 3)
    parts = fixtures.order_traces(spark, sf)
    assert flat(whole) == flat(parts)
    assert whole.select("source_file").distinct().count() == parts.select("source_file").distinct().count() == 8
