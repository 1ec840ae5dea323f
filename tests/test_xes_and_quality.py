import gzip
import json

import pytest
from pyspark.sql import functions as F

from caselog.operators import loading, quality
from caselog.plans import jobs
from caselog.sinks import snapshots
from caselog.sources import tables, xes
from caselog.streaming import staging

from helpers import at

HEAD = '<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/"><string key="concept:name" value="log"/>'


def attr(key, value, tag="string"):
    return f'<{tag} key="{key}" value="{value}"/>'


def event(event_id=None, activity="A_x", time="2016-01-01T10:00:00.000Z", more=""):
    parts = [attr("EventID", event_id)] if event_id is not None else []
    parts += [attr("concept:name", activity)] if activity is not None else []
    parts += [attr("time:timestamp", time, "date")] if time is not None else []
    return "<event>" + "".join(parts) + more + "</event>"


def trace(name, *events, more=""):
    return "<trace>" + (attr("concept:name", name) if name is not None else "") + more + "".join(events) + "</trace>"


def write(path, *traces):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(HEAD + "".join(traces) + "</log>")
    return str(path)


@pytest.fixture
def log(spark, tmp_path):
    def make(*traces):
        return xes.read_traces(spark, write(tmp_path / "log.xes.gz", *traces))

    return make


def issues_of(traces):
    issues = quality.audit(xes.flatten_traces(traces), xes.flatten_events(traces))
    return {r.rule: r.issue_count for r in quality.rule_report(issues).collect()}, issues


def test_golden_log(spark, log, tmp_path):
    traces = log(
        trace("Application_1", event("Event_1"), event("Event_2", "A_Complete", "2016-01-01T11:00:00.000Z")),
        trace(None, event("Event_1", time="not-a-date")),
    )
    t, e = xes.flatten_traces(traces), xes.flatten_events(traces)
    result = quality.run(t, e, str(tmp_path / "out"))
    counts = {r.rule: r.issue_count for r in result.report.collect()}
    assert result.totals.first().asDict() == {"events": 3, "traces": 2}
    assert {rule: n for rule, n in counts.items() if n} == dict.fromkeys((
        "missing_document_id", "orphan_event", "invalid_timestamp", "duplicate_event_id", *quality.DATASET_RULES), 1)
    head = result.head.first()
    assert (head.traces, head.events, head.quarantined_traces, head.status) == (2, 3, 1, quality.STATUS)
    some = quality.audit(t, e, rules=("orphan_event", "duplicate_event_id"))
    assert sorted(r.rule for r in some.collect()) == ["duplicate_event_id", "orphan_event"]
    q = result.quarantine.collect()
    assert [(r.document_id, r.decision, r.rules) for r in q] == [
        ("<missing>", "quarantine_for_review", "invalid_timestamp;missing_document_id;orphan_event")
    ]
    stored = spark.read.json(str(tmp_path / "out" / "quarantine")).collect()
    assert len(stored) == 1
    assert spark.read.json(str(tmp_path / "out" / "rule_report")).count() == len(quality.CATALOG)


def test_backwards_time_is_measured_against_the_last_valid_time(log):
    counts, _ = issues_of(log(trace(
        "a", event("1", time="2016-01-02"), event("2", time="oops"), event("3", time="2016-01-01"),
        event("4", time="2016-01-03"),
    )))
    assert counts["non_monotonic_event_time"] == 1
    assert counts["invalid_timestamp"] == 1


def test_blank_fields_and_repeats(log):
    counts, issues = issues_of(log(
        trace(" a ", event(" ", " ", "  ")), trace("a"), trace("a", event(None, None, None)), trace("b"),
    ))
    assert counts["duplicate_document"] == 2
    assert counts["missing_event_id"] == counts["missing_activity"] == counts["missing_timestamp"] == 2
    assert counts["invalid_timestamp"] == counts["orphan_event"] == 0
    held = {r.rules for r in quality.quarantine(issues).collect()}
    assert held == {"missing_activity;missing_timestamp", "duplicate_document",
                    "duplicate_document;missing_activity;missing_timestamp"}


def test_examples_are_the_first_twenty_in_source_order(log):
    traces = log(trace("a", *[event(None) for _ in range(30)]), trace("b", *[event(None) for _ in range(5)]))
    report = quality.rule_report(issues_of(traces)[1]).where("rule = 'missing_event_id'").first()
    assert report.issue_count == 35 and len(report.examples) == 20
    assert {x.document_id for x in report.examples} == {"a"}


def test_repeated_event_id_holding_most_rows(log):
    counts, _ = issues_of(log(*[trace(f"c{i}", *[event("same") for _ in range(20)]) for i in range(10)]))
    assert counts["duplicate_event_id"] == 199


def test_repeated_attribute_key(log):
    traces = log(trace("a", event("1", more=attr("EventID", "2"))))
    assert xes.flatten_events(traces, keep="first").first().event_id == "1"
    assert xes.flatten_events(traces, keep="last").first().event_id == "2"
    bags = traces.select(F.explode("events").alias("e"))
    assert bags.select(xes.attribute_map(F.col("e"), "first")["EventID"]).first()[0] == "1"
    assert bags.select(xes.attribute_map(F.col("e"), "last")["EventID"]).first()[0] == "2"


TIMES = [
    ("2016", None), ("", None), ("not-a-date", None), ("2016-13-01", None), ("2016-02-30", None),
    ("2016-01-01T25:00", None), ("2016-0101", None), ("2016-W54-1", None), ("2015-W53-8", None),
    ("2016-01-01", "2016-01-01"), ("20160101", "2016-01-01"), ("2016-01-01T10", "2016-01-01T10:00"),
    ("2016-01-01T10:11", "2016-01-01T10:11"), ("20160101T101112", "2016-01-01T10:11:12"),
    ("2016-01-01 10:11:12.5", "2016-01-01T10:11:12.500000"),
    ("2016-01-01T10:11:12,123456789", "2016-01-01T10:11:12.123456"),
    ("2016-01-01T10:00:00.000Z", "2016-01-01T10:00"), ("2016-01-01T10:00:00+02:00", "2016-01-01T08:00"),
    ("2016-01-01T10:00:00-0130", "2016-01-01T11:30"), ("2016-01-01T10:00+02", "2016-01-01T08:00"),
    ("2016-W01-1", "2016-01-04"), ("2015W537", "2016-01-03"), ("2015-W53", "2015-12-28"),
    ("2016-W01-1T06:30", "2016-01-04T06:30"),
]


def test_parse_time(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(TIMES)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(xes.parse_time(F.col("t"))).collect()]
    assert got == [at(want) if want else None for _, want in TIMES]


def test_loading_rules(log):
    traces = log(
        trace("A", event("e1", time="2016-01-05"), event("", time="2010-01-01"),
              more=attr("ApplicationType", "New credit") + attr("RequestedAmount", "12.345", "float")),
        trace(" A ", event("e1", time="2016-01-06"), event("e2", time="2016-01-07"),
              more=attr("ApplicationType", "Limit raise")),
        trace("A", event("e9", time="nonsense")),
        trace("", event("e3")), trace("B"), trace("C", event("e4", "A_y", "2016-02-01")),
    )
    loaded = loading.load(traces)
    cases = {r.application_id: r for r in loaded.cases.collect()}
    assert set(cases) == {"A", "B", "C"}
    a = cases["A"]
    # attributes of the first trace, times of the last trace that has any
    assert (a.application_type, str(a.requested_amount), a.loan_goal, a.status) == ("New credit", "12.35", "", None)
    assert (a.first_event_time, a.last_event_time, a.event_count) == (at("2016-01-06"), at("2016-01-07"), 2)
    assert (cases["B"].event_count, cases["B"].first_event_time) == (0, None)
    events = {r.event_id: r for r in loaded.events.collect()}
    assert set(events) == {"e1", "e2", "e4"}
    assert events["e1"].event_timestamp == at("2016-01-05") and events["e1"].resource == ""
    assert [r.event_id for r in loaded.rejected.collect()] == ["e9"]
    with pytest.raises(Exception, match="unreadable time of event e9"):
        loading.load(traces, fail_on_bad_time=True).events.collect()


def test_repeated_load_adds_nothing(spark, log, tmp_path):
    root = str(tmp_path / "tables")
    stored = lambda: {r.application_id: r for r in spark.read.parquet(snapshots.current(spark, f"{root}/cases")).collect()}
    kind = lambda name: attr("ApplicationType", name)
    traces = log(trace("A", event("e1"), event("e2", time="2016-01-02"), more=kind("New credit")), trace("B"),
                 trace("A", event("e3", time="?")))
    for _ in range(2):
        assert jobs.load_log(traces, root) == (2, 2, 1)
    before = stored()
    more = log(trace("A", event("e1"), event("e4", time="2016-02-02"), more=kind("Limit raise")), trace("C"),
               trace("B", event("", time="2016-02-02")))
    assert jobs.load_log(more, root) == (3, 3, 0)
    after = stored()
    assert after["A"].application_type == "New credit" and after["A"].last_event_time == at("2016-02-02")
    assert after["B"] == before["B"] and after["A"].created_at == before["A"].created_at < after["A"].updated_at
    rejected, loads = spark.read.parquet(f"{root}/rejected"), spark.read.parquet(f"{root}/loads")
    assert rejected.count() == 2 and rejected.select("load_id").distinct().count() == 2
    assert [r.load_status for r in loads.collect()] == ["SUCCESS"] * 3
    read = tables.read_table(spark, root, "cases")
    assert sorted(r.application_id for r in read.collect()) == ["A", "B", "C"]
    assert tables.read_table(spark, root, "events").where("created_at is null").count() == 0


def test_one_id_that_fills_the_log(spark):
    """Repeats are found against the first position, also where one id has nearly all rows."""
    e = spark.range(20_000).select(
        F.lit("f").alias("source_file"), (F.col("id") % 50).alias("trace_pos"), F.col("id").cast("int").alias("event_pos"),
        F.lit("A").alias("document_id"), F.when(F.col("id") % 20 > 0, "hot").otherwise(F.col("id").cast("string")).alias("event_id"),
        F.lit("x").alias("activity"), F.lit("2016-01-01").alias("raw_time"))
    t = e.select("source_file", "trace_pos", "document_id").distinct()
    issues = quality.audit(t, e, rules=("duplicate_event_id",))
    assert issues.count() == 19_000 - 1 and issues.where("trace_pos = 0 and event_pos = 50").count() == 0


def test_malformed_file_fails(spark, tmp_path):
    path = tmp_path / "bad.xes"
    path.write_text(HEAD + "<trace><string key='a' value='b'></trace></log>")
    with pytest.raises(Exception):
        xes.read_traces(spark, str(path)).collect()


def test_staging_takes_each_file_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    where = (str(landing), str(tmp_path / "staged"), str(tmp_path / "progress"))
    write(landing / "a.xes.gz", trace("A", event("1")), trace("B"))
    staging.stage_new_files(spark, *where)
    staging.stage_new_files(spark, *where)
    write(landing / "b.xes.gz", trace("C", event("2"), event("3")))
    staging.stage_new_files(spark, *where)
    staged = staging.read_staged(spark, where[1])
    assert sorted(r.document_id for r in xes.flatten_traces(staged).collect()) == ["A", "B", "C"]
    assert xes.flatten_events(staged).count() == 3
    assert staged.select("source_file", "trace_pos").distinct().count() == 3
