"""Non-destructive quality rules over traces and events.

Issues are selected, never removed from the data. Rules about one row share one pass;
"seen before" meets the rows with the repeated keys only, and "previous time" uses the
skew-aware neighbours. The log is read several times, so it should be a stored one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselog.operators import ordered
from caselog.session import scratch_path, staged
from caselog.sources import xes
from caselog.sources.paths import delete

EXAMPLES_PER_RULE = 20
#: Rows of a key that one task may meet, and the number of keys above it that may be broadcast.
HEAVY_ROWS, HEAVY_KEYS = 1_000_000, 100_000
MISSING = "<missing>"

# Rule, severity, whether it quarantines the trace (fixed values), and what it asks for.
CATALOG = (
    ("missing_document_id", "error", True, "A trace has a concept:name."),
    ("duplicate_document", "error", True, "A concept:name names one trace."),
    ("orphan_event", "error", True, "An event belongs to a trace with a name."),
    ("missing_event_id", "warning", False, "An event has an EventID."),
    ("duplicate_event_id", "warning", False, "An EventID names one event of the whole extract."),
    ("missing_timestamp", "error", True, "An event has a time:timestamp."),
    ("invalid_timestamp", "error", True, "A time:timestamp is ISO-8601 text."),
    ("missing_activity", "error", True, "An event has a concept:name."),
    ("non_monotonic_event_time", "warning", False, "Times do not run backwards within a trace."),
    # Holds by construction: both ends come from the same list of times.
    ("impossible_processing_duration", "error", True, "A trace does not end before it starts."),
    ("unavailable_document_extension_fields", "info", False,
     "Page count, document type, SLA, branch, priority and error flags are not in the source."),
    ("sla_consistency_not_evaluable", "info", False, "SLA targets exist only after extensions are generated."),
)
SEVERITY = {rule: severity for rule, severity, _, _ in CATALOG}
QUARANTINING = tuple(rule for rule, _, holds, _ in CATALOG if holds)
DATASET_RULES = tuple(rule for rule, severity, _, _ in CATALOG if severity == "info")

#: The rules that look at one event alone, in the order in which they are tested.
ROW_RULES = ("orphan_event", "missing_event_id", "missing_activity", "missing_timestamp", "invalid_timestamp")

#: All rules that read events.
EVENT_RULES = (*ROW_RULES, "duplicate_event_id", "non_monotonic_event_time")

TRACE = ("source_file", "trace_pos")
EVENT = ("source_file", "trace_pos", "event_pos")
ISSUE_COLUMNS = ("rule", "severity", "document_id", "detail", "source_file", "trace_pos", "event_pos")


def _severity(rule: Column) -> Column:
    found = F
    for name, severity in SEVERITY.items():
        found = found.when(rule == name, severity)
    return found


def _issue(rule: str, detail: Column | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(rule).alias("rule"), text.alias("detail"))


def _exploded(rows: DataFrame, tests: list[tuple[Column, Column]]) -> DataFrame:
    """All row-local rules of one scan: the issues of a row are listed, then unnested."""
    found = F.array_compact(F.array(*[F.when(test, issue) for test, issue in tests]))
    return rows.select(
        "document_id", "source_file", "trace_pos", "event_pos", F.explode(found).alias("i")
    ).select("document_id", "source_file", "trace_pos", "event_pos", "i.rule", "i.detail")


def _repeats(rows: DataFrame, key: str, position: tuple[str, ...], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Rows whose key occurs at an earlier position.

    One aggregate finds the keys that repeat, how often, and their first position; it merges
    map-side, so a key that fills the log is a row per task. It is stored, and tells heavy keys
    from the others. Rows of the others meet their key's first position by a join on the key.
    A heavy key has more than ``heavy_rows`` rows and more than a ``HEAVY_KEYS``-th of all, so
    there are fewer than ``HEAVY_KEYS``: their rows get a salt, the first position is
    replicated to each salt of its key, and they meet on both."""
    rows = rows.where(F.col(key) != "")
    at = F.struct(*position)
    firsts = staged(
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first")).where(F.col("_n") > 1), "repeated-keys")
    repeated = firsts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    later = lambda met: met.where(at > F.col("_first")).select(*rows.columns)
    limit = max(heavy_rows, repeated.rows // HEAVY_KEYS)
    if repeated.most <= limit:
        return later(rows.join(firsts, key))
    is_heavy = F.col("_n") > limit
    heavy = firsts.where(is_heavy).withColumn("_salts", F.ceil(F.col("_n") / limit).cast("int"))
    salted = rows.join(F.broadcast(heavy.select(key, "_salts")), key).withColumn(
        "_salt", F.pmod(F.xxhash64(*position), F.col("_salts")).cast("int"))
    replicated = heavy.select(key, "_first", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return later(others.join(firsts.where(~is_heavy), key)).unionByName(later(salted.join(replicated, [key, "_salt"])))


def _backwards(events: DataFrame, hot_rows: int | None) -> DataFrame:
    """Events earlier than the last readable time before them in their trace. Unreadable
    times are left out first, so the previous row is the previous readable time. The place
    leads the keys: sorting compares numbers first, not the file that most rows share."""
    timed = events.where(F.col("_time").isNotNull()).select("document_id", *EVENT, "_time")
    return ordered.neighbours(
        timed, list(TRACE[::-1]), ["event_pos"], lags={"_previous": "_time"}, hot_rows=hot_rows,
        sizes_of=events.select(*TRACE),
    ).where(F.col("_time") < F.col("_previous"))


def audited_traces(traces: DataFrame) -> DataFrame:
    """What the rules read of traces."""
    return traces.select(*TRACE, xes.strip(F.col("document_id")).alias("document_id"))


def audited_events(events: DataFrame) -> DataFrame:
    """What the rules read of events: stripped texts, the time in microseconds, and the text of
    a time that is none. To be stored, for a rule's filter and projection would each parse again."""
    text = xes.strip(F.col("raw_time"))
    stripped = events.select(
        *EVENT, xes.strip(F.col("document_id")).alias("document_id"),
        xes.strip(F.col("event_id")).alias("event_id"), "activity", text.alias("raw_time"),
        F.unix_micros(xes.parse_time(text)).alias("_time"),
    )
    return stripped.withColumn("raw_time", F.when(F.col("_time").isNull(), F.col("raw_time")))


def audit(
    traces: DataFrame, events: DataFrame, hot_rows: int | None = ordered.HOT_ROWS,
    rules: Sequence[str] | None = None, heavy_rows: int = HEAVY_ROWS, stored: bool = False,
) -> DataFrame:
    """Every issue as a row; of ``rules`` only, if given, and then nothing is computed for
    the others. The rules read the events several times: they are stored as narrow rows
    first, unless the caller has ``stored`` what ``audited_traces`` and ``audited_events`` give.

    ``traces`` needs source_file, trace_pos, document_id; ``events`` adds event_pos,
    event_id, activity, raw_time.
    """
    asked = lambda *names: rules is None or any(n in rules for n in names)
    blank = lambda c: xes.strip(F.col(c)) == ""
    t = (traces if stored else audited_traces(traces)).withColumn("event_pos", F.lit(None).cast("int"))
    e = events if stored else audited_events(events)
    if asked(*EVENT_RULES) and not stored:
        e = staged(e, "audited-events")
    no_name = F.col("document_id") == ""
    tests = [
        (no_name, _issue("orphan_event", "Event belongs to a trace without an identifier.")),
        (F.col("event_id") == "", _issue("missing_event_id", "EventID is blank.")),
        (blank("activity"), _issue("missing_activity", "Event concept:name is blank.")),
        (F.col("raw_time") == "", _issue("missing_timestamp", "time:timestamp is blank.")),
        ((F.col("raw_time") != "") & F.col("_time").isNull(),
         _issue("invalid_timestamp", F.concat(F.lit("Unparseable timestamp: "), F.col("raw_time")))),
    ]
    on_rows = [(test, issue) for (test, issue), name in zip(tests, ROW_RULES, strict=True) if asked(name)]
    parts = [_dataset_issues(traces.sparkSession, e)]
    if asked("missing_document_id"):
        parts.append(_exploded(t, [(no_name, _issue("missing_document_id", "Trace concept:name is blank."))]))
    if asked("duplicate_document"):
        parts.append(_repeats(t, "document_id", TRACE, heavy_rows).select(
            "document_id", *EVENT, F.lit("duplicate_document").alias("rule"),
            F.lit("Trace concept:name repeats.").alias("detail")))
    if on_rows:
        parts.append(_exploded(e, on_rows))
    if asked("duplicate_event_id"):
        parts.append(_repeats(e, "event_id", EVENT, heavy_rows).select(
            "document_id", *EVENT, F.lit("duplicate_event_id").alias("rule"),
            F.concat(F.lit("Repeated EventID: "), F.col("event_id")).alias("detail")))
    if asked("non_monotonic_event_time"):
        parts.append(_backwards(e, hot_rows).select(
            "document_id", *EVENT, F.lit("non_monotonic_event_time").alias("rule"),
            F.lit("Event time precedes prior event time.").alias("detail")))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    if rules is not None:
        issues = issues.where(F.col("rule").isin(*rules))
    shown = F.when(F.col("document_id") == "", MISSING).otherwise(F.col("document_id"))
    return issues.withColumns({"severity": _severity(F.col("rule")), "document_id": shown}).select(*ISSUE_COLUMNS)


def _dataset_issues(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Notes that hold once for any dataset."""
    position = [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in EVENT]
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in DATASET_RULES])).alias("rule")
    ).select(
        F.lit("<dataset>").alias("document_id"), *position, "rule",
        F.lit("The source carries no such attributes; they are generated separately.").alias("detail"),
    )


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, rule, severity, text) for i, (rule, severity, _, text) in enumerate(CATALOG)]
    return spark.createDataFrame(rows, "position int, rule string, severity string, description string")


def examples(issues: DataFrame, n: int = EXAMPLES_PER_RULE) -> DataFrame:
    """The first ``n`` issues of each rule in source order. The row-number filter limits
    each task to ``n`` rows per rule before the shuffle."""
    order = [F.col(c).asc_nulls_first() for c in EVENT] + [F.col("detail")]
    w = Window.partitionBy("rule").orderBy(*order)
    return issues.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def rule_report(issues: DataFrame) -> DataFrame:
    """Catalog with the number of issues and up to twenty examples of each rule."""
    counts = issues.groupBy("rule").agg(F.count(F.lit(1)).alias("issue_count"))
    shown = examples(issues).groupBy("rule").agg(
        F.array_sort(F.collect_list(F.struct("nth", "document_id", "detail", "severity"))).alias("_x")
    )
    none = F.array().cast("array<struct<document_id:string,detail:string,severity:string>>")
    return (
        catalog(issues.sparkSession)
        .join(F.broadcast(counts), "rule", "left").join(F.broadcast(shown), "rule", "left")
        .select(
            "position", "rule", "description", "severity",
            F.coalesce("issue_count", F.lit(0)).alias("issue_count"),
            F.coalesce(
                F.transform("_x", lambda x: F.struct(x.document_id, x.detail, x.severity)), none
            ).alias("examples"),
        )
        .orderBy("position")
    )


def quarantine(issues: DataFrame) -> DataFrame:
    """One row per trace that broke a quarantining rule, keyed by position since names may
    be missing or repeated. At most one entry per rule is collected for a trace."""
    return (
        issues.where(F.col("rule").isin(*QUARANTINING))
        .groupBy(*TRACE)
        .agg(
            F.first("document_id").alias("document_id"),
            F.array_join(F.array_sort(F.collect_set("rule")), ";").alias("rules"),
        )
        .select("document_id", F.lit("quarantine_for_review").alias("decision"), "rules", *TRACE)
    )


def totals(traces: DataFrame, events: DataFrame) -> DataFrame:
    t = traces.agg(F.count(F.lit(1)).alias("traces"))
    return t.crossJoin(F.broadcast(events.agg(F.count(F.lit(1)).alias("events"))))


# What the head of a report says.
STATUS = "completed_with_documented_source_schema_limitations"
DECISION = "No raw records were deleted or altered."


def report_head(totals: DataFrame, quarantined: DataFrame) -> DataFrame:
    """One row: traces, events, traces held for review, status and decision of the run."""
    held = quarantined.agg(F.count(F.lit(1)).alias("quarantined_traces"))
    return totals.crossJoin(F.broadcast(held)).withColumns(
        {"status": F.lit(STATUS), "pipeline_decision": F.lit(DECISION)}
    )


class QualityTables(NamedTuple):
    issues: DataFrame
    report: DataFrame
    quarantine: DataFrame
    totals: DataFrame
    head: DataFrame


def run(
    traces: DataFrame, events: DataFrame, path: str, hot_rows: int | None = ordered.HOT_ROWS
) -> QualityTables:
    """Audit a log and write issues, rule report, quarantine list and totals below ``path``.

    What the rules read is stored first, so a log parsed from files is parsed once, and so are
    its times; the issues are stored as well, and report and quarantine read those. The head
    counts the quarantine list that was written."""
    spark = traces.sparkSession
    staged = scratch_path(spark, "audit")
    try:
        audited_traces(traces).write.parquet(f"{staged}/traces")
        audited_events(events).write.parquet(f"{staged}/events")
        t, e = spark.read.parquet(f"{staged}/traces"), spark.read.parquet(f"{staged}/events")
        audit(t, e, hot_rows, stored=True).write.mode("overwrite").parquet(f"{path}/issues")
        totals(t, e).write.mode("overwrite").json(f"{path}/totals")
    finally:
        delete(spark, staged)
    issues = spark.read.parquet(f"{path}/issues")
    rule_report(issues).write.mode("overwrite").json(f"{path}/rule_report")
    held = quarantine(issues)
    held.write.mode("overwrite").json(f"{path}/quarantine")
    counted = spark.read.json(f"{path}/totals")
    report_head(counted, spark.read.text(f"{path}/quarantine")).write.mode("overwrite").json(f"{path}/report_head")
    return QualityTables(issues, rule_report(issues), held, counted, spark.read.json(f"{path}/report_head"))
