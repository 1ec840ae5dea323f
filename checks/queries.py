"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.functions import expressions as E
from caselog.operators import extensions as ext
from caselog import schemas, session
from caselog.operators import features, integrity, loading, metrics, quality
from caselog.operators import model as ml
from caselog.plans import jobs, kpis, predictive, scoring, views
from caselog.sinks import export, snapshots
from caselog.sources import retail, tables, xes
from checks import fixtures

Query = Callable[[SparkSession, str], DataFrame]


def on_events(plan) -> Query:
    return lambda spark, d: plan(retail.order_events(spark, d))


def on_cases(plan) -> Query:
    return lambda spark, d: plan(retail.order_cases(spark, d))


def on_users(plan) -> Query:
    return lambda spark, d: plan(retail.user_cases(spark, d))


def on_log(plan) -> Query:
    return lambda spark, d: plan(retail.order_cases(spark, d), retail.order_events(spark, d))


def on_scores(plan) -> Query:
    return lambda spark, d: plan(retail.order_cases(spark, d), retail.order_predictions(spark, d))


def on_scored_log(plan) -> Query:
    return lambda spark, d: plan(
        retail.order_cases(spark, d), retail.order_events(spark, d), retail.order_predictions(spark, d)
    )


def on_extensions(plan) -> Query:
    return on_cases(lambda cases: plan(ext.generate(cases)))


def _calendar(cases: DataFrame) -> DataFrame:
    first = F.col("first_event_time")
    return cases.select(
        "application_id", F.to_date(first).alias("first_date"), F.year(first).alias("first_year"),
        F.month(first).alias("first_month"), F.weekofyear(first).alias("first_week"),
    )


def _row_counts(cases: DataFrame, events: DataFrame) -> DataFrame:
    tables = {"cases": cases, "events": events}
    named = ("activity_summary", "monthly_summary", "resource_workload")
    return kpis.row_counts({**tables, **{n: views.build(n, tables) for n in named}})


def on_traces(plan) -> Query:
    return lambda spark, d: plan(fixtures.order_traces(spark, d))


def on_rough_log(plan) -> Query:
    return lambda spark, d: plan(fixtures.rough_traces(spark, d), fixtures.rough_events(spark, d))


def on_issues(plan, rules=None) -> Query:
    return on_rough_log(lambda t, e: plan(quality.audit(t, e, rules=rules)))


def _attributes(traces: DataFrame) -> DataFrame:
    a = F.col("attributes")
    return traces.select(
        xes.attribute(a, "concept:name").alias("application_id"),
        F.explode(xes.attribute_map(a)).alias("key", "value"),
    )


def _parsed(traces: DataFrame, events: DataFrame) -> DataFrame:
    return events.select("trace_pos", "event_pos", xes.parse_time(F.col("raw_time")).alias("parsed"))


def _examples(issues: DataFrame) -> DataFrame:
    return quality.rule_report(issues).select("rule", F.inline("examples"))


def _orphans(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose cases are missing, as only the cases of one type are kept."""
    kept = cases.where(F.col("application_type") == "New credit")
    return integrity.orphans(events, kept, "application_id").groupBy("activity").agg(F.count(F.lit(1)).alias("orphans"))


def _violations(extensions: DataFrame) -> DataFrame:
    """Rules broken by rows that were moved out of their ranges."""
    moved = extensions.withColumns({
        "page_count": F.col("page_count") - 2, "quality_score": F.col("quality_score") + 8,
        "sla_target_hours": F.when(F.col("page_count") == 5, F.col("sla_target_hours") + 1).otherwise(F.col("sla_target_hours"))})
    return ext.violations(moved).select(F.explode("broken_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def _materialized(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        root = session.scratch_path(spark, "views")
        tables = {"cases": retail.order_cases(spark, d), "events": retail.order_events(spark, d)}
        jobs.refresh_materialized_views(tables, root)
        return jobs.read_materialized_view(spark, root, name)

    return run


def _extension_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Populate twice with different seeds: the second run replaces every row."""
    root, cases = session.scratch_path(spark, "extensions"), retail.order_cases(spark, d)
    for seed in (7, 42):
        jobs.populate_extensions(cases, f"{root}/table", f"{root}/loads", seed)
    stored = snapshots.read(spark, f"{root}/table", schemas.EXTENSIONS)
    return stored.drop("created_at", "updated_at")


def _load_log(spark: SparkSession, d: str) -> DataFrame:
    root = session.scratch_path(spark, "loads")
    jobs.populate_extensions(retail.order_cases(spark, d), f"{root}/table", f"{root}/loads")
    return spark.read.parquet(f"{root}/loads").select(
        "source_file", "load_type", "records_loaded", "load_status"
    )


def _prediction_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Store both versions, then the first again: its rows are replaced, the other stays."""
    root, rows = session.scratch_path(spark, "predictions"), retail.order_predictions(spark, d)
    for version in ("v1.0", "v2.0", "v1.0"):
        snapshots.upsert_part(
            rows.where(F.col("model_version") == version), root, "model_version", version,
            ["application_id"], schemas.PREDICTIONS,
        )
    return snapshots.read_parts(spark, root, "model_version", schemas.PREDICTIONS).drop("created_at", "updated_at")


def _exported(name: str, kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = session.scratch_path(spark, "export")
        tables = {"cases": retail.order_cases(spark, d), "events": retail.order_events(spark, d)}
        export.export_dataset(spark, tables, out, name, (kind,))
        if kind == "parquet":
            return spark.read.parquet(f"{out}/{name}.parquet")
        return export.read_csv(spark, f"{out}/{name}.csv")

    return run


def _export_listing(spark: SparkSession, d: str) -> DataFrame:
    out = session.scratch_path(spark, "export")
    tables = {"cases": retail.order_cases(spark, d), "events": retail.order_events(spark, d)}
    done = export.export_all(spark, tables, out)
    known = spark.read.parquet(done["manifest"]).select("dataset", "format", "rows", F.col("size_bytes").alias("written"))
    return export.list_exports(spark, out).join(known, ["dataset", "format"]).select(
        "dataset", "format", "rows", ((F.col("size_bytes") == F.col("written")) & (F.col("size_bytes") > 0)).alias("stored"))


def _export_manifest(spark: SparkSession, d: str) -> DataFrame:
    out = session.scratch_path(spark, "export")
    tables = {"cases": retail.order_cases(spark, d), "events": retail.order_events(spark, d)}
    done = export.export_all(spark, tables, out)
    return spark.read.parquet(done["manifest"]).select("dataset", "format", "rows")


def _quality_sinks(spark: SparkSession, d: str) -> DataFrame:
    path = session.scratch_path(spark, "quality")
    quality.run(fixtures.rough_traces(spark, d), fixtures.rough_events(spark, d), path)
    return spark.read.json(f"{path}/quarantine").select("document_id", "decision", "rules", "trace_pos")


BREACH, DAYS, LOG_DAYS = "is_sla_breach_median", "processing_days", "log_processing_days"


#: Results of the overview bundle besides those registered one by one.
OTHER_RESULTS = ("total_applications", "total_events", "processing_time_buckets", "lifecycle_transitions", "monthly_summary")


def _new_credit(cases: DataFrame) -> DataFrame:
    """Extensions for one application type only, so that some cases have none."""
    return ext.generate(cases.where(F.col("application_type") == "New credit"))


def _prepared(cases: DataFrame) -> DataFrame:
    return features.prepare(fixtures.stored(features.training_set(cases, ext.generate(cases)), "training"))


def _targets(cases: DataFrame) -> DataFrame:
    return _prepared(cases).withColumn(LOG_DAYS, F.round(LOG_DAYS, 9))


def _preprocessed(cases: DataFrame) -> DataFrame:
    """Scaled numbers and the number of set category flags of each case."""
    rows = ml.inputs(_prepared(cases), "full")
    vectors = ml.fit_preprocessing(rows, "full").transform(rows)
    every = vector_to_array("_features")
    numbers = features.numeric("full")
    flags = F.aggregate(F.slice(every, F.lit(len(numbers) + 1), F.size(every)), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(
        "application_id", *[F.when(~F.isnan(every[i]), F.round(every[i], 6)).alias(c) for i, c in enumerate(numbers)],
        flags.cast("int").alias("flags"),
    )


def _threshold(cases: DataFrame) -> DataFrame:
    known = views.case_durations(cases)
    return cases.sparkSession.range(1).select(*[
        F.round(F.lit(features.training_threshold(known, "processing_days", s)), 6).alias(s) for s in ("median", "mean")
    ])


def _labelled(cases: DataFrame) -> DataFrame:
    return cases.select("application_id", F.col("application_type").alias("label"))


def _split(cases: DataFrame) -> DataFrame:
    train, test = features.stratified_split(_labelled(cases), "label")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _scored_truth(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Fixed predictions next to what happened."""
    known = views.case_durations(cases).where(F.col("processing_days").isNotNull())
    return known.join(predictions.where(F.col("model_version") == "v1.0"), "application_id").withColumn(
        "label", (F.col("processing_days") > 1000).cast("int")
    )


def _metrics(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    return metrics.evaluate(
        _scored_truth(cases, predictions), "label", "risk_probability", "risk_class",
        "processing_days", "predicted_processing_days",
    )


def _determined(cases: DataFrame) -> DataFrame:
    """The cases with durations that only the application type decides: ten days for a new
    credit, two for the others, so that a trained model has one right answer."""
    first = F.coalesce("first_event_time", F.lit("2024-01-01").cast("timestamp"))
    days = F.when(F.col("application_type") == "New credit", 10).otherwise(2)
    return cases.withColumns({
        "first_event_time": first, "last_event_time": first + F.make_dt_interval(days=days),
    })


def _trained(cases: DataFrame, subset: str = "full") -> tuple[ml.RiskModel, DataFrame, DataFrame]:
    train, test = features.stratified_split(_prepared(_determined(cases)), BREACH)
    return ml.RiskModel(subset).fit(train, BREACH, LOG_DAYS), train, test


def _one_row(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()])


def _answers(scored: DataFrame) -> DataFrame:
    return scored.select(
        "application_id", "risk_class", F.round("predicted_processing_days", 4).alias("predicted_processing_days"))


def _predict(cases: DataFrame) -> DataFrame:
    model, _, test = _trained(cases)
    return _answers(model.predict(test))


def _predict_real(cases: DataFrame) -> DataFrame:
    """The true targets, which no feature decides: every answer lies in its range."""
    rows = _prepared(cases)
    train, _ = features.stratified_split(rows, BREACH)
    scored = ml.RiskModel("real").fit(train, BREACH, LOG_DAYS).predict(rows)
    in_range = F.col("risk_probability").between(0, 1) & (F.col("predicted_processing_days") >= 0) & F.col("risk_class").isin(0, 1)
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(in_range).alias("in_range"))


def _evaluate(subset: str) -> Query:
    def run(cases: DataFrame) -> DataFrame:
        model, _, test = _trained(cases, subset)
        return _one_row(cases.sparkSession, model.evaluate(test, BREACH, DAYS))

    return on_cases(run)


def _ablation(cases: DataFrame) -> DataFrame:
    train, test = features.stratified_split(_prepared(_determined(cases)), BREACH)
    rows = [
        _one_row(cases.sparkSession, values).withColumn("features", F.lit(name))
        for name, values in ml.ablation(train, test, BREACH, LOG_DAYS, DAYS).items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _cross_validate(cases: DataFrame) -> DataFrame:
    rows = _prepared(_determined(cases))
    return _one_row(cases.sparkSession, ml.RiskModel("real").cross_validate(rows, BREACH, DAYS))


def _saved_model(cases: DataFrame) -> DataFrame:
    model, _, test = _trained(cases, "real")
    path = model.save(session.scratch_path(cases.sparkSession, "model"))
    return _answers(ml.RiskModel.load(path).predict(test))


def _training_job(cases: DataFrame) -> DataFrame:
    """Train, save, score every case with the saved model, read the predictions back."""
    cases, root = _determined(cases), session.scratch_path(cases.sparkSession, "trained")
    extensions = ext.generate(cases)
    jobs.train(cases, extensions, f"{root}/model")
    scoring.score_cases(cases, extensions, f"{root}/model", "v1.0", f"{root}/predictions")
    return scoring.read_predictions(cases.sparkSession, f"{root}/predictions").select(
        "application_id", "model_version", F.col("risk_class").cast("int").alias("risk_class"),
        F.col("predicted_processing_days").cast("double").alias("predicted_processing_days"))


def _predict_case(cases: DataFrame) -> DataFrame:
    model, _, _ = _trained(cases)
    return scoring.predict_case(model, cases, ext.generate(cases), "1").select(
        "application_id", F.col("sla_risk_class").cast("int").alias("sla_risk_class"), "predicted_processing_days", "model_type")


def _read_tables(spark: SparkSession, d: str) -> DataFrame:
    """Extensions and both versions of predictions stored twice, read as model tables."""
    root, cases = session.scratch_path(spark, "tables"), retail.order_cases(spark, d)
    for seed in (7, 42):
        jobs.populate_extensions(cases, f"{root}/extensions", f"{root}/loads", seed)
    scored = retail.order_predictions(spark, d)
    for version in ("v1.0", "v2.0", "v1.0"):
        snapshots.upsert_part(
            scored.where(F.col("model_version") == version), f"{root}/predictions", "model_version", version,
            ["application_id"], schemas.PREDICTIONS)
    counted = lambda name: tables.read_table(spark, root, name).agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.countDistinct("application_id").alias("cases"))
    return counted("extensions").unionByName(counted("predictions"))


def _repeated_load(spark: SparkSession, d: str) -> DataFrame:
    """The order log loaded twice: the second load adds nothing; times are written."""
    root = session.scratch_path(spark, "load")
    traces = fixtures.order_traces(spark, d)
    for _ in range(2):
        jobs.load_log(traces, root)
    cases, events = tables.read_table(spark, root, "cases"), tables.read_table(spark, root, "events")
    stamped = lambda df, name, *times: df.agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.greatest(*[F.col(t).isNull() for t in times], F.lit(False))).alias("unstamped"))
    loads = spark.read.parquet(f"{root}/loads").agg(
        F.lit("loads").alias("name"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("load_status") != "SUCCESS").alias("unstamped"))
    return stamped(cases, "cases", "created_at", "updated_at").unionByName(stamped(events, "events", "created_at")).unionByName(loads)


def _report_head(spark: SparkSession, d: str) -> DataFrame:
    path = session.scratch_path(spark, "quality")
    quality.run(fixtures.rough_traces(spark, d), fixtures.rough_events(spark, d), path)
    return spark.read.json(f"{path}/report_head").select("traces", "events", "quarantined_traces")


def _dummy(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    rows = _scored_truth(cases, predictions).select("application_id", "label", DAYS)
    guess = ml.dummy_predictions(rows, rows, "label", DAYS)
    return metrics.evaluate(guess, "label", "risk_probability", "risk_class", DAYS, "predicted_processing_days")


def _skip_reasons(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Fixed predictions pushed out of range in places, both versions in one batch."""
    batch = predictions.select(
        "application_id", "model_version", F.col("risk_class").cast("int").alias("risk_class"),
        (F.col("risk_probability").cast("double") + 0.25).alias("risk_probability"),
        (F.col("predicted_processing_days").cast("double") - 5).alias("predicted_processing_days"),
    )
    return scoring.with_reasons(batch, "v9", "fixture", ["model_version"]).drop("model_version", "model_type")


def _score_job(spark: SparkSession, d: str) -> DataFrame:
    cases = retail.order_cases(spark, d)
    model, _, _ = _trained(cases)
    path = session.scratch_path(spark, "predictions")
    for _ in range(2):
        scoring.score_cases(cases, _new_credit(cases), model, "v1.0", path)
    return scoring.read_predictions(spark, path).select(
        "application_id", "model_version", "model_type", F.col("risk_class").cast("int").alias("risk_class"),
        F.col("predicted_processing_days").cast("double").alias("predicted_processing_days"))


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    cases = retail.order_cases(spark, d)
    model, _, _ = _trained(cases)
    asked = retail.table(spark, d, "customer").select(
        F.col("c_custkey").alias("position"), F.col("c_custkey").cast("string").alias("application_id")
    )
    return scoring.predict_batch(model, cases, _new_credit(cases), asked).select(
        "position", "application_id", "status", "error", F.col("sla_risk_class").cast("int").alias("sla_risk_class"),
        "predicted_processing_days"
    )


def queries() -> dict[str, Query]:
    march, september = date(1996, 3, 15), date(1997, 9, 20)
    return {
        "b01_durations": on_users(
            lambda c: views.case_durations(c).select("application_id", "processing_hours", "processing_days")
        ),
        "b02_activity_class": on_events(
            lambda e: e.groupBy(E.activity_type(F.col("activity")).alias("activity_type"))
            .agg(F.count(F.lit(1)).alias("events"))
        ),
        "b14_calendar": on_cases(_calendar),
        "c07_orphans": on_log(_orphans),
        "d01_application_metrics": on_log(views.case_metrics),
        "d02_daily_throughput": on_cases(views.daily_throughput),
        "d03_activity_summary": on_events(views.activity_summary),
        "d04_resource_workload": on_events(views.resource_workload),
        "d05_application_type_metrics": on_cases(views.application_type_metrics),
        "d06_loan_goal_metrics": on_cases(views.loan_goal_metrics),
        "d07_lifecycle_transition_metrics": on_events(views.lifecycle_transition_metrics),
        "d08_event_origin_metrics": on_events(views.event_origin_metrics),
        "d09_monthly_summary": on_cases(views.monthly_summary),
        "d10_weekly_summary": on_cases(views.weekly_summary),
        "d11_event_sequence": on_events(lambda e: views.event_sequence(e).drop("time_to_next")),
        "d12_processing_time_buckets": on_cases(views.processing_time_buckets),
        "d12_processing_time_buckets_users": on_users(views.processing_time_buckets),
        "d13_offer_analysis": on_events(views.offer_analysis),
        "d14_mv_activity_summary": on_events(views.mv_activity_summary),
        "d15_mv_resource_workload": on_events(views.mv_resource_workload),
        "d16_mv_monthly_summary": on_cases(views.mv_monthly_summary),
        "d17_mv_application_type_summary": on_cases(views.mv_application_type_summary),
        "d18_predictive_sla_risk": on_scored_log(predictive.sla_risk),
        "d19_predictive_sla_risk_latest": on_scored_log(predictive.sla_risk_latest),
        "j01_total_applications": on_cases(kpis.total_applications),
        "j02_total_events": on_events(kpis.total_events),
        "j03_application_volume_by_type": on_cases(kpis.application_volume_by_type),
        "j04_volume_monthly": on_cases(kpis.application_volume_over_time),
        "j04_volume_monthly_range": on_cases(
            lambda c: kpis.application_volume_over_time(c, "monthly", march, september)
        ),
        "j04_volume_daily": on_cases(lambda c: kpis.application_volume_over_time(c, "daily")),
        "j04_volume_daily_range": on_cases(
            lambda c: kpis.application_volume_over_time(c, "daily", march, september)
        ),
        "j05_event_volume": on_cases(kpis.event_volume_over_time),
        "j06_processing_duration_metrics": on_cases(
            lambda c: kpis.processing_duration_metrics(c).drop("distribution")
        ),
        "j06_processing_duration_metrics_users": on_users(
            lambda c: kpis.processing_duration_metrics(c).drop("distribution")
        ),
        "j07_processing_time_distribution": on_users(kpis.processing_time_distribution),
        "j08_activity_summary": on_events(kpis.activity_summary),
        "j09_resource_workload": on_events(kpis.resource_workload),
        "j09_resource_workload_top": on_events(lambda e: kpis.resource_workload(e, 10)),
        "j10_lifecycle_outcome_summary": on_events(kpis.lifecycle_outcome_summary),
        "j11_loan_goal_summary": on_cases(kpis.loan_goal_summary),
        "j12_application_processing_metrics": on_log(kpis.application_processing_metrics),
        "j12_application_processing_metrics_top": on_log(
            lambda c, e: kpis.application_processing_metrics(c, e, 100)
        ),
        "j13_executive_summary": on_log(lambda c, e: kpis.executive_summary(c, e).drop("application_types")),
        "j13_executive_summary_types": on_log(
            lambda c, e: kpis.executive_summary(c, e).select(F.inline("application_types"))
        ),
        "j14_extension_metrics": on_extensions(
            lambda x: kpis.synthetic_extension_metrics(x).select("total_records", "avg_quality_score")
        ),
        "j14_extension_priorities": on_extensions(
            lambda x: kpis.synthetic_extension_metrics(x)
            .select(F.explode("priority_distribution").alias("priority", "count"))
        ),
        "j14_extension_branches": on_extensions(
            lambda x: kpis.synthetic_extension_metrics(x).select(F.inline("top_branches"))
        ),
        "j15_activity_kpis": on_events(kpis.activity_kpis),
        "j16_resource_kpis": on_events(kpis.resource_kpis),
        "j17_outcome_kpis": on_log(kpis.outcome_kpis),
        "j18_activity_type_rollup": on_events(kpis.activity_type_rollup),
        "f08_goal_duration_extremes": on_cases(kpis.goal_duration_extremes),
        "j19_chart_lifecycle_share": on_log(lambda c, e: kpis.chart_feeds(c, e)["lifecycle_outcomes"]),
        "j19_chart_top_activities": on_log(lambda c, e: kpis.chart_feeds(c, e)["activity_summary"]),
        "j19_chart_top_resources": on_log(lambda c, e: kpis.chart_feeds(c, e)["resource_workload"]),
        "a18_row_counts": on_log(_row_counts),
        "a19_by_application_type": on_log(lambda c, e: kpis.representative_queries(c, e)["by_application_type"]),
        "a19_top_activities": on_log(lambda c, e: kpis.representative_queries(c, e)["top_activities"]),
        "a19_top_resources": on_log(lambda c, e: kpis.representative_queries(c, e)["top_resources"]),
        "k01_prediction_coverage": on_scores(predictive.prediction_coverage),
        "k01_prediction_coverage_v1": on_scores(lambda c, p: predictive.prediction_coverage(c, p, "v1.0")),
        "k02_risk_distribution": on_scores(predictive.risk_distribution),
        "k02_risk_distribution_v1": on_scores(lambda c, p: predictive.risk_distribution(c, p, "v1.0")),
        "k03_risk_probability_bands": on_scores(predictive.risk_probability_bands),
        "k03_risk_probability_bands_v1": on_scores(lambda c, p: predictive.risk_probability_bands(c, p, "v1.0")),
        "k04_processing_time_summary": on_scores(predictive.predicted_processing_time_summary),
        "k04_processing_time_summary_v1": on_scores(
            lambda c, p: predictive.predicted_processing_time_summary(c, p, "v1.0")
        ),
        "k05_prediction_error_summary": on_scored_log(predictive.prediction_error_summary),
        "k05_prediction_error_summary_v1": on_scored_log(
            lambda c, e, p: predictive.prediction_error_summary(c, e, p, "v1.0")
        ),
        "k06_high_risk_applications": on_scores(predictive.high_risk_applications),
        "k06_high_risk_applications_v1": on_scores(
            lambda c, p: predictive.high_risk_applications(c, p, 0.8, 200, "v1.0")
        ),
        "k07_version_comparison": on_scores(predictive.version_comparison),
        "l01_generate_extensions": on_extensions(lambda x: x),
        "l06_extension_violations": on_extensions(_violations),
        "a01_trace_scan": on_traces(
            lambda t: xes.flatten_traces(t).select(F.col("document_id").alias("application_id"), "events")
        ),
        "a02_attribute_map": on_traces(_attributes),
        "a03_parse_time": on_rough_log(_parsed),
        "a04_load_cases": on_traces(
            lambda t: loading.load_cases(t).select(
                "application_id", "application_type", "loan_goal", "requested_amount")
        ),
        "a05_load_events": on_traces(lambda t: loading.load_events(t)[0]),
        "a06_case_rollup": on_traces(
            lambda t: loading.load_cases(t).select(
                "application_id", "first_event_time", "last_event_time", "event_count")
        ),
        "a06_case_rollup_from_events": on_events(loading.case_rollup),
        "a08_extension_upsert": _extension_upsert,
        "a09_prediction_upsert": _prediction_upsert,
        "a10_load_log": _load_log,
        **{f"a11_{name}": _materialized(name) for name in views.MATERIALIZED},
        "a12_csv_sink": _exported("lifecycle_outcomes", "csv"),
        "a13_parquet_sink": _exported("application_volume_daily", "parquet"),
        **{f"a14_{name}": _exported(name, "parquet") for name in export.DATASETS if name != "executive_summary"},
        "a14_executive_summary": lambda spark, d: _exported("executive_summary", "parquet")(spark, d)
        .drop("application_types"),
        "a15_export_all": _export_manifest,
        "a16_export_listing": _export_listing,
        "a17_quality_sinks": _quality_sinks,
        "c07_repeated_keys": on_rough_log(
            lambda t, e: integrity.repeated_keys(e.where(F.col("event_id") != ""), ["event_id"])
        ),
        "i01_issues": on_issues(
            lambda i: i.select("rule", "severity", "document_id", "detail", "trace_pos", "event_pos")
        ),
        "i13_rule_report": on_issues(
            lambda i: quality.rule_report(i).select("rule", "severity", "issue_count")
        ),
        "i13_examples": on_issues(_examples),
        "i14_quarantine": on_issues(
            lambda i: quality.quarantine(i).select("document_id", "decision", "rules", "trace_pos"), quality.QUARANTINING
        ),
        "i15_totals": on_rough_log(quality.totals),
        "m01_training_set": on_cases(lambda c: features.training_set(c, _new_credit(c))),
        "m05_features_and_targets": on_cases(_targets),
        "m08_preprocessing": on_cases(_preprocessed),
        "m06_training_threshold": on_cases(_threshold),
        "m07_stratified_split": on_cases(_split),
        "m13_folds": on_cases(lambda c: features.with_folds(_labelled(c), "label")),
        "m14_metrics": on_scores(_metrics),
        "m16_dummy_baseline": on_scores(_dummy),
        "m12_fit_predict": on_cases(_predict),
        "m13_cross_validate": on_cases(_cross_validate),
        "m15_save_load": on_cases(_saved_model),
        "m12_fit_predict_real": on_cases(_predict_real),
        "m17_ablation": on_cases(_ablation),
        "m17_ablation_real": _evaluate("real"),
        "m17_ablation_full": _evaluate("full"),
        "m18_training_job": on_cases(_training_job),
        "r02_predict_case": on_cases(_predict_case),
        "a07_read_tables": _read_tables,
        "a05_repeated_load": _repeated_load,
        "a17_report_head": _report_head,
        **{f"a19_{name}": on_log(lambda c, e, n=name: kpis.representative_queries(c, e)[n]) for name in OTHER_RESULTS},
        "p01_scoring_input": on_cases(lambda c: scoring.scoring_input(c, _new_credit(c))),
        "p03_skip_reasons": on_scores(_skip_reasons),
        "p06_score_job": _score_job,
        "r01_features_of_case": on_cases(lambda c: scoring.features_of_case(c, ext.generate(c), "1")),
        "r01_case_features": on_cases(lambda c: features.case_features(c, _new_credit(c), known_only=True)),
        "r03_batch_lookup": _lookup,
    }
