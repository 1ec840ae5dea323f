import pytest
from pyspark.sql import functions as F

from caselog.operators import extensions as ext
from caselog.operators import features, integrity
from caselog.operators import model as ml
from caselog.plans import jobs, predictive, scoring
from caselog.sources import retail

from helpers import at, cases, dicts, events, predictions

COLUMNS = 18


@pytest.fixture
def log(spark):
    c = cases(
        spark, ("a", "2016-01-01", "2016-01-11", 3, "New credit", "Car", None),
        ("b", "2016-01-01", "2016-01-05", 1, "New credit", "Car", "complete"),
        ("c", "2016-01-01", "2016-01-03", 1, "Limit raise", None, None), ("d", None, None, 0),
    )
    e = events(spark, ("1", "a", "A_x", "2016-01-01", None, "complete"), ("2", "b", "A_x", "2016-01-01"),
               ("3", "c", "A_x", "2016-01-01", None, "suspend"))
    p = predictions(
        spark, ("a", "v1", 0, 0.25, 8, "2024-01-01"), ("a", "v2", 1, 0.75, 12.5, "2024-01-02"),
        ("b", "v1", 1, 0.5, 2, "2024-01-01"), ("c", "v1", 0, 0.1, 1, "2024-01-01"),
    )
    return c, e, p


def test_latest_is_one_row_per_case(log):
    c, e, p = log
    rows = {r.application_id: r for r in predictive.sla_risk_latest(c, e, p).collect()}
    assert set(rows) == {"a", "b", "c"} and len(predictive.sla_risk_latest(c, e, p).columns) == COLUMNS
    assert (rows["a"].model_version, rows["a"].predicted_risk_label) == ("v2", "High Risk")
    assert predictive.sla_risk(c, e, p).count() == 4


def test_equal_scoring_time_takes_the_higher_version(spark, log):
    c, e, _ = log
    p = predictions(spark, ("a", "v1", 0, 0.1, 1, "2024-01-01"), ("a", "v3", 0, 0.2, 1, "2024-01-01"))
    assert predictive.sla_risk_latest(c, e, p).first().model_version == "v3"


def test_error_needs_a_finished_case(log):
    c, e, p = log
    error = {r.application_id: r.processing_days_error for r in predictive.sla_risk_latest(c, e, p).collect()}
    assert error == {"a": -2.5, "b": 2.0, "c": None}
    r = predictive.prediction_error_summary(c, e, p).first()
    assert (r.evaluated_count, r.mae_days, r.rmse_days, r.mean_error_days) == (2, 2.25, 2.26, -0.25)


def test_coverage_and_distribution(log):
    c, _, p = log
    assert dicts(predictive.prediction_coverage(c, p)) == [{
        "total_applications": 4, "applications_with_predictions": 3, "applications_without_predictions": 1,
        "coverage_percentage": 75.0, "model_version": None,
    }]
    assert predictive.prediction_coverage(c, p, " v2 ").first().applications_with_predictions == 1
    assert [(r.predicted_risk_class, r["count"], r.percentage) for r in predictive.risk_distribution(c, p).collect()] == [
        (0, 1, 33.33), (1, 2, 66.67)]


def test_bands_are_always_five(log):
    c, _, p = log
    bands = predictive.risk_probability_bands(c, p, "v1").collect()
    assert [r["count"] for r in bands] == [1, 1, 1, 0, 0]
    nothing = predictive.risk_probability_bands(c, p, "none").collect()
    assert [(r["count"], r.percentage) for r in nothing] == [(0, 0.0)] * 5


def test_summaries_of_nothing_are_zero(log):
    c, e, p = log
    assert predictive.predicted_processing_time_summary(c, p, "none").first()[:5] == (0, 0.0, 0.0, 0.0, 0.0)
    assert predictive.prediction_error_summary(c, e, p, "none").first()[:4] == (0, 0.0, 0.0, 0.0)
    assert predictive.prediction_coverage(c.where("false"), p.where("false")).first().coverage_percentage == 0.0


def test_high_risk_order_and_limit(log):
    c, _, p = log
    rows = predictive.high_risk_applications(c, p, 0.1, 10).collect()
    assert [r.application_id for r in rows] == ["a", "b", "c"]
    assert rows[0].scored_at == "2024-01-02T00:00:00Z" and rows[0].requested_amount == 0.0
    assert predictive.high_risk_applications(c, p, 1, 10).count() == 0
    assert predictive.high_risk_applications(c, p, 0.1, 1).count() == 1


@pytest.mark.parametrize("kwargs", [
    {"min_probability": 1.1}, {"min_probability": -0.1}, {"min_probability": True}, {"min_probability": "0.5"},
    {"limit": 0}, {"limit": True}, {"limit": 1.5}, {"model_version": " "}, {"model_version": 3},
])
def test_bad_parameters(log, kwargs):
    with pytest.raises(ValueError):
        predictive.high_risk_applications(log[0], log[2], **kwargs)


def test_invalid_predictions(spark):
    p = predictions(spark, ("a", "v", 2, 0.5, 1, "2024-01-01"), ("b", "v", 1, 1.5, 1, "2024-01-01"),
                    ("c", "v", 1, 1, -1, "2024-01-01"), (" ", "v", 1, 1, 1, "2024-01-01"), ("e", "v", 0, 0, 0, "2024-01-01"))
    assert [r.application_id for r in integrity.invalid_predictions(p).orderBy("application_id").collect()] == [" ", "a", "b", "c"]


# ---------------------------------------------------------------- extensions
def test_extensions_depend_on_seed_and_id_only(spark, sf):
    c = retail.order_cases(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ext.generate(c)) == rows(ext.generate(c.repartition(7).orderBy(F.rand(3))))
    assert rows(ext.generate(c)) != rows(ext.generate(c, seed=43))
    padded = c.limit(3).withColumn("application_id", F.concat(F.lit("  "), "application_id", F.lit(" ")))
    assert rows(ext.generate(padded)) == rows(ext.generate(c.limit(3)))


def test_extension_domains_and_weights(spark):
    ids = spark.range(20000).select(F.col("id").cast("string").alias("application_id"))
    x = ext.generate(ids)
    assert ext.violations(x).count() == 0
    n = 20000
    shares = {r.priority: r["count"] / n for r in x.groupBy("priority").count().collect()}
    for name, percent, hours in ext.PRIORITIES:
        assert shares[name] == pytest.approx(percent / 100, abs=0.015)
        assert {r[0] for r in x.where(F.col("priority") == name).select("sla_target_hours").distinct().collect()} == {hours}
    r = x.agg(F.min("page_count"), F.max("page_count"), F.min("quality_score"), F.max("quality_score"),
              F.avg(F.col("error_flag").cast("int")), F.avg(F.col("rejection_flag").cast("int"))).first()
    assert (r[0], r[1]) == (1, 25) and 65 <= r[2] < 65.1 and 99.9 < r[3] <= 100
    assert r[4] == pytest.approx(0.08, abs=0.01) and r[5] == pytest.approx(0.05, abs=0.01)
    for c, domain in [("branch", ext.BRANCHES), ("document_type", ext.DOCUMENT_TYPES), ("region", ext.REGIONS),
                      ("channel", ext.CHANNELS), ("operator_team", ext.OPERATOR_TEAMS)]:
        assert {r[0] for r in x.select(c).distinct().collect()} == set(domain)


@pytest.mark.parametrize("bad", ["", "   ", None])
def test_blank_ids_are_refused(spark, bad):
    df = spark.createDataFrame([(bad,)], "application_id string")
    with pytest.raises(Exception, match="non-empty"):
        ext.generate(df).collect()


def test_extension_violations(spark):
    good = ext.generate(spark.createDataFrame([("a",)], "application_id string"))
    for column, value, rule in [
        ("page_count", 0, "page_count below 1"), ("quality_score", 64.99, "quality_score out of bounds"),
        ("sla_target_hours", 99, "sla target mismatch"), ("priority", "later", "unknown priority"),
        ("application_id", " ", "blank application_id"),
    ]:
        broken = good.withColumn(column, F.lit(value))
        assert rule in ext.violations(broken).first().broken_rules
        with pytest.raises(Exception, match=rule):
            ext.checked(broken).collect()


# ---------------------------------------------------------------- features and model
def test_submission_parts(spark):
    c = cases(spark, ("fri", "2016-01-01T13:00", "2016-01-02", 1), ("sun", "2016-01-03T00:00", "2016-01-04", 1))
    rows = {r.application_id: r for r in features.case_features(c, ext.generate(c)).collect()}
    assert (rows["fri"].submission_hour, rows["fri"].submission_day_of_week, rows["fri"].submission_month, rows["fri"].is_weekend) == (13, 4, 1, 0)
    assert (rows["sun"].submission_day_of_week, rows["sun"].is_weekend) == (6, 1)


def test_missing_extension_is_imputed(spark):
    c = cases(spark, ("a", "2016-01-01", "2016-01-02", 1))
    none = ext.generate(c.where("false"))
    r = features.case_features(c, none).first()
    assert (r.page_count, r.quality_score, r.sla_target_hours, r.branch) == (1, 85.0, 48, None)
    assert features.case_features(c, none, known_only=True).count() == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(float(d),) for d in (5, 10, 15, 20, 100)], "processing_days double")
    assert features.training_threshold(df) == 15.0
    assert features.training_threshold(df, strategy="mean") == 30.0
    with pytest.raises(ValueError):
        features.training_threshold(df, strategy="mode")


def test_targets(spark):
    c = cases(spark, *[(str(i), "2016-01-01", f"2016-01-{1 + d:02d}", 1) for i, d in enumerate((1, 2, 3, 10))], ("n", None, None, 0))
    p = features.prepare(features.training_set(c, ext.generate(c)))
    rows = {r.application_id: r for r in p.collect()}
    assert [rows[i].is_sla_breach_operational for i in "0123n"] == [0, 0, 0, 1, 0]
    assert [rows[i].is_sla_breach_median for i in "0123n"] == [0, 0, 1, 1, 0]
    assert rows["n"].log_processing_days is None and rows["3"].log_processing_days == pytest.approx(2.397895)
    assert not set(features.columns("full")) & set(features.LEAKAGE)
    assert len(features.columns("real")) == 6 and len(features.columns("full")) == 15
    with pytest.raises(ValueError):
        features.forbid_leakage(["page_count", "event_count"])
    with pytest.raises(ValueError):
        features.columns("half")


@pytest.fixture(scope="module")
def learnt(spark):
    """Durations that follow from the type and the amount, so there is something to learn."""
    n = 600
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("application_id"),
        F.when(F.col("id") % 2 == 0, "New credit").otherwise("Limit raise").alias("application_type"),
        F.when(F.col("id") % 5 != 0, "Car").alias("loan_goal"),
        (F.col("id") % 7 * 1000).cast("decimal(15,2)").alias("requested_amount"),
        F.expr("timestamp'2016-01-01' + make_dt_interval(cast(id % 28 as int))").alias("first_event_time"),
        F.lit(1).alias("event_count"), F.lit(None).cast("string").alias("status"),
    )
    c = rows.withColumn("last_event_time", F.expr(
        "first_event_time + make_dt_interval(cast(2 + 20 * (cast(application_id as int) % 2) + cast(application_id as int) % 7 as int))"))
    x = ext.generate(c)
    data = features.prepare(features.training_set(c, x))
    train, test = features.stratified_split(data, "is_sla_breach_median")
    model = ml.RiskModel("full", rounds=5).fit(train, "is_sla_breach_median", "log_processing_days")
    return c, x, train, test, model


def test_model_learns_and_repeats(learnt):
    _, _, train, test, model = learnt
    got = model.evaluate(test, "is_sla_breach_median", "processing_days")
    assert set(got) == {"roc_auc", "pr_auc", "f1_score", "precision", "recall", "mae_days", "rmse_days", "r2_score"}
    assert got["roc_auc"] > 0.9 and got["r2_score"] > 0.5
    again = ml.RiskModel("full", rounds=5).fit(train, "is_sla_breach_median", "log_processing_days")
    assert again.evaluate(test, "is_sla_breach_median", "processing_days") == got
    dummy = ml.dummy_predictions(test, train, "is_sla_breach_median", "processing_days", "mean")
    assert dummy.select("risk_class").distinct().count() == 1


def test_model_survives_saving_and_unseen_categories(spark, learnt, tmp_path):
    _, _, _, test, model = learnt
    path = model.save(str(tmp_path / "model"))
    loaded = ml.RiskModel.load(path)
    odd = test.withColumn("branch", F.lit("Nowhere")).withColumn("loan_goal", F.lit(None).cast("string"))
    for df in (test, odd):
        rows = lambda m: sorted(map(tuple, m.predict(df).select("application_id", *ml.RESULTS).collect()))
        assert rows(loaded) == rows(model)
    r = model.predict(odd).agg(F.min("risk_probability"), F.max("risk_probability"), F.min("predicted_processing_days")).first()
    assert 0 <= r[0] and r[1] <= 1 and r[2] >= 0
    with pytest.raises(FileNotFoundError):
        ml.RiskModel.load(str(tmp_path / "nothing"))
    with pytest.raises(TypeError):
        ml.RiskModel.load(str(tmp_path))


def test_training_job_learns_what_decides(spark, learnt, tmp_path):
    cases, extensions = learnt[:2]
    done = jobs.train(cases, extensions, str(tmp_path / "model"), rounds=3)
    assert done.metrics["roc_auc"] > 0.9
    train, _ = features.stratified_split(features.training_set(cases, extensions), "application_type")
    assert done.threshold == features.training_threshold(train)
    assert ml.RiskModel.load(str(tmp_path / "model")).is_fitted
    with pytest.raises(ValueError):
        jobs.train(cases.where("false"), extensions, str(tmp_path / "none"), rounds=1)


def test_evaluating_asks_for_the_shared_folder(learnt, monkeypatch):
    """A loaded model evaluates in a session that has not named a folder yet."""
    asked = []
    monkeypatch.setattr(ml, "shared_dir", lambda spark: asked.append(spark))
    learnt[4].evaluate(learnt[3], "is_sla_breach_median", "processing_days")
    assert asked


def test_unfitted_model_and_missing_columns(spark, learnt):
    test, model = learnt[3], learnt[4]
    for call in (lambda m: m.predict(test), lambda m: m.save("x"), lambda m: m.evaluate(test, "is_sla_breach_median", "processing_days")):
        with pytest.raises(RuntimeError, match="not fitted"):
            call(ml.RiskModel())
    with pytest.raises(ValueError, match="missing required"):
        model.predict(test.drop("branch"))


def test_cross_validation_and_ablation(learnt):
    _, _, train, test, _ = learnt
    cv = ml.RiskModel("real", rounds=2).cross_validate(train, "is_sla_breach_median", "processing_days", folds=2)
    assert set(cv) == {"cv_mean_roc_auc", "cv_mean_pr_auc", "cv_mean_f1_score", "cv_mean_mae_days"}
    assert cv["cv_mean_roc_auc"] > 0.9
    both = ml.ablation(train, test, "is_sla_breach_median", "log_processing_days", "processing_days", rounds=2)
    assert set(both) == {"real", "full", "delta"}


def test_scaling_ignores_missing_numbers(spark, learnt):
    rows = ml.inputs(learnt[3].withColumn("page_count", F.when(F.col("page_count") < 13, F.col("page_count"))), "full")
    scaled = ml.fit_preprocessing(rows, "full").transform(rows)
    mean, deviation = scaled.agg(F.avg("_s_page_count"), F.stddev_pop("_s_page_count")).first()
    assert mean == pytest.approx(0, abs=1e-9) and deviation == pytest.approx(1)
    assert scaled.where("_s_page_count IS NULL").count() == rows.where("page_count IS NULL").count() > 0


# ---------------------------------------------------------------- scoring
def test_skip_reasons(spark):
    rows = [("a", 1, 0.5, 1.0, 0), ("a", 1, 0.6, 1.0, 1), (" ", 1, 0.5, 1.0, 2), ("b", 2, 0.5, 1.0, 3),
            ("c", 1, 1.5, 1.0, 4), ("d", 1, 0.5, -1.0, 5), ("e", 0, 0.123456, 1.239, 6), ("f", 1, float("nan"), 1.0, 7)]
    df = spark.createDataFrame(rows, "application_id string, risk_class int, risk_probability double, "
                                     "predicted_processing_days double, i int")
    checked = scoring.with_reasons(df, " v1 ", "t", ["i"])
    skipped = sorted((r.application_id, r.reason.split(",")[0]) for r in scoring.skipped_rows(checked).collect())
    assert skipped == [
        ("", "Invalid application_id"), ("a", scoring.DUPLICATE), ("b", "risk_class must be 0 or 1"),
        ("c", "risk_probability must be between 0.0 and 1.0"), ("d", "predicted_processing_days must be nonnegative"),
        ("f", "risk_probability must be between 0.0 and 1.0"),
    ]
    valid = {r.application_id: r for r in scoring.valid_rows(checked).collect()}
    assert set(valid) == {"a", "e"} and valid["a"].model_version == "v1"
    assert (str(valid["e"].risk_probability), str(valid["e"].predicted_processing_days)) == ("0.1235", "1.24")
    with pytest.raises(ValueError):
        scoring.with_reasons(df, "", "t", ["i"])


def test_scoring_job_is_repeatable_and_keeps_versions(spark, learnt, tmp_path):
    c, x, _, _, model = learnt
    path = str(tmp_path / "predictions")
    dry = scoring.score_cases(c, x, model, "v1", path, dry_run=True)
    assert dry == (600, 0, 0) and scoring.read_predictions(spark, path).count() == 0
    assert scoring.score_cases(c, x, model, "v1", path) == (600, 600, 0)
    first = {r.application_id: r for r in scoring.read_predictions(spark, path).collect()}
    assert scoring.score_cases(c, x, model, "v2/beta", path, limit=10) == (10, 10, 0)
    assert scoring.score_cases(c, x, model, "v1", path) == (600, 600, 0)
    stored = scoring.read_predictions(spark, path)
    assert {r.model_version: r["count"] for r in stored.groupBy("model_version").count().collect()} == {"v1": 600, "v2/beta": 10}
    again = {r.application_id: r for r in stored.where("model_version = 'v1'").collect()}
    assert all(again[i].created_at == first[i].created_at and again[i].updated_at > first[i].updated_at for i in first)
    plan = stored.where("model_version = 'v1'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(model_version" in plan
    with pytest.raises(ValueError):
        scoring.score_cases(c, x, model, " ", path)


def test_lookups(spark, learnt):
    c, x, _, _, model = learnt
    one = scoring.predict_case(model, c, x, "7").first()
    assert one.application_id == "7" and one.sla_risk_label in ("High Risk", "Low Risk")
    for bad in ("", "  ", None, 5, "unknown"):
        with pytest.raises(ValueError):
            scoring.predict_case(model, c, x, bad)
    rows = scoring.predict_batch(model, c, x, ["7", "unknown", " ", "7", None]).collect()
    assert [r.status for r in rows] == ["SUCCESS", "ERROR", "ERROR", "SUCCESS", "ERROR"]
    assert rows[0].sla_breach_probability == one.sla_breach_probability
    assert rows[1].error == "Application ID 'unknown' not found in database."
    with pytest.raises(ValueError):
        scoring.predict_batch(model, c, x, None)
