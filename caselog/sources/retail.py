"""Case logs derived from retail order tables and from a click stream.

Order log: a case is an order, an event is one of its lines. User log: a case is a run
of days of one user, an event is one of their actions. Both give the engine whole
tables to work on where no event-log file is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.functions import expressions as E
from caselog.session import configure

# Activity of a line that was not returned, by part type.
OPEN_LINE_ACTIVITY = {
    "ECONOMY": "O_Created",
    "LARGE": "O_Sent (mail and online)",
    "MEDIUM": "O_Accepted",
    "PROMO": "O_Returned",
    "SMALL": "O_Refused",
    "STANDARD": "O_Cancelled",
}

# Model versions of the prediction fixture, share in tenths, scoring day.
FIXTURE_VERSIONS = (("v1.0", 9, "2024-01-01"), ("v2.0", 5, "2024-02-01"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _line_activity() -> Column:
    open_line = F
    for part_type, activity in OPEN_LINE_ACTIVITY.items():
        open_line = open_line.when(F.col("p_type") == part_type, activity)
    return (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("A_"), F.col("p_type")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("W_"), F.col("p_type")))
        .otherwise(open_line)
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    step = F.col("l_linenumber") % 4
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
        F.col("l_orderkey").cast("string").alias("application_id"),
        _line_activity().alias("activity"),
        F.col("l_shipdate").cast("timestamp").alias("event_timestamp"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey").cast("string")).alias("resource"),
        F.when(step == 0, "complete").when(step == 1, "suspend").when(step == 2, "withdraw")
        .alias("lifecycle_transition"),
        F.col("l_returnflag").alias("action"),
        F.when(F.col("l_linestatus") == "O", "Offer").otherwise("Application").alias("event_origin"),
    )


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_event_time"),
        F.max("l_shipdate").alias("last_event_time"),
        F.count(F.lit(1)).alias("event_count"),
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("application_id"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "New credit")
            .otherwise("Limit raise").alias("application_type"),
            F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).alias("loan_goal"),
            F.col("o_totalprice").cast("decimal(15,2)").alias("requested_amount"),
            F.col("first_event_time").cast("timestamp").alias("first_event_time"),
            F.col("last_event_time").cast("timestamp").alias("last_event_time"),
            F.coalesce(F.col("event_count"), F.lit(0)).cast("int").alias("event_count"),
            F.when(F.col("o_orderstatus") == "F", "complete").alias("status"),
        )
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    run = F.floor(day / (F.lit(1) + F.col("user_id") % 30))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat_ws("-", "user_id", run).alias("application_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.get_json_object("props", "$.k").alias("resource"),
        F.lit(None).cast("string").alias("lifecycle_transition"),
        F.lit(None).cast("string").alias("action"),
        F.lit(None).cast("string").alias("event_origin"),
    )


def user_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir).groupBy("application_id").agg(
        F.lit(None).cast("string").alias("application_type"),
        F.lit(None).cast("string").alias("loan_goal"),
        F.lit(None).cast("decimal(15,2)").alias("requested_amount"),
        F.min("event_timestamp").alias("first_event_time"),
        F.max("event_timestamp").alias("last_event_time"),
        F.count(F.lit(1)).cast("int").alias("event_count"),
        F.lit(None).cast("string").alias("status"),
    )


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions drawn from a hash of (version, case): some cases have none, one or two."""
    versions = F.array(*[
        F.struct(F.lit(v).alias("model_version"), F.lit(share).alias("share"),
                 F.to_timestamp(F.lit(day)).alias("scored_at"))
        for v, share, day in FIXTURE_VERSIONS
    ])
    case_id = F.col("o_orderkey").cast("string")
    h = E.hash_slice(F.sha2(F.concat_ws(":", F.lit("pred"), "v.model_version", "application_id"), 256), 1, 8)
    return (
        table(spark, sf_dir, "orders")
        .select(case_id.alias("application_id"), F.explode(versions).alias("v"))
        .withColumn("h", h)
        .where(F.col("h") % 10 < F.col("v.share"))
        .select(
            "application_id",
            F.col("v.model_version").alias("model_version"),
            F.lit("fixture").alias("model_type"),
            (F.col("h") % 10001 >= 5000).cast("smallint").alias("risk_class"),
            ((F.col("h") % 10001) / 10000).cast("decimal(6,4)").alias("risk_probability"),
            ((F.col("h") % 6000) / 100).cast("decimal(10,2)").alias("predicted_processing_days"),
            F.col("v.scored_at").alias("scored_at"),
        )
    )
