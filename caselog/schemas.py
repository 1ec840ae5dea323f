"""Table schemas of the case-log model."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_text, _int, _flag, _time = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

CASES = _table(
    application_id=_text,
    application_type=_text,
    loan_goal=_text,
    requested_amount=T.DecimalType(15, 2),
    first_event_time=_time,
    last_event_time=_time,
    event_count=_int,
    status=_text,
    event_origin=_text,
    created_at=_time,
    updated_at=_time,
)

EVENTS = _table(
    event_id=_text,
    application_id=_text,
    activity=_text,
    event_timestamp=_time,
    resource=_text,
    lifecycle_transition=_text,
    action=_text,
    event_origin=_text,
    created_at=_time,
)

OFFERS = _table(
    offer_id=_text,
    application_id=_text,
    offered_amount=T.DecimalType(15, 2),
    offered_cost=T.DecimalType(15, 2),
    credit_score=T.DecimalType(10, 2),
    interest_rate=T.DecimalType(5, 2),
    term_months=_int,
    created_at=_time,
)

EXTENSIONS = _table(
    application_id=_text,
    document_type=_text,
    page_count=_int,
    branch=_text,
    operator_team=_text,
    priority=_text,
    sla_target_hours=_int,
    region=_text,
    channel=_text,
    quality_score=T.DecimalType(5, 2),
    error_flag=_flag,
    rejection_flag=_flag,
    created_at=_time,
    updated_at=_time,
)

PREDICTIONS = _table(
    application_id=_text,
    model_version=_text,
    model_type=_text,
    risk_class=T.ShortType(),
    risk_probability=T.DecimalType(6, 4),
    predicted_processing_days=T.DecimalType(10, 2),
    scored_at=_time,
    created_at=_time,
    updated_at=_time,
)

DATA_LOADS = _table(
    load_id=_text,
    source_file=_text,
    load_type=_text,
    records_loaded=T.LongType(),
    load_status=_text,
    started_at=_time,
    completed_at=_time,
    error_message=_text,
)

TABLES = {
    "cases": CASES,
    "events": EVENTS,
    "offers": OFFERS,
    "extensions": EXTENSIONS,
    "predictions": PREDICTIONS,
    "data_loads": DATA_LOADS,
}
