"""Small frames for the tests."""

from datetime import datetime

CASE = ("application_id string, application_type string, loan_goal string, requested_amount decimal(15,2), "
        "first_event_time timestamp, last_event_time timestamp, event_count int, status string")
EVENT = ("event_id string, application_id string, activity string, event_timestamp timestamp, resource string, "
         "lifecycle_transition string, action string, event_origin string")
PREDICTION = ("application_id string, model_version string, model_type string, risk_class smallint, "
              "risk_probability decimal(6,4), predicted_processing_days decimal(10,2), scored_at timestamp")


def at(text):
    return datetime.fromisoformat(text)


def cases(spark, *rows):
    """(id, first, last, count) or with (type, goal, status) added."""
    full = []
    for r in rows:
        case_id, first, last, n, *rest = r
        kind, goal, status = (rest + [None, None, None])[:3]
        full.append((case_id, kind, goal, None, first and at(first), last and at(last), n, status))
    return spark.createDataFrame(full, CASE)


def events(spark, *rows):
    """(event, case, activity, time) or with (resource, transition) added."""
    full = []
    for r in rows:
        event_id, case_id, activity, time, *rest = r
        resource, step = (rest + [None, None])[:2]
        full.append((event_id, case_id, activity, time and at(time), resource, step, None, None))
    return spark.createDataFrame(full, EVENT)


def predictions(spark, *rows):
    from decimal import Decimal

    return spark.createDataFrame(
        [(c, v, "t", k, Decimal(str(p)), Decimal(str(d)), at(t)) for c, v, k, p, d, t in rows], PREDICTION
    )


def dicts(df):
    return [r.asDict() for r in df.collect()]
