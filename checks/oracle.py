"""The same results in plain SQL over the given tables, for the side-by-side check."""

from __future__ import annotations


def pct(n: str, d: str, digits: int = 2) -> str:
    return f"round(CAST({n} AS DOUBLE) * 100.0 / CAST({d} AS DOUBLE), {digits})"


def share(n: str, d: str) -> str:
    return f"coalesce(round_even(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100.0, 2), 0.0)"


def avg(total: str, n: str) -> str:
    return f"CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE)"


def kind(letter: str) -> str:
    return f"activity LIKE '{letter}_%'"


MICROS = "(epoch_us(last_event_time) - epoch_us(first_event_time))"
TYPE = f"""CASE WHEN {kind('W')} THEN 'Workflow' WHEN {kind('O')} THEN 'Offer'
  WHEN {kind('A')} THEN 'Application' ELSE 'Other' END"""
BUCKET = f"""CASE WHEN {MICROS} / 3.6e9 < 1 THEN '< 1 hour' WHEN {MICROS} / 3.6e9 < 24 THEN '1-24 hours'
  WHEN {MICROS} / 8.64e10 < 7 THEN '1-7 days' WHEN {MICROS} / 8.64e10 < 30 THEN '1-4 weeks' ELSE '> 4 weeks' END"""
RANK = """CASE bucket WHEN '< 1 hour' THEN 1 WHEN '1-24 hours' THEN 2 WHEN '1-7 days' THEN 3
  WHEN '1-4 weeks' THEN 4 ELSE 5 END"""
BAND = """CASE WHEN risk_probability >= 0.0 AND risk_probability < 0.2 THEN '0.0 - 0.2'
  WHEN risk_probability >= 0.2 AND risk_probability < 0.4 THEN '0.2 - 0.4'
  WHEN risk_probability >= 0.4 AND risk_probability < 0.6 THEN '0.4 - 0.6'
  WHEN risk_probability >= 0.6 AND risk_probability < 0.8 THEN '0.6 - 0.8'
  WHEN risk_probability >= 0.8 AND risk_probability <= 1.0 THEN '0.8 - 1.0' END"""
AVG_HOURS = f"round({avg(f'sum({MICROS})', f'count({MICROS})')} / 3.6e9, 2)"
AVG_DAYS = f"round({avg(f'sum({MICROS})', f'count({MICROS})')} / 8.64e10, 2)"
AVG_EVENTS = f"round({avg('sum(event_count)', 'count(event_count)')}, 1)"
AVG_AMOUNT = f"round({avg('sum(requested_amount)', 'count(requested_amount)')}, 2)"

EVENTS = """log_events AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id,
    CAST(l_orderkey AS VARCHAR) AS application_id,
    CASE l_returnflag WHEN 'A' THEN 'A_' || p_type WHEN 'R' THEN 'W_' || p_type ELSE
      CASE p_type WHEN 'ECONOMY' THEN 'O_Created' WHEN 'LARGE' THEN 'O_Sent (mail and online)'
        WHEN 'MEDIUM' THEN 'O_Accepted' WHEN 'PROMO' THEN 'O_Returned' WHEN 'SMALL' THEN 'O_Refused'
        WHEN 'STANDARD' THEN 'O_Cancelled' END END AS activity,
    l_shipdate AS event_timestamp,
    CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS resource,
    CASE l_linenumber % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'suspend' WHEN 2 THEN 'withdraw' END
      AS lifecycle_transition,
    l_returnflag AS action,
    CASE WHEN l_linestatus = 'O' THEN 'Offer' ELSE 'Application' END AS event_origin
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CASES = """log_cases AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS application_id,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'New credit' ELSE 'Limit raise' END AS application_type,
    CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS loan_goal,
    CAST(o_totalprice AS DECIMAL(15, 2)) AS requested_amount,
    first_event_time, last_event_time, CAST(coalesce(n, 0) AS INTEGER) AS event_count,
    CASE WHEN o_orderstatus = 'F' THEN 'complete' END AS status
  FROM orders
  LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_event_time, max(l_shipdate) AS last_event_time,
      count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey)"""

USER_EVENTS = """user_log AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
    concat_ws('-', user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // (1 + user_id % 30)) AS application_id,
    event_type AS activity, ts AS event_timestamp, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS resource
  FROM events)"""

USER_CASES = """user_cases AS (
  SELECT application_id, min(event_timestamp) AS first_event_time, max(event_timestamp) AS last_event_time,
    CAST(count(*) AS INTEGER) AS event_count FROM user_log GROUP BY application_id)"""

METRICS = f"""metrics AS (
  SELECT c.*, {MICROS} / 3.6e9 AS processing_hours, {MICROS} / 8.64e10 AS processing_days,
    coalesce(complete_count, 0) AS complete_count, coalesce(suspend_count, 0) AS suspend_count,
    coalesce(withdraw_count, 0) AS withdraw_count, coalesce(w, 0) AS workflow_activity_count,
    coalesce(o, 0) AS offer_activity_count, coalesce(a, 0) AS application_activity_count
  FROM log_cases c LEFT JOIN (
    SELECT application_id, count(*) FILTER (lifecycle_transition = 'complete') AS complete_count,
      count(*) FILTER (lifecycle_transition = 'suspend') AS suspend_count,
      count(*) FILTER (lifecycle_transition = 'withdraw') AS withdraw_count,
      count(*) FILTER ({kind('W')}) AS w, count(*) FILTER ({kind('O')}) AS o, count(*) FILTER ({kind('A')}) AS a
    FROM log_events GROUP BY application_id) USING (application_id))"""

PREDICTIONS = """predictions AS (
  SELECT application_id, model_version, 'fixture' AS model_type,
    CAST(CASE WHEN h % 10001 >= 5000 THEN 1 ELSE 0 END AS SMALLINT) AS risk_class,
    CAST((h % 10001) / 10000.0 AS DECIMAL(6, 4)) AS risk_probability,
    CAST((h % 6000) / 100.0 AS DECIMAL(10, 2)) AS predicted_processing_days, scored_at
  FROM (SELECT application_id, v.*,
      CAST('0x' || substr(sha256('pred:' || model_version || ':' || application_id), 1, 8) AS BIGINT) AS h
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS application_id FROM orders),
      (VALUES ('v1.0', 9, TIMESTAMP '2024-01-01'), ('v2.0', 5, TIMESTAMP '2024-02-01')) AS v(model_version, share, scored_at))
  WHERE h % 10 < share)"""

LATEST = """latest AS (
  SELECT * EXCLUDE (nth_version) FROM (SELECT *, row_number() OVER (PARTITION BY application_id
    ORDER BY scored_at DESC, model_version DESC) AS nth_version FROM predictions) WHERE nth_version = 1)"""

CTES = {
    "log_events": (EVENTS, ()),
    "log_cases": (CASES, ()),
    "user_log": (USER_EVENTS, ()),
    "user_cases": (USER_CASES, ("user_log",)),
    "metrics": (METRICS, ("log_cases", "log_events")),
    "predictions": (PREDICTIONS, ()),
    "latest": (LATEST, ("predictions",)),
}


def define(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (f"{name} AS ({sql})", needs)


def sql(body: str, *needs: str) -> str:
    """The query with the CTEs it needs, in dependency order."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for inner in CTES[name][1]:
            add(inner)
        if name not in chosen:
            chosen.append(name)

    for name in needs:
        add(name)
    return (f"WITH {', '.join(CTES[n][0] for n in chosen)} " if chosen else "") + body.strip()


# ---------------------------------------------------------------- views
DAILY = """SELECT CAST(first_event_time AS DATE) AS date, count(*) AS applications_started,
  CAST(sum(event_count) AS BIGINT) AS total_events FROM log_cases GROUP BY 1"""
ACTIVITY = f"""SELECT activity, count(*) AS event_count, count(DISTINCT application_id) AS unique_applications,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage_of_total, {TYPE} AS activity_type,
  {pct("count(*) FILTER (lifecycle_transition = 'complete')", 'count(*)')} AS complete_pct,
  {pct("count(*) FILTER (lifecycle_transition = 'suspend')", 'count(*)')} AS suspend_pct,
  {pct("count(*) FILTER (lifecycle_transition = 'withdraw')", 'count(*)')} AS withdraw_pct
  FROM log_events GROUP BY activity"""
RESOURCE = f"""SELECT resource, count(*) AS event_count, count(DISTINCT application_id) AS applications_handled,
  {pct('count(*)', '(SELECT count(*) FROM log_events WHERE resource IS NOT NULL)')} AS workload_percentage,
  count(DISTINCT activity) AS unique_activities, min(event_timestamp) AS first_event, max(event_timestamp) AS last_event
  FROM log_events WHERE resource IS NOT NULL GROUP BY resource"""
BY_TYPE = f"""SELECT application_type, count(*) AS application_count, {AVG_EVENTS} AS avg_events_per_application,
  {AVG_HOURS} AS avg_processing_hours, min(first_event_time) AS earliest_application,
  max(last_event_time) AS latest_application, count(DISTINCT loan_goal) AS unique_loan_goals,
  {AVG_AMOUNT} AS avg_requested_amount
  FROM log_cases WHERE application_type IS NOT NULL GROUP BY application_type"""
GOALS = f"""SELECT loan_goal, count(*) AS application_count, {AVG_EVENTS} AS avg_events,
  {AVG_HOURS} AS avg_processing_hours, {AVG_AMOUNT} AS avg_requested_amount,
  min(first_event_time) AS first_date, max(last_event_time) AS last_date
  FROM log_cases WHERE loan_goal IS NOT NULL GROUP BY loan_goal"""
LIFECYCLE = f"""SELECT lifecycle_transition, count(*) AS event_count,
  count(DISTINCT application_id) AS applications_affected,
  {pct('count(*)', '(SELECT count(*) FROM log_events)')} AS percentage,
  {pct(f"count(*) FILTER ({kind('W')})", 'count(*)')} AS workflow_pct,
  {pct(f"count(*) FILTER ({kind('O')})", 'count(*)')} AS offer_pct,
  {pct(f"count(*) FILTER ({kind('A')})", 'count(*)')} AS application_pct
  FROM log_events WHERE lifecycle_transition IS NOT NULL GROUP BY lifecycle_transition"""
ORIGIN = f"""SELECT event_origin, count(*) AS event_count, count(DISTINCT application_id) AS applications_affected,
  count(DISTINCT activity) AS unique_activities,
  {pct('count(*)', '(SELECT count(*) FROM log_events)')} AS percentage
  FROM log_events WHERE event_origin IS NOT NULL GROUP BY event_origin"""
MONTHLY = f"""SELECT CAST(year(first_event_time) AS INTEGER) AS year, CAST(month(first_event_time) AS INTEGER) AS month,
  strftime(date_trunc('month', first_event_time), '%Y-%m') AS year_month, count(*) AS applications,
  CAST(sum(event_count) AS BIGINT) AS total_events, {AVG_EVENTS} AS avg_events_per_app,
  {AVG_DAYS} AS avg_processing_days, count(DISTINCT application_type) AS application_types,
  count(DISTINCT loan_goal) AS loan_goals
  FROM log_cases GROUP BY year(first_event_time), month(first_event_time), date_trunc('month', first_event_time)"""
BUCKETS = f"""SELECT bucket, count(*) AS application_count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage,
  {AVG_EVENTS} AS avg_events FROM (SELECT *, {BUCKET} AS bucket FROM {{cases}}) GROUP BY bucket"""

define("v_activity", ACTIVITY, "log_events")
define("v_resource", RESOURCE, "log_events")
define("v_type", BY_TYPE, "log_cases")
define("v_goals", GOALS, "log_cases")
define("v_lifecycle", LIFECYCLE, "log_events")
define("v_monthly", MONTHLY, "log_cases")
define("v_buckets", BUCKETS.format(cases="log_cases"), "log_cases")
define("v_user_buckets", BUCKETS.format(cases="user_cases"), "user_cases")

RISK_COLUMNS = """c.application_id, application_type, loan_goal, requested_amount, first_event_time, last_event_time,
  status AS application_status, processing_hours AS actual_processing_hours,
  processing_days AS actual_processing_days, event_count, model_version, model_type,
  risk_class AS predicted_risk_class,
  CASE WHEN risk_class = 1 THEN 'High Risk' ELSE 'Low Risk' END AS predicted_risk_label,
  risk_probability AS predicted_risk_probability, predicted_processing_days,
  CASE WHEN status IN ('complete', 'COMPLETED', 'COMPLETE') OR complete_count > 0
    THEN round(processing_days - CAST(predicted_processing_days AS DOUBLE), 2) END AS processing_days_error, scored_at"""
define("v_risk", f"SELECT {RISK_COLUMNS} FROM metrics c JOIN predictions p USING (application_id)", "metrics", "predictions")
define("v_risk_latest", f"SELECT {RISK_COLUMNS} FROM metrics c JOIN latest p USING (application_id)", "metrics", "latest")


def _type_metrics() -> str:
    return """SELECT application_type, application_count, avg_events_per_application, avg_processing_hours,
      avg_requested_amount FROM v_type"""


def _duration(cases: str, view: str) -> str:
    return f"""SELECT coalesce({avg(f'sum({MICROS})', f'count({MICROS})')} / 3.6e9, 0.0) AS avg_processing_hours,
      coalesce({avg(f'sum({MICROS})', f'count({MICROS})')} / 8.64e10, 0.0) AS avg_processing_days,
      (SELECT bucket FROM (SELECT bucket, sum(percentage) OVER (ORDER BY {RANK}) AS running FROM {view})
        WHERE running >= 50 ORDER BY {RANK} LIMIT 1) AS median_bucket FROM {cases}"""


def _error(view: str, version: str, where: str = "") -> str:
    e = "CAST(processing_days_error AS DECIMAL(12, 2))"
    return f"""SELECT count({e}) AS evaluated_count, round_even({avg(f'sum(abs({e}))', 'count(*)')}, 2) AS mae_days,
      round_even(sqrt({avg(f'sum({e} * {e})', 'count(*)')}), 2) AS rmse_days,
      round_even({avg(f'sum({e})', 'count(*)')}, 2) AS mean_error_days, {version} AS model_version
      FROM {view} WHERE actual_processing_days IS NOT NULL AND processing_days_error IS NOT NULL {where}"""


def _bands(view: str, version: str, where: str = "") -> str:
    return f"""SELECT band AS probability_band, coalesce(n, 0) AS count,
      {share('n', 'sum(n) OVER ()')} AS percentage, {version} AS model_version
      FROM (VALUES ('0.0 - 0.2'), ('0.2 - 0.4'), ('0.4 - 0.6'), ('0.6 - 0.8'), ('0.8 - 1.0')) AS d(band)
      LEFT JOIN (SELECT {BAND} AS b, count(*) AS n FROM {view} {where} GROUP BY 1) ON band = b"""


def _distribution(view: str, version: str, where: str = "") -> str:
    return f"""SELECT CAST(risk_class AS INTEGER) AS predicted_risk_class,
      CASE WHEN risk_class = 1 THEN 'High Risk' ELSE 'Low Risk' END AS predicted_risk_label, count(*) AS count,
      {share('count(*)', 'sum(count(*)) OVER ()')} AS percentage, {version} AS model_version
      FROM {view} {where} GROUP BY risk_class"""


def _times(view: str, version: str, where: str = "") -> str:
    d = "predicted_processing_days"
    return f"""SELECT count(*) AS count, round_even({avg(f'sum({d})', 'count(*)')}, 2) AS mean_days,
      round_even(CAST(quantile_cont(CAST({d} AS DOUBLE), 0.5) AS DOUBLE), 2) AS median_days,
      CAST(min({d}) AS DOUBLE) AS min_days, CAST(max({d}) AS DOUBLE) AS max_days, {version} AS model_version
      FROM {view} {where}"""


def _coverage(version: str, where: str = "") -> str:
    return f"""SELECT n AS total_applications, s AS applications_with_predictions,
      greatest(n - s, 0) AS applications_without_predictions, {share('s', 'n')} AS coverage_percentage,
      {version} AS model_version
      FROM (SELECT count(*) AS n FROM log_cases), (SELECT count(DISTINCT application_id) AS s FROM predictions {where})"""


def _high_risk(source: str, p: float, limit: int, where: str = "") -> str:
    return f"""SELECT application_id, application_type, loan_goal,
      coalesce(CAST(requested_amount AS DOUBLE), 0.0) AS requested_amount, status AS application_status,
      CAST(risk_class AS INTEGER) AS predicted_risk_class,
      CASE WHEN risk_class = 1 THEN 'High Risk' ELSE 'Low Risk' END AS predicted_risk_label,
      CAST(risk_probability AS DOUBLE) AS predicted_risk_probability,
      CAST(predicted_processing_days AS DOUBLE) AS predicted_processing_days, model_version,
      strftime(scored_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS scored_at
      FROM {source} JOIN log_cases USING (application_id)
      WHERE CAST(risk_probability AS DOUBLE) >= {p} {where}
      ORDER BY predicted_risk_probability DESC, application_id LIMIT {limit}"""


NO_VERSION = "CAST(NULL AS VARCHAR)"
V1 = "WHERE model_version = 'v1.0'"

# ---------------------------------------------------------------- extensions
_DRAW = "CAST('0x' || substr(h, {start}, 6) AS BIGINT)"


def _draw(i: int) -> str:
    return _DRAW.format(start=1 + 6 * i)


def _choice(i: int, *domain: str) -> str:
    listed = ", ".join(f"'{v}'" for v in domain)
    return f"list_extract([{listed}], CAST({_draw(i)} * {len(domain)} // 16777216 AS INTEGER) + 1)"


def _below(i: int, percent: int) -> str:
    return f"({_draw(i)} * 100 < {percent} * 16777216)"


PRIORITY = f"CASE WHEN {_below(0, 25)} THEN 'low' WHEN {_below(0, 75)} THEN 'normal' WHEN {_below(0, 95)} THEN 'high' ELSE 'urgent' END"
define("extensions", f"""SELECT application_id,
    {_choice(1, 'Mortgage Application', 'Personal Loan Request', 'Proof of Income', 'Identity Verification', 'Tax Return')} AS document_type,
    CAST({_draw(2)} * 25 // 16777216 AS INTEGER) + 1 AS page_count,
    {_choice(3, 'Branch North', 'Branch South', 'Branch East', 'Branch West', 'Branch Central', 'Branch Metro', 'Branch Regional', 'Branch Harbour', 'Branch Valley', 'Branch Highland')} AS branch,
    {_choice(4, 'Team Alpha', 'Team Beta', 'Team Gamma', 'Team Delta', 'FastTrack Ops')} AS operator_team,
    {PRIORITY} AS priority,
    CASE {PRIORITY} WHEN 'low' THEN 72 WHEN 'normal' THEN 48 WHEN 'high' THEN 24 ELSE 12 END AS sla_target_hours,
    {_choice(5, 'North', 'South', 'East', 'West', 'Central')} AS region,
    {_choice(6, 'Online Portal', 'Mobile App', 'In-Person Branch', 'Partner Referral', 'Mail/Post')} AS channel,
    CAST(round(65.0 + CAST({_draw(7)} AS DOUBLE) * 35.0 / 16777216, 2) AS DECIMAL(5, 2)) AS quality_score,
    {_below(8, 8)} AS error_flag, {_below(9, 5)} AS rejection_flag, 'synthetic' AS lineage_tag
  FROM (SELECT application_id, sha256('42:' || application_id) AS h FROM log_cases)""", "log_cases")


# ---------------------------------------------------------------- quality
define("rough_traces", """SELECT o_orderkey AS trace_pos, CASE WHEN o_orderpriority = '1-URGENT' THEN ''
    ELSE concat_ws('-', o_custkey, strftime(o_orderdate, '%Y%m')) END AS document_id FROM orders""")
define("rough_events", """SELECT trace_pos, event_pos, event_id, activity, raw_time, document_id,
    CASE WHEN raw_time NOT IN ('', 'not-a-date') THEN l_shipdate END AS parsed
  FROM (SELECT l_orderkey AS trace_pos, l_shipdate,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax) AS INTEGER) AS event_pos,
      CASE WHEN l_discount = 0 THEN '' ELSE concat_ws('-', l_orderkey, l_linenumber) END AS event_id,
      CASE WHEN l_tax = 0 THEN ' ' ELSE l_returnflag END AS activity,
      CASE WHEN l_quantity = 1 THEN '' WHEN l_quantity = 2 THEN 'not-a-date'
        ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS raw_time
    FROM lineitem) JOIN rough_traces USING (trace_pos)""", "rough_traces")
define("issues", """SELECT rule, CASE WHEN rule IN ('missing_event_id', 'duplicate_event_id', 'non_monotonic_event_time')
      THEN 'warning' ELSE 'error' END AS severity,
    CASE WHEN document_id = '' THEN '<missing>' ELSE document_id END AS document_id, detail, trace_pos, event_pos
  FROM (
    SELECT 'missing_document_id' AS rule, document_id, 'Trace concept:name is blank.' AS detail, trace_pos,
      CAST(NULL AS INTEGER) AS event_pos FROM rough_traces WHERE document_id = ''
    UNION ALL SELECT 'duplicate_document', document_id, 'Trace concept:name repeats.', trace_pos, NULL
      FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY trace_pos) AS nth FROM rough_traces
        WHERE document_id <> '') WHERE nth > 1
    UNION ALL SELECT 'orphan_event', document_id, 'Event belongs to a trace without an identifier.', trace_pos, event_pos
      FROM rough_events WHERE document_id = ''
    UNION ALL SELECT 'missing_event_id', document_id, 'EventID is blank.', trace_pos, event_pos
      FROM rough_events WHERE event_id = ''
    UNION ALL SELECT 'duplicate_event_id', document_id, 'Repeated EventID: ' || event_id, trace_pos, event_pos
      FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY trace_pos, event_pos) AS nth FROM rough_events
        WHERE event_id <> '') WHERE nth > 1
    UNION ALL SELECT 'missing_activity', document_id, 'Event concept:name is blank.', trace_pos, event_pos
      FROM rough_events WHERE trim(activity) = ''
    UNION ALL SELECT 'missing_timestamp', document_id, 'time:timestamp is blank.', trace_pos, event_pos
      FROM rough_events WHERE raw_time = ''
    UNION ALL SELECT 'invalid_timestamp', document_id, 'Unparseable timestamp: ' || raw_time, trace_pos, event_pos
      FROM rough_events WHERE raw_time <> '' AND parsed IS NULL
    UNION ALL SELECT 'non_monotonic_event_time', document_id, 'Event time precedes prior event time.', trace_pos, event_pos
      FROM (SELECT *, lag(parsed) OVER (PARTITION BY trace_pos ORDER BY event_pos) AS previous FROM rough_events
        WHERE parsed IS NOT NULL) WHERE parsed < previous)""", "rough_traces", "rough_events")
CATALOG = """(VALUES ('missing_document_id', 'error'), ('duplicate_document', 'error'), ('orphan_event', 'error'),
  ('missing_event_id', 'warning'), ('duplicate_event_id', 'warning'), ('missing_timestamp', 'error'),
  ('invalid_timestamp', 'error'), ('missing_activity', 'error'), ('non_monotonic_event_time', 'warning'),
  ('impossible_processing_duration', 'error'), ('unavailable_document_extension_fields', 'info'),
  ('sla_consistency_not_evaluable', 'info')) AS c(rule, severity)"""
define("quarantine", """SELECT document_id, 'quarantine_for_review' AS decision,
    string_agg(DISTINCT rule, ';' ORDER BY rule) AS rules, trace_pos
  FROM issues WHERE severity = 'error' GROUP BY trace_pos, document_id""", "issues")


# ---------------------------------------------------------------- features, metrics, scoring
define("new_credit", """SELECT e.* FROM extensions e JOIN log_cases USING (application_id)
  WHERE application_type = 'New credit'""", "extensions", "log_cases")
PARTS = """CAST(hour(first_event_time) AS INTEGER) AS submission_hour,
  CAST(isodow(first_event_time) - 1 AS INTEGER) AS submission_day_of_week,
  CAST(month(first_event_time) AS INTEGER) AS submission_month"""
WEEKEND = "CASE WHEN isodow(first_event_time) >= 6 THEN 1 WHEN first_event_time IS NOT NULL THEN 0 END AS is_weekend"
DAYS_EXPR = f"({MICROS} / 8.64e10)"


def _case_features(join: str, page: str, quality: str, sla: str) -> str:
    return f"""SELECT application_id, application_type, loan_goal,
      CAST(coalesce(requested_amount, 0) AS DOUBLE) AS requested_amount, first_event_time, {PARTS}, {WEEKEND},
      document_type, {page} AS page_count, branch, operator_team, priority, {sla} AS sla_target_hours, region, channel,
      CAST({quality} AS DOUBLE) AS quality_score
      FROM log_cases {join} JOIN new_credit USING (application_id)"""


def _ranked(k: str) -> str:
    return f"""SELECT application_id, application_type AS label, {k} FROM (SELECT *, row_number() OVER (PARTITION BY application_type
      ORDER BY CAST('0x' || substr(sha256('42:' || application_id), 1, 15) AS BIGINT), application_id) AS nth,
      count(*) OVER (PARTITION BY application_type) AS size FROM log_cases)"""


#: What a model has to learn where ten days for a new credit, two for others, decide all.
RISK = "CASE WHEN application_type = 'New credit' THEN 1 ELSE 0 END"
TWO_OR_TEN = "CAST(CASE WHEN application_type = 'New credit' THEN 10 ELSE 2 END AS DOUBLE)"
PERFECT = """SELECT 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS pr_auc, 1.0::DOUBLE AS f1_score, 1.0::DOUBLE AS precision,
  1.0::DOUBLE AS recall, 0.0::DOUBLE AS mae_days, 0.0::DOUBLE AS rmse_days, 1.0::DOUBLE AS r2_score"""
HELD_OUT = f"""SELECT application_id, {RISK.replace('application_type', 'label')} AS risk_class,
  {TWO_OR_TEN.replace('application_type', 'label')} AS predicted_processing_days
  FROM ({_ranked("nth <= round(size * 0.2) AS held_out")}) WHERE held_out"""

define("truth", f"""SELECT application_id, {DAYS_EXPR} AS y, CASE WHEN {DAYS_EXPR} > 1000 THEN 1 ELSE 0 END AS label,
    risk_class, CAST(risk_probability AS DOUBLE) AS s, CAST(predicted_processing_days AS DOUBLE) AS f
  FROM log_cases JOIN predictions USING (application_id)
  WHERE model_version = 'v1.0' AND first_event_time IS NOT NULL""", "log_cases", "predictions")
define("score_groups", """SELECT s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM truth GROUP BY s""", "truth")
define("running", """SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp
  FROM score_groups""", "score_groups")
define("confusion", """SELECT CAST(count(*) FILTER (label = 1 AND risk_class = 1) AS DOUBLE) AS tp,
    count(*) FILTER (label = 0 AND risk_class = 1) AS fp, count(*) FILTER (label = 1 AND risk_class = 0) AS fn
  FROM truth""", "truth")
METRICS_SQL = """SELECT (SELECT round_even(sum(n * (tp - p / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 4) FROM running) AS roc_auc,
    (SELECT round_even(sum(CAST(p AS DOUBLE) * tp / (tp + fp)) / sum(p), 4) FROM running) AS pr_auc,
    (SELECT round_even(2 * tp / (2 * tp + fp + fn), 4) FROM confusion) AS f1_score,
    (SELECT round_even(tp / (tp + fp), 4) FROM confusion) AS precision, (SELECT round_even(tp / (tp + fn), 4) FROM confusion) AS recall,
    (SELECT round_even(avg(abs(y - f)), 4) FROM truth) AS mae_days,
    (SELECT round_even(sqrt(avg((y - f) * (y - f))), 4) FROM truth) AS rmse_days,
    (SELECT round_even(1 - avg((y - f) * (y - f)) / var_pop(y), 4) FROM truth) AS r2_score"""


def oracle_sql() -> dict[str, str]:
    user_cases = "user_cases"
    q = {
        "b01_durations": sql(f"""SELECT application_id, {MICROS} / 3.6e9 AS processing_hours,
          {MICROS} / 8.64e10 AS processing_days FROM user_cases""", user_cases),
        "b02_activity_class": sql(f"SELECT {TYPE} AS activity_type, count(*) AS events FROM log_events GROUP BY 1", "log_events"),
        "b14_calendar": sql("""SELECT application_id, CAST(first_event_time AS DATE) AS first_date,
          CAST(year(first_event_time) AS INTEGER) AS first_year, CAST(month(first_event_time) AS INTEGER) AS first_month,
          CAST(week(first_event_time) AS INTEGER) AS first_week FROM log_cases""", "log_cases"),
        "c07_orphans": sql("""SELECT activity, count(*) AS orphans FROM log_events e WHERE NOT EXISTS (
          SELECT 1 FROM log_cases c WHERE c.application_id = e.application_id AND c.application_type = 'New credit') GROUP BY activity""", "log_events", "log_cases"),
        "d01_application_metrics": sql("""SELECT application_id, application_type, loan_goal, requested_amount, event_count,
          first_event_time, last_event_time, processing_hours, processing_days, complete_count, suspend_count,
          withdraw_count, workflow_activity_count, offer_activity_count, application_activity_count,
          CAST(first_event_time AS DATE) AS first_date, CAST(year(first_event_time) AS INTEGER) AS first_year,
          CAST(month(first_event_time) AS INTEGER) AS first_month, CAST(week(first_event_time) AS INTEGER) AS first_week
          FROM metrics""", "metrics"),
        "d02_daily_throughput": sql(DAILY, "log_cases"),
        "d03_activity_summary": sql(ACTIVITY, "log_events"),
        "d04_resource_workload": sql(RESOURCE, "log_events"),
        "d05_application_type_metrics": sql(BY_TYPE, "log_cases"),
        "d06_loan_goal_metrics": sql(GOALS, "log_cases"),
        "d07_lifecycle_transition_metrics": sql(LIFECYCLE, "log_events"),
        "d08_event_origin_metrics": sql(ORIGIN, "log_events"),
        "d09_monthly_summary": sql(MONTHLY, "log_cases"),
        "d10_weekly_summary": sql("""SELECT CAST(year(first_event_time) AS INTEGER) AS year,
          CAST(week(first_event_time) AS INTEGER) AS week, CAST(date_trunc('week', first_event_time) AS TIMESTAMP) AS week_start,
          count(DISTINCT application_id) AS applications, CAST(sum(event_count) AS BIGINT) AS events
          FROM log_cases GROUP BY 1, 2, 3""", "log_cases"),
        "d11_event_sequence": sql("""SELECT event_id, application_id, activity, event_timestamp, resource,
          lifecycle_transition, event_origin, row_number() OVER w AS event_sequence, lead(activity) OVER w AS next_activity,
          lag(activity) OVER w AS prev_activity,
          (epoch_us(lead(event_timestamp) OVER w) - epoch_us(event_timestamp)) / 1e6 AS seconds_to_next
          FROM log_events WINDOW w AS (PARTITION BY application_id ORDER BY event_timestamp, event_id)""", "log_events"),
        "d12_processing_time_buckets": sql("SELECT * FROM v_buckets", "v_buckets"),
        "d12_processing_time_buckets_users": sql("SELECT * FROM v_user_buckets", "v_user_buckets"),
        "d13_offer_analysis": sql(f"""SELECT CASE WHEN activity IN ('O_Created', 'O_Create Offer') THEN 'Created'
          WHEN activity IN ('O_Sent (mail and online)', 'O_Sent (online only)') THEN 'Sent'
          WHEN activity = 'O_Accepted' THEN 'Accepted' WHEN activity = 'O_Returned' THEN 'Returned'
          WHEN activity = 'O_Refused' THEN 'Refused' WHEN activity = 'O_Cancelled' THEN 'Cancelled' ELSE 'Other' END AS offer_status,
          count(*) AS event_count, count(DISTINCT application_id) AS applications
          FROM log_events WHERE {kind('O')} GROUP BY 1""", "log_events"),
        "d14_mv_activity_summary": sql("""SELECT activity, event_count, unique_applications, percentage_of_total,
          activity_type FROM v_activity""", "v_activity"),
        "d15_mv_resource_workload": sql("""SELECT resource, event_count, applications_handled, workload_percentage,
          unique_activities FROM v_resource""", "v_resource"),
        "d16_mv_monthly_summary": sql("SELECT * EXCLUDE (application_types, loan_goals) FROM v_monthly", "v_monthly"),
        "d17_mv_application_type_summary": sql(_type_metrics(), "v_type"),
        "d18_predictive_sla_risk": sql("SELECT * FROM v_risk", "v_risk"),
        "d19_predictive_sla_risk_latest": sql("SELECT * FROM v_risk_latest", "v_risk_latest"),
        "j01_total_applications": sql("SELECT count(*) AS total_applications FROM log_cases", "log_cases"),
        "j02_total_events": sql("SELECT count(*) AS total_events FROM log_events", "log_events"),
        "j03_application_volume_by_type": sql(_type_metrics(), "v_type"),
        "j04_volume_monthly": sql("""SELECT year_month, applications, total_events,
          coalesce(avg_events_per_app, 0.0) AS avg_events_per_app FROM v_monthly""", "v_monthly"),
        "j04_volume_monthly_range": sql("""SELECT year_month, applications, total_events, avg_events_per_app FROM v_monthly
          WHERE year_month >= '1996-03' AND year_month <= '1997-09'""", "v_monthly"),
        "j04_volume_daily": sql(DAILY, "log_cases"),
        "j04_volume_daily_range": sql(f"""SELECT * FROM ({DAILY})
          WHERE date >= DATE '1996-03-15' AND date <= DATE '1997-09-20'""", "log_cases"),
        "j05_event_volume": sql("""SELECT year_month, total_events, coalesce(avg_events_per_app, 0.0) AS avg_events_per_app
          FROM v_monthly""", "v_monthly"),
        "j06_processing_duration_metrics": sql(_duration("log_cases", "v_buckets"), "v_buckets"),
        "j06_processing_duration_metrics_users": sql(_duration("user_cases", "v_user_buckets"), "v_user_buckets"),
        "j07_processing_time_distribution": sql("SELECT * FROM v_user_buckets", "v_user_buckets"),
        "j08_activity_summary": sql("SELECT * FROM v_activity", "v_activity"),
        "j09_resource_workload": sql("SELECT * EXCLUDE (first_event, last_event) FROM v_resource", "v_resource"),
        "j09_resource_workload_top": sql("""SELECT * EXCLUDE (first_event, last_event) FROM v_resource
          ORDER BY event_count DESC, resource LIMIT 10""", "v_resource"),
        "j10_lifecycle_outcome_summary": sql("SELECT * FROM v_lifecycle", "v_lifecycle"),
        "j11_loan_goal_summary": sql("SELECT * FROM v_goals", "v_goals"),
        "j12_application_processing_metrics": sql("""SELECT application_id, application_type, loan_goal,
          coalesce(CAST(requested_amount AS DOUBLE), 0.0) AS requested_amount, event_count, first_event_time, last_event_time,
          coalesce(processing_hours, 0.0) AS processing_hours, coalesce(processing_days, 0.0) AS processing_days,
          complete_count, suspend_count, withdraw_count FROM metrics""", "metrics"),
        "j12_application_processing_metrics_top": sql("""SELECT application_id, application_type, loan_goal,
          coalesce(CAST(requested_amount AS DOUBLE), 0.0) AS requested_amount, event_count, first_event_time, last_event_time,
          processing_hours, processing_days, complete_count, suspend_count, withdraw_count
          FROM metrics ORDER BY processing_hours DESC NULLS LAST, application_id LIMIT 100""", "metrics"),
        "j13_executive_summary": sql(f"""SELECT (SELECT count(*) FROM log_cases) AS total_applications,
          (SELECT count(*) FROM log_events) AS total_events,
          (SELECT {avg('sum(event_count)', 'count(event_count)')} FROM log_cases) AS avg_events_per_app,
          (SELECT {avg(f'sum({MICROS})', f'count({MICROS})')} / 8.64e10 FROM log_cases) AS avg_processing_days,
          (SELECT count(*) FROM (SELECT DISTINCT activity FROM log_events)) AS distinct_activities,
          (SELECT count(DISTINCT resource) FROM log_events) AS distinct_resources""", "log_cases", "log_events"),
        "j13_executive_summary_types": sql("""SELECT application_type AS type, count(*) AS count FROM log_cases
          WHERE application_type IS NOT NULL GROUP BY 1""", "log_cases"),
        "j14_extension_metrics": sql(f"""SELECT count(*) AS total_records,
          {avg('sum(quality_score)', 'count(quality_score)')} AS avg_quality_score FROM extensions""", "extensions"),
        "j14_extension_priorities": sql("SELECT priority, count(*) AS count FROM extensions GROUP BY 1", "extensions"),
        "j14_extension_branches": sql("""SELECT branch, count(*) AS count FROM extensions GROUP BY 1
          ORDER BY count(*) DESC, branch LIMIT 5""", "extensions"),
        "j15_activity_kpis": sql(f"""SELECT {pct('(SELECT sum(event_count) FROM (SELECT event_count FROM v_activity ORDER BY event_count DESC, activity LIMIT 5))', 'sum(event_count)')} AS activity_concentration_pct,
          {pct("sum(event_count) FILTER (activity_type = 'Workflow')", 'sum(event_count)')} AS workflow_activity_pct,
          {pct("sum(event_count) FILTER (activity_type = 'Offer')", 'sum(event_count)')} AS offer_activity_pct
          FROM v_activity""", "v_activity"),
        "j16_resource_kpis": sql(f"""SELECT max(workload_percentage) AS max_workload_pct,
          round(stddev_samp(event_count), 4) AS workload_stddev, count(*) AS active_resources,
          {pct('(SELECT sum(event_count) FROM (SELECT event_count FROM v_resource ORDER BY event_count DESC, resource LIMIT 5))', '(SELECT count(*) FROM log_events)')} AS top5_pct
          FROM v_resource""", "v_resource", "log_events"),
        "j17_outcome_kpis": sql(f"""SELECT {pct("max(applications_affected) FILTER (lifecycle_transition = 'complete')", '(SELECT count(*) FROM log_cases)')} AS completion_rate,
          {pct("max(applications_affected) FILTER (lifecycle_transition = 'suspend')", '(SELECT count(*) FROM log_cases)')} AS suspension_rate,
          {pct("max(applications_affected) FILTER (lifecycle_transition = 'withdraw')", '(SELECT count(*) FROM log_cases)')} AS withdrawal_rate
          FROM v_lifecycle""", "v_lifecycle", "log_cases"),
        "j18_activity_type_rollup": sql(f"""SELECT activity_type, count(*) AS activities,
          CAST(sum(event_count) AS BIGINT) AS total_events, CAST(sum(unique_applications) AS BIGINT) AS total_apps,
          {pct('sum(event_count)', 'sum(sum(event_count)) OVER ()')} AS pct_events FROM v_activity GROUP BY 1""", "v_activity"),
        "f08_goal_duration_extremes": sql("""SELECT loan_goal, avg_processing_hours, application_count, side FROM (
            (SELECT *, 'longest' AS side FROM v_goals ORDER BY avg_processing_hours DESC, loan_goal LIMIT 5)
            UNION ALL (SELECT *, 'shortest' AS side FROM v_goals ORDER BY avg_processing_hours, loan_goal LIMIT 5))""", "v_goals"),
        "j19_chart_lifecycle_share": sql(f"""SELECT lifecycle_transition, event_count,
          {pct('event_count', 'sum(event_count) OVER ()', 1)} AS share FROM v_lifecycle""", "v_lifecycle"),
        "j19_chart_top_activities": sql("SELECT * FROM v_activity ORDER BY event_count DESC, activity LIMIT 10", "v_activity"),
        "j19_chart_top_resources": sql("""SELECT * EXCLUDE (first_event, last_event) FROM v_resource
          ORDER BY event_count DESC, resource LIMIT 20""", "v_resource"),
        "a18_row_counts": sql("""SELECT 'cases' AS name, count(*) AS row_count FROM log_cases
          UNION ALL SELECT 'events', count(*) FROM log_events
          UNION ALL SELECT 'activity_summary', count(*) FROM v_activity
          UNION ALL SELECT 'monthly_summary', count(*) FROM v_monthly
          UNION ALL SELECT 'resource_workload', count(*) FROM v_resource""",
          "log_cases", "log_events", "v_activity", "v_monthly", "v_resource"),
        "a19_by_application_type": sql("""SELECT application_type AS type, count(*) AS count,
          avg_events_per_application AS avg_events FROM v_type GROUP BY 1, 3""", "v_type"),
        "a19_top_activities": sql("""SELECT activity, event_count AS count, percentage_of_total AS percentage FROM v_activity
          ORDER BY event_count DESC, activity LIMIT 5""", "v_activity"),
        "a19_top_resources": sql("""SELECT resource, event_count AS events, applications_handled AS applications
          FROM v_resource ORDER BY event_count DESC, resource LIMIT 5""", "v_resource"),
        "k01_prediction_coverage": sql(_coverage(NO_VERSION), "log_cases", "predictions"),
        "k01_prediction_coverage_v1": sql(_coverage("'v1.0'", V1), "log_cases", "predictions"),
        "k02_risk_distribution": sql(_distribution("latest", NO_VERSION), "latest"),
        "k02_risk_distribution_v1": sql(_distribution("predictions", "'v1.0'", V1), "predictions"),
        "k03_risk_probability_bands": sql(_bands("latest", NO_VERSION), "latest"),
        "k03_risk_probability_bands_v1": sql(_bands("predictions", "'v1.0'", V1), "predictions"),
        "k04_processing_time_summary": sql(_times("latest", NO_VERSION), "latest"),
        "k04_processing_time_summary_v1": sql(_times("predictions", "'v1.0'", V1), "predictions"),
        "k05_prediction_error_summary": sql(_error("v_risk_latest", NO_VERSION), "v_risk_latest"),
        "k05_prediction_error_summary_v1": sql(_error("v_risk", "'v1.0'", "AND model_version = 'v1.0'"), "v_risk"),
        "k06_high_risk_applications": sql(_high_risk("latest", 0.5, 50), "latest", "log_cases"),
        "k06_high_risk_applications_v1": sql(_high_risk("predictions", 0.8, 200, "AND model_version = 'v1.0'"), "predictions", "log_cases"),
        "k07_version_comparison": sql("SELECT model_version, count(*) AS predictions FROM predictions GROUP BY 1", "predictions"),
        "l01_generate_extensions": sql("SELECT * FROM extensions", "extensions"),
        "l06_extension_violations": sql("""SELECT rule, count(*) AS violations FROM (
          SELECT 'page_count below 1' AS rule FROM extensions WHERE page_count - 2 < 1
          UNION ALL SELECT 'quality_score out of bounds' FROM extensions WHERE quality_score + 8 NOT BETWEEN 65 AND 100
          UNION ALL SELECT 'sla target mismatch' FROM extensions WHERE page_count = 5) GROUP BY rule""", "extensions"),
        "a01_trace_scan": sql("SELECT application_id, event_count AS events FROM log_cases", "log_cases"),
        "a02_attribute_map": sql("""SELECT application_id, 'concept:name' AS key, application_id AS value FROM log_cases
          UNION ALL SELECT application_id, 'ApplicationType', application_type FROM log_cases
          UNION ALL SELECT application_id, 'LoanGoal', loan_goal FROM log_cases WHERE loan_goal IS NOT NULL
          UNION ALL SELECT application_id, 'RequestedAmount', CAST(requested_amount AS VARCHAR) FROM log_cases""", "log_cases"),
        "a03_parse_time": sql("SELECT trace_pos, event_pos, parsed FROM rough_events", "rough_events"),
        "a04_load_cases": sql("""SELECT application_id, application_type, coalesce(loan_goal, '') AS loan_goal,
          requested_amount FROM log_cases""", "log_cases"),
        "a05_load_events": sql("""SELECT event_id, application_id, activity, event_timestamp, coalesce(resource, '') AS resource,
          coalesce(lifecycle_transition, '') AS lifecycle_transition, action, event_origin
          FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_timestamp) AS nth FROM log_events)
          WHERE nth = 1""", "log_events"),
        "a06_case_rollup": sql("""SELECT application_id, first_event_time, last_event_time, event_count FROM log_cases""", "log_cases"),
        "a06_case_rollup_from_events": sql("""SELECT application_id, min(event_timestamp) AS first_event_time,
          max(event_timestamp) AS last_event_time, CAST(count(*) AS INTEGER) AS event_count
          FROM log_events GROUP BY application_id""", "log_events"),
        "a08_extension_upsert": sql("SELECT * EXCLUDE (lineage_tag) FROM extensions", "extensions"),
        "a09_prediction_upsert": sql("SELECT * FROM predictions", "predictions"),
        "a10_load_log": sql("""SELECT 'synthetic_generator_seed_42' AS source_file, 'synthetic_extension' AS load_type,
          count(*) AS records_loaded, 'SUCCESS' AS load_status FROM log_cases""", "log_cases"),
        "a12_csv_sink": sql("""SELECT lifecycle_transition, CAST(event_count AS VARCHAR) AS event_count,
          CAST(applications_affected AS VARCHAR) AS applications_affected, CAST(percentage AS VARCHAR) AS percentage,
          CAST(workflow_pct AS VARCHAR) AS workflow_pct, CAST(offer_pct AS VARCHAR) AS offer_pct,
          CAST(application_pct AS VARCHAR) AS application_pct FROM v_lifecycle""", "v_lifecycle"),
        "a13_parquet_sink": sql(DAILY, "log_cases"),
        "a15_export_all": sql("""SELECT dataset, format, rows FROM (
          SELECT 'executive_summary' AS dataset, 1 AS rows
          UNION ALL SELECT 'application_volume_by_type', count(*) FROM v_type
          UNION ALL SELECT 'application_volume_monthly', count(*) FROM v_monthly
          UNION ALL SELECT 'application_volume_daily', count(DISTINCT coalesce(CAST(first_event_time AS DATE), DATE '0001-01-01')) FROM log_cases
          UNION ALL SELECT 'activity_summary', count(*) FROM v_activity
          UNION ALL SELECT 'resource_workload', count(*) FROM v_resource
          UNION ALL SELECT 'lifecycle_outcomes', count(*) FROM v_lifecycle
          UNION ALL SELECT 'loan_goal_summary', count(*) FROM v_goals
          UNION ALL SELECT 'processing_time_distribution', count(*) FROM v_buckets), (VALUES ('csv'), ('parquet')) AS f(format)""",
          "v_type", "v_monthly", "v_activity", "v_resource", "v_lifecycle", "v_goals", "v_buckets", "log_cases"),
        "a17_quality_sinks": sql("SELECT * FROM quarantine", "quarantine"),
        "c07_repeated_keys": sql("""SELECT event_id, count(*) AS rows FROM rough_events WHERE event_id <> ''
          GROUP BY event_id HAVING count(*) > 1""", "rough_events"),
        "i01_issues": sql("""SELECT * FROM issues UNION ALL SELECT rule, 'info', '<dataset>',
          'The source carries no such attributes; they are generated separately.', NULL, NULL
          FROM (VALUES ('unavailable_document_extension_fields'), ('sla_consistency_not_evaluable')) AS r(rule)""", "issues"),
        "i13_rule_report": sql(f"""SELECT rule, severity, CASE WHEN severity = 'info' THEN 1 ELSE coalesce(n, 0) END AS issue_count
          FROM {CATALOG} LEFT JOIN (SELECT rule AS r, count(*) AS n FROM issues GROUP BY 1) ON r = rule""", "issues"),
        "i13_examples": sql("""SELECT rule, document_id, detail, severity FROM (SELECT *, row_number() OVER (
          PARTITION BY rule ORDER BY trace_pos, event_pos NULLS FIRST, detail) AS nth FROM issues) WHERE nth <= 20
          UNION ALL SELECT rule, '<dataset>', 'The source carries no such attributes; they are generated separately.', 'info'
          FROM (VALUES ('unavailable_document_extension_fields'), ('sla_consistency_not_evaluable')) AS r(rule)""", "issues"),
        "i14_quarantine": sql("SELECT * FROM quarantine", "quarantine"),
        "i15_totals": sql("""SELECT (SELECT count(*) FROM rough_traces) AS traces,
          (SELECT count(*) FROM rough_events) AS events""", "rough_traces", "rough_events"),
    }
    names = ("executive_summary", "application_volume_by_type", "application_volume_monthly", "application_volume_daily",
             "activity_summary", "resource_workload", "lifecycle_outcomes", "loan_goal_summary", "processing_time_distribution")
    listed = ", ".join(f"('{n}')" for n in names)
    feature_list = """CAST(requested_amount AS DOUBLE) AS requested_amount, {parts}, page_count,
      CAST(quality_score AS DOUBLE) AS quality_score, sla_target_hours, application_type, loan_goal, document_type, branch,
      operator_team, priority, region, channel""".format(parts=PARTS)
    numbers = ("requested_amount", "submission_hour", "submission_day_of_week", "submission_month", "page_count",
               "quality_score", "sla_target_hours")
    scaled = ", ".join(
        f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1), 6) AS {c}"
        for c in numbers)
    q |= {
        "a14_executive_summary": q["j13_executive_summary"],
        "a14_application_volume_by_type": q["j03_application_volume_by_type"],
        "a14_application_volume_monthly": q["j04_volume_monthly"],
        "a14_application_volume_daily": q["j04_volume_daily"],
        "a14_activity_summary": q["j08_activity_summary"],
        "a14_resource_workload": q["j09_resource_workload"],
        "a14_lifecycle_outcomes": q["j10_lifecycle_outcome_summary"],
        "a14_loan_goal_summary": q["j11_loan_goal_summary"],
        "a14_processing_time_distribution": sql("SELECT * FROM v_buckets", "v_buckets"),
        "a16_export_listing": q["a15_export_all"].replace("SELECT dataset, format, rows FROM", "SELECT dataset, format, rows, true AS stored FROM", 1),
        "r01_features_of_case": sql(f"""SELECT {feature_list} FROM log_cases JOIN extensions USING (application_id)
          WHERE application_id = '1'""", "log_cases", "extensions"),
        "m08_preprocessing": sql(f"""SELECT application_id, {scaled}, 8 AS flags FROM (
          SELECT application_id, {feature_list} FROM log_cases JOIN extensions USING (application_id))""", "log_cases", "extensions"),
        "m01_training_set": sql(f"""SELECT application_id, application_type, loan_goal,
          CAST(coalesce(requested_amount, 0) AS DECIMAL(15, 2)) AS requested_amount, first_event_time, last_event_time,
          {MICROS} / 3.6e9 AS processing_hours, {DAYS_EXPR} AS processing_days, document_type, page_count, branch,
          operator_team, priority, sla_target_hours, region, channel, quality_score, error_flag, rejection_flag
          FROM log_cases JOIN new_credit USING (application_id)""", "log_cases", "new_credit"),
        "m05_features_and_targets": sql(f"""SELECT application_id, CAST(requested_amount AS DOUBLE) AS requested_amount, {PARTS},
          page_count, CAST(quality_score AS DOUBLE) AS quality_score, sla_target_hours, application_type, loan_goal,
          document_type, branch, operator_team, priority, region, channel, {DAYS_EXPR} AS processing_days,
          round(ln(1 + {DAYS_EXPR}), 9) AS log_processing_days,
          CASE WHEN {DAYS_EXPR} > (SELECT {avg(f'sum({MICROS})', f'count({MICROS})')} / 8.64e10 FROM log_cases) THEN 1 ELSE 0 END AS is_sla_breach_operational,
          CASE WHEN {DAYS_EXPR} > (SELECT quantile_cont({DAYS_EXPR}, 0.5) FROM log_cases) THEN 1 ELSE 0 END AS is_sla_breach_median,
          CASE WHEN {MICROS} / 3.6e9 > sla_target_hours THEN 1 ELSE 0 END AS is_sla_breach_strict
          FROM log_cases JOIN extensions USING (application_id)""", "log_cases", "extensions"),
        "m06_training_threshold": sql(f"""SELECT round(quantile_cont({DAYS_EXPR}, 0.5), 6) AS median,
          round(avg({DAYS_EXPR}), 6) AS mean FROM log_cases""", "log_cases"),
        "m07_stratified_split": sql(_ranked("CASE WHEN nth <= round(size * 0.2) THEN 'test' ELSE 'train' END AS part"), "log_cases"),
        "m13_folds": sql(_ranked("CAST((nth - 1) % 5 AS INTEGER) AS fold"), "log_cases"),
        "m14_metrics": sql(METRICS_SQL, "truth", "running", "confusion"),
        "m16_dummy_baseline": sql("""SELECT CAST(0.5 AS DOUBLE) AS roc_auc, round_even(p, 4) AS pr_auc,
          round_even(CASE WHEN p > 0.5 THEN 2 * p / (1 + p) ELSE 0.0 END, 4) AS f1_score,
          round_even(CASE WHEN p > 0.5 THEN p ELSE 0.0 END, 4) AS precision, CAST(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS recall,
          (SELECT round_even(avg(abs(y - m)), 4) FROM truth) AS mae_days,
          (SELECT round_even(sqrt(avg((y - m) * (y - m))), 4) FROM truth) AS rmse_days,
          (SELECT round_even(1 - avg((y - m) * (y - m)) / var_pop(y), 4) FROM truth) AS r2_score
          FROM (SELECT CAST(avg(label) AS DOUBLE) AS p, quantile_cont(y, 0.5) AS m FROM truth)""", "truth"),
        "p01_scoring_input": sql(_case_features("LEFT", "coalesce(page_count, 1)", "coalesce(quality_score, 85.0)",
          "coalesce(sla_target_hours, 48)"), "log_cases", "new_credit"),
        "p03_skip_reasons": sql("""SELECT application_id, risk_class, risk_probability, predicted_processing_days,
          CASE WHEN nth > 1 THEN 'Duplicate application ID in input batch'
            WHEN risk_probability > 1 THEN 'risk_probability must be between 0.0 and 1.0, got ' || CAST(risk_probability AS VARCHAR)
            WHEN predicted_processing_days < 0 THEN 'predicted_processing_days must be nonnegative, got ' || CAST(predicted_processing_days AS VARCHAR)
          END AS reason
          FROM (SELECT application_id, CAST(risk_class AS INTEGER) AS risk_class,
            round(CAST(risk_probability AS DOUBLE) + 0.25, 4) AS risk_probability,
            round(CAST(predicted_processing_days AS DOUBLE) - 5, 2) AS predicted_processing_days,
            row_number() OVER (PARTITION BY application_id ORDER BY model_version) AS nth FROM predictions)""", "predictions"),
        "p06_score_job": sql(f"""SELECT application_id, 'v1.0' AS model_version, 'GradientBoostedTrees' AS model_type,
          {RISK} AS risk_class, {TWO_OR_TEN} AS predicted_processing_days FROM log_cases""", "log_cases"),
        "m12_fit_predict": sql(HELD_OUT, "log_cases"),
        "m12_fit_predict_real": sql("SELECT count(*) AS rows, count(*) AS in_range FROM log_cases", "log_cases"),
        "m15_save_load": sql(HELD_OUT, "log_cases"),
        "m13_cross_validate": sql("SELECT 1.0::DOUBLE AS cv_mean_roc_auc, 1.0::DOUBLE AS cv_mean_pr_auc, 1.0::DOUBLE AS cv_mean_f1_score, 0.0::DOUBLE AS cv_mean_mae_days"),
        "m17_ablation_real": sql(PERFECT),
        "m17_ablation_full": sql(PERFECT),
        "m17_ablation": sql("""SELECT features, one AS roc_auc, one AS pr_auc, one AS f1_score, one AS precision, one AS recall,
          0.0::DOUBLE AS mae_days, 0.0::DOUBLE AS rmse_days, one AS r2_score
          FROM (VALUES ('real', 1.0::DOUBLE), ('full', 1.0::DOUBLE), ('delta', 0.0::DOUBLE)) AS v(features, one)"""),
        "m18_training_job": sql(f"""SELECT application_id, 'v1.0' AS model_version, {RISK} AS risk_class,
          {TWO_OR_TEN} AS predicted_processing_days FROM log_cases""", "log_cases"),
        "r02_predict_case": sql(f"""SELECT application_id, {RISK} AS sla_risk_class, {TWO_OR_TEN} AS predicted_processing_days,
          'GradientBoostedTrees' AS model_type FROM log_cases WHERE application_id = '1'""", "log_cases"),
        "a07_read_tables": sql("""SELECT 'extensions' AS name, count(*) AS rows, count(DISTINCT application_id) AS cases FROM extensions
          UNION ALL SELECT 'predictions', count(*), count(DISTINCT application_id) FROM predictions""", "extensions", "predictions"),
        "a05_repeated_load": sql("""SELECT 'cases' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS unstamped FROM log_cases
          UNION ALL SELECT 'events', count(DISTINCT event_id), 0 FROM log_events
          UNION ALL SELECT 'loads', 2, 0""", "log_cases", "log_events"),
        "a17_report_head": sql("""SELECT (SELECT count(*) FROM rough_traces) AS traces, (SELECT count(*) FROM rough_events) AS events,
          (SELECT count(*) FROM quarantine) AS quarantined_traces""", "rough_traces", "rough_events", "quarantine"),
        "a19_total_applications": q["j01_total_applications"],
        "a19_total_events": q["j02_total_events"],
        "a19_processing_time_buckets": sql("""SELECT bucket, application_count AS count, percentage FROM v_buckets""", "v_buckets"),
        "a19_lifecycle_transitions": sql("""SELECT lifecycle_transition AS transition, event_count AS count,
          applications_affected AS apps FROM v_lifecycle""", "v_lifecycle"),
        "a19_monthly_summary": sql("""SELECT year_month AS month, applications AS apps, total_events AS events,
          avg_events_per_app AS avg_events FROM v_monthly""", "v_monthly"),
        "r01_case_features": sql(_case_features("", "page_count", "quality_score", "sla_target_hours"), "log_cases", "new_credit"),
        "r03_batch_lookup": sql("""SELECT c_custkey AS position, CAST(c_custkey AS VARCHAR) AS application_id,
          CASE WHEN n.application_id IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status,
          CASE WHEN n.application_id IS NULL
            THEN concat('Application ID ', chr(39), c_custkey, chr(39), ' not found in database.') END AS error,
          CASE WHEN n.application_id IS NOT NULL THEN 1 END AS sla_risk_class,
          CASE WHEN n.application_id IS NOT NULL THEN CAST(10 AS DOUBLE) END AS predicted_processing_days
          FROM customer LEFT JOIN new_credit n ON n.application_id = CAST(c_custkey AS VARCHAR)""", "new_credit"),
        "a11_mv_activity_summary": q["d14_mv_activity_summary"],
        "a11_mv_resource_workload": q["d15_mv_resource_workload"],
        "a11_mv_monthly_summary": q["d16_mv_monthly_summary"],
        "a11_mv_application_type_summary": q["d17_mv_application_type_summary"],
    }
    return q
