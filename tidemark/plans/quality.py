"""Queries of the data-quality jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import shaping as H
from tidemark.operators.quality import checks as C
from tidemark.operators.quality import history as Q
from tidemark.operators.quality import profile as P
from tidemark.operators.quality import rules as R
from tidemark.operators.quality import scorecard as K
from tidemark.plans.registry import query
from tidemark.plans.views import AS_OF, EVENTS_AS_OF, view, with_views


def sql_round(x: str, digits: int) -> str:
    return f"round(({x})::DOUBLE, {digits})"


def sql_grade(value: str, warn, fail) -> str:
    return f"CASE WHEN {value} < {warn}::DOUBLE THEN 'pass' WHEN {value} < {fail}::DOUBLE THEN 'warn' ELSE 'fail' END"


def sql_distinct(ratio: str) -> str:
    return f"CASE WHEN {ratio} >= 0.99::DOUBLE THEN 'pass' WHEN {ratio} >= 0.9::DOUBLE THEN 'warn' ELSE 'fail' END"


def check_rows(source: str, checks: list[tuple]) -> str:
    """UNION ALL of graded checks: (type, column, violation SQL, warn, fail)."""
    parts = []
    for i, (kind, col, pred, warn, fail) in enumerate(checks):
        if kind == "unique":
            hits, ratio = f"count(DISTINCT {col})", f"coalesce(hits::DOUBLE / nullif(non_null, 0), 1)"
            value, label, status = f"1 - {ratio}", f"printf('%.1f%% distinct', {sql_round(ratio + ' * 100', 1)})", sql_distinct(ratio)
        else:
            hits = f"count(*) FILTER (WHERE {pred})"
            base = "total" if kind == "not_null" else "non_null"
            share = f"coalesce(hits::DOUBLE / nullif({base}, 0), 0)"
            value, label = share, f"printf('%.1f%% invalid', {sql_round(share + ' * 100', 1)})"
            status = sql_grade(share + " * 100", warn, fail)
        parts.append(
            f"""SELECT {i} AS check_no, '{kind}' AS "check", '{col}' AS "column", total, non_null, hits,
  {sql_round(value, 4)} AS metric_value, {label} AS label, {status} AS status
FROM (SELECT count(*) AS total, count({col}) AS non_null, {hits} AS hits FROM {source})"""
        )
    return "\nUNION ALL\n".join(parts)


# One registered query per check: key part, view, spark check, check SQL.
_SINGLE_CHECKS = [
    ("not_null", "dirty_events", {"col": "user_id"}, "user_id IS NULL", 5, 20),
    ("non_empty", "scores", {"col": "driver"}, "trim(driver) = ''", 1, 10),
    ("regex_match", "customers", {"col": "phone", "pattern": "phone"},
     "NOT regexp_matches(phone, '^[+]?[0-9 ()-]{7,20}$')", 1, 5),
    ("range", "order_events", {"col": "discount_pct", "min": 0, "max": 0.2},
     "discount_pct < 0 OR discount_pct > 0.2::DOUBLE", 1, 5),
    ("non_negative", "customer", {"col": "c_acctbal"}, "c_acctbal < 0", 1, 5),
    ("not_future", "orders", {"col": "o_orderdate"}, f"o_orderdate > TIMESTAMP '{AS_OF}'", 1, 5),
    ("not_before", "orders", {"col": "o_orderdate", "date": "1995-04-01"},
     "o_orderdate < TIMESTAMP '1995-04-01'", 1, 5),
    ("in_set", "order_events", {"col": "channel", "values": ["WEB", "MOBILE"]},
     "channel <> 'WEB' AND channel <> 'MOBILE'", 1, 5),
    ("length_between", "part", {"col": "p_name", "min": 8, "max": 10},
     "length(p_name) < 8 OR length(p_name) > 10", 1, 5),
    ("unique", "events", {"col": "event_id"}, "", None, None),
]


def _single(kind, source, spec):
    def run(spark, sf):
        df = view(spark, sf, source)
        plan = C.plan_checks({"scope": "full", "checks": [{"type": kind, **spec}]}, df.schema)
        return C.grade(C.run_checks(df, plan.checks, AS_OF))

    return run


for _kind, _src, _spec, _pred, _w, _f in _SINGLE_CHECKS:
    query(f"check_{_kind}", with_views(_src) + check_rows(_src, [(_kind, _spec["col"], _pred, _w, _f)]))(
        _single(_kind, _src, _spec)
    )

@query("check_catalog", with_views(*dict.fromkeys(s for _, s, *_ in _SINGLE_CHECKS)) + "\nUNION ALL\n".join(
    check_rows(src, [(kind, spec["col"], pred, w, f)]) for kind, src, spec, pred, w, f in _SINGLE_CHECKS))
def _(spark, sf):
    return H.union_assets(*[_single(kind, src, spec)(spark, sf) for kind, src, spec, *_ in _SINGLE_CHECKS])


_MANY = [
    {"type": "not_null", "col": "customer_id"},
    {"type": "non_negative", "col": "unit_price"},
    {"type": "range", "col": "quantity", "min": 1, "max": 45},
    {"type": "in_set", "col": "region", "values": ["US_EAST", "US_WEST", "EU", "APAC"]},
    {"type": "unique", "col": "order_id"},
    {"type": "unique", "col": "customer_id"},
    {"type": "length_between", "col": "payment_method", "min": 4, "max": 6},
]
_MANY_SQL = [
    ("not_null", "customer_id", "customer_id IS NULL", 5, 20),
    ("non_negative", "unit_price", "unit_price < 0", 1, 5),
    ("range", "quantity", "quantity NOT BETWEEN 1 AND 45", 1, 5),
    ("in_set", "region", "region NOT IN ('US_EAST', 'US_WEST', 'EU', 'APAC')", 1, 5),
    ("unique", "order_id", "", None, None),
    ("unique", "customer_id", "", None, None),
    ("length_between", "payment_method", "length(payment_method) NOT BETWEEN 4 AND 6", 1, 5),
]


@query("run_checks", with_views("order_events", extra="graded AS (" + check_rows("order_events", _MANY_SQL) + ")")
       + 'SELECT check_no, "check", "column", total, non_null, hits FROM graded')
def _(spark, sf):
    df = view(spark, sf, "order_events")
    checks = C.plan_checks({"scope": "full", "checks": _MANY}, df.schema).checks
    return C.run_checks(df, checks, AS_OF).drop("warn", "fail")


@query("grade_checks", with_views("order_events") + check_rows("order_events", _MANY_SQL))
def _(spark, sf):
    df = view(spark, sf, "order_events")
    checks = C.plan_checks({"scope": "full", "checks": _MANY}, df.schema).checks
    return C.grade(C.run_checks(df, checks, AS_OF))


_UNFIT = [
    {"type": "range", "col": "quantity"},
    {"type": "in_set", "col": "region", "values": []},
    {"type": "made_up", "col": "region"},
    {"type": "not_null", "col": "nowhere"},
    {"type": "non_negative", "col": "region"},
]
_UNFIT_SQL = """
UNION ALL SELECT * FROM (VALUES
  (7, 'range', 'quantity', 'needs min or max'), (8, 'in_set', 'region', 'no values are listed'), (9, 'made_up', 'region', 'unknown kind'),
  (10, 'not_null', 'nowhere', 'no such column'), (11, 'non_negative', 'region', 'does not fit string')) AS v(check_no, "check", "column", label)
"""


@query("validate_checks", with_views("order_events") + "SELECT *, 'full' AS scope FROM (" + check_rows("order_events", _MANY_SQL)
       + _UNFIT_SQL.replace("SELECT *", "SELECT check_no, \"check\", \"column\", NULL, NULL, NULL, NULL, label, 'error'") + ")")
def _(spark, sf):
    df = view(spark, sf, "order_events")
    return C.run_plan(df, C.plan_checks({"scope": "full", "checks": _MANY + _UNFIT}, df.schema), AS_OF)


_SAMPLED = [
    {"type": "not_null", "col": "user_id"},
    {"type": "unique", "col": "event_id"},
    {"type": "range", "col": "value", "min": 0, "max": 50},
    {"type": "unique", "col": "event_type"},
]


@query("sampled_checks", "WITH picked AS (SELECT * FROM events ORDER BY md5(CAST(event_id AS VARCHAR)) LIMIT 2500)\n"
       "SELECT *, 'sample' AS scope FROM (" + check_rows("picked", [
           ("not_null", "user_id", "user_id IS NULL", 5, 20), ("unique", "event_id", "", None, None),
           ("range", "value", "value NOT BETWEEN 0 AND 50", 1, 5), ("unique", "event_type", "", None, None)]) + ")")
def _(spark, sf):
    df = view(spark, sf, "events")
    plan = C.plan_checks({"scope": "sample", "rows": 2500, "checks": _SAMPLED}, df.schema)
    return C.run_plan(df, plan, AS_OF, key=F.col("event_id"))


def scorecard_rows(source: str, asset: str, cols: list[str], ids: list[str], rules: list[tuple]) -> str:
    """Check SQL of a scorecard; rules are (column, rule, violation SQL, warn, fail)."""
    parts = []

    def add(kind, col, rule, hits, value, label, status):
        parts.append(
            f"""SELECT '{asset}' AS asset, '{kind}' AS "check", '{col}' AS "column", '{rule}' AS rule,
  total, non_null, hits, {sql_round(value, 4)} AS metric_value, {label} AS label, {status} AS status
FROM (SELECT count(*) AS total, count({col}) AS non_null, {hits} AS hits FROM {source})"""
        )

    for c in cols:
        share = "coalesce(hits::DOUBLE / nullif(total, 0), 0)"
        add("completeness", c, "", f"count(*) - count({c})", share,
            f"printf('%.1f%% null', {sql_round(share + ' * 100', 1)})", sql_grade(share, 0.05, 0.2))
    for c in ids:
        ratio = "coalesce(hits::DOUBLE / nullif(total, 0), 1)"
        add("uniqueness", c, "", f"count(DISTINCT {c})", f"1 - {ratio}",
            f"printf('%.1f%% distinct', {sql_round(ratio + ' * 100', 1)})", sql_distinct(ratio))
    for c, rule, pred, warn, fail in rules:
        share = "coalesce(hits::DOUBLE / nullif(non_null, 0), 0)"
        add("validity", c, rule, f"count(*) FILTER (WHERE {pred})", share,
            f"printf('%.1f%% invalid', {sql_round(share + ' * 100', 1)})", sql_grade(share + " * 100", warn, fail))
    return "\nUNION ALL\n".join(parts)


_ORDER_COLS = [
    "order_id", "customer_id", "product_id", "quantity", "unit_price", "discount_pct", "order_status", "channel",
    "region", "payment_method", "is_first_order", "event_timestamp", "kafka_partition", "kafka_offset",
]
_ORDER_RULES = [
    *[(c, "non_empty", f"trim({c}) = ''", 1, 10)
      for c in ("order_id", "customer_id", "product_id", "order_status", "channel", "region", "payment_method")],
    *[(c, "non_negative", f"{c} < 0", 1, 5)
      for c in ("quantity", "unit_price", "event_timestamp", "kafka_partition", "kafka_offset")],
    ("discount_pct", "percentage_range", "discount_pct < 0 OR discount_pct > 100", 1, 5),
]
ORDER_CARD = with_views(
    "order_events",
    extra="card AS ("
    + scorecard_rows("order_events", "order_events", _ORDER_COLS, ["order_id", "customer_id", "product_id"], _ORDER_RULES)
    + ")",
)


def order_card(spark, sf, exact=True):
    return K.scorecard(view(spark, sf, "order_events"), "order_events", AS_OF, exact=exact)


@query("cohesive_scorecard", ORDER_CARD + "SELECT * FROM card")
def _(spark, sf):
    return order_card(spark, sf)


@query("scorecard_sketch")
def _(spark, sf):
    return order_card(spark, sf, exact=False)


_SIGNAL_RULES = [
    ("email", "email_validation", r"NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')", 1, 5),
    ("ip_address", "ipv4_validation", r"NOT regexp_matches(ip_address, '^([0-9]{1,3}\.){3}[0-9]{1,3}$')", 1, 5),
    ("mac_address", "mac_validation", "NOT regexp_matches(mac_address, '^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$')", 1, 5),
    ("note", "non_empty", "trim(note) = ''", 1, 10),
    ("seen_at", "not_future", "seen_at > TIMESTAMP '2024-01-30 00:00:00'", 1, 5),
    ("made_at", "not_too_old", "made_at < TIMESTAMP '2000-01-01'", 1, 5),
    ("latitude", "latitude_range", "abs(latitude) > 90", 1, 5),
    ("longitude", "longitude_range", "abs(longitude) > 180", 1, 5),
    ("port", "port_range", "port NOT BETWEEN 1 AND 65535", 1, 5),
    ("age", "age_range", "age NOT BETWEEN 0 AND 150", 1, 5),
    ("amount", "non_negative", "amount < 0", 1, 5),
    ("completion_pct", "percentage_range", "completion_pct NOT BETWEEN 0 AND 100", 1, 5),
    ("owner_id", "not_null", "owner_id IS NULL", 1, 10),
]
_SIGNALS_AS_OF = "2024-01-30 00:00:00"


def violation_rows(rules) -> str:
    parts = []
    for c, rule, pred, warn, fail in rules:
        base = "count(*)" if rule == "not_null" else f"count({c})"
        share = "coalesce(violations::DOUBLE / nullif(checked, 0), 0)"
        parts.append(
            f"""SELECT '{c}' AS "column", '{rule}' AS rule, checked, violations, {sql_round(share, 4)} AS metric_value,
  {sql_grade(share + ' * 100', warn, fail)} AS status
FROM (SELECT {base} AS checked, count(*) FILTER (WHERE {pred}) AS violations FROM signals)"""
        )
    return "\nUNION ALL\n".join(parts)


def _rule(rules):
    def run(spark, sf):
        return K.rule_violations(view(spark, sf, "signals"), "signals", _SIGNALS_AS_OF, rules)

    return run


for _r in _SIGNAL_RULES:
    query(f"rule_{_r[1]}", with_views("signals") + violation_rows([_r]))(_rule([(_r[0], _r[1])]))

query("rule_templates", with_views("signals") + violation_rows(_SIGNAL_RULES))(_rule([(c, r) for c, r, *_ in _SIGNAL_RULES]))

query(
    "rule_violations",
    with_views("signals") + violation_rows(_SIGNAL_RULES)
    + "\nUNION ALL SELECT 'nowhere', 'not_null', NULL, NULL, NULL, 'error'",
)(_rule([(c, r) for c, r, *_ in _SIGNAL_RULES] + [("nowhere", "not_null")]))


def _family_sql(mode: str) -> str:
    rows = []
    for prio, (kind, words, rules) in enumerate(R.FAMILIES):
        if mode == "as_written":
            pattern = "|".join(words)
        else:
            plain = sorted({w.strip("_") for w in words})
            pattern = "(^|[_.-])((" + "|".join(plain) + ")([_.-]|$)"
            long_ones = [w for w in plain if len(w) >= 4]
            pattern += "|(" + "|".join(long_ones) + "))" if long_ones else ")"
        guard = "cage|page|stage" if rules == ["age_range"] else "(^$)^"
        rows += [f"({prio}, '{kind}', '{pattern}', '{guard}', '{r}')" for r in rules]
    for kind, rules in R.TYPE_DEFAULTS.items():
        rows += [f"(99, '{kind}', '', '(^$)^', '{r}')" for r in rules]
    return (
        "fam(prio, kind, pattern, guard, rule) AS (VALUES " + ", ".join(rows) + """),
kinds(type, kind) AS (VALUES ('string','string'), ('long','numeric'), ('int','numeric'), ('double','numeric'),
  ('timestamp','temporal'), ('date','temporal')),
hits AS (SELECT f.asset_id, f.ordinal, f.name, f.type, fam.rule, fam.prio,
    min(fam.prio) OVER (PARTITION BY f.asset_id, f.ordinal) AS best
  FROM asset_fields f JOIN kinds k ON k.type = f.type JOIN fam ON fam.kind = k.kind
  WHERE regexp_matches(lower(f.name), fam.pattern) AND NOT regexp_matches(lower(f.name), fam.guard))"""
    )


for _mode, _key in (("token", "infer_rules"), ("as_written", "infer_rules_as_written")):

    def _infer(spark, sf, mode=_mode):
        fields = view(spark, sf, "asset_fields").select("asset_id", "ordinal", "name", "type")
        return R.infer_rules(fields, mode)

    query(_key, with_views("asset_fields", extra=_family_sql(_mode)) + """
SELECT asset_id, ordinal, name, type, rule, 1.0::DOUBLE AS warn,
  CASE WHEN rule IN ('non_empty', 'not_null') THEN 10.0 ELSE 5.0 END::DOUBLE AS fail FROM hits WHERE prio = best""")(_infer)


_DIRTY_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("completeness", with_views("dirty_events") + scorecard_rows("dirty_events", "dirty_events", _DIRTY_COLS, [], []))
def _(spark, sf):
    return K.completeness(view(spark, sf, "dirty_events"), "dirty_events")


@query("volume_completeness_wide", with_views("order_events") + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM order_events"""
    for c in _ORDER_COLS))
def _(spark, sf):
    return K.null_profile(view(spark, sf, "order_events"))


def _uniq_sql(denom):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", total, non_null, hits, {sql_round('coalesce(hits::DOUBLE / nullif(' + denom + ', 0), 1)', 4)} AS ratio,
  {sql_distinct('coalesce(hits::DOUBLE / nullif(' + denom + ', 0), 1)')} AS status
FROM (SELECT count(*) AS total, count({c}) AS non_null, count(DISTINCT {c}) AS hits FROM dirty_events)"""
        for c in ("event_id", "user_id")
    )


@query("uniqueness", with_views("dirty_events") + _uniq_sql("total"))
def _(spark, sf):
    return K.uniqueness(view(spark, sf, "dirty_events"), ["event_id", "user_id"])


@query("uniqueness_non_null", with_views("dirty_events") + _uniq_sql("non_null"))
def _(spark, sf):
    return K.uniqueness(view(spark, sf, "dirty_events"), ["event_id", "user_id"], "non_null")


@query("approx_distinct", with_views("order_events") + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS ndv FROM order_events""" for c in ("customer_id", "product_id")))
def _(spark, sf):
    df = view(spark, sf, "order_events")
    return C.distinct_count(df, "customer_id", True).unionByName(C.distinct_count(df, "product_id", True))


@query("approx_distinct_sketch")
def _(spark, sf):
    df = view(spark, sf, "order_events")
    return C.distinct_count(df, "customer_id", False).unionByName(C.distinct_count(df, "product_id", False))


@query("overall_score", ORDER_CARD + """,
worst AS (SELECT "column" || ' ' || label AS driver FROM card WHERE status <> 'pass'
  ORDER BY metric_value DESC, "column", "check", rule LIMIT 1)
SELECT 'order_events' AS asset, """ + sql_round(
    "avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END::DOUBLE) * 100", 1) + """ AS score,
  count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn,
  count(*) FILTER (WHERE status = 'fail') AS n_fail, coalesce((SELECT driver FROM worst), '') AS driver FROM card""")
def _(spark, sf):
    return K.overall_score(order_card(spark, sf), ["asset"])


@query("worst_driver", ORDER_CARD + """
SELECT asset, "check", "column", rule, label, metric_value FROM card WHERE status <> 'pass'
ORDER BY metric_value DESC, "column", "check", rule LIMIT 1""")
def _(spark, sf):
    return K.worst_check(order_card(spark, sf), ["asset"])


@query("results_score", ORDER_CARD + "SELECT asset AS table_name, " + sql_round(
    "avg(" + sql_round("(1 - metric_value) * 100", 2) + ")", 1) + " AS score, count(*) AS n_checks FROM card GROUP BY asset")
def _(spark, sf):
    return K.results_score(K.result_rows(order_card(spark, sf), "run-1", AS_OF), ["table_name"])


@query("profile_to_catalog", ORDER_CARD + """
SELECT asset, "column" AS name, 996710400000 AS ts_ms, metric_value AS null_proportion,
  CAST(hits AS BIGINT) AS null_count, total AS values_count,
  CASE WHEN status = 'pass' THEN 'Success' ELSE 'Failed' END AS test_status FROM card WHERE "check" = 'completeness'""")
def _(spark, sf):
    return K.profile_rows(order_card(spark, sf), 996710400000)


TREND_SQL = f"""trend0 AS (
  SELECT asset, arg_min(score, (ts, run_no)) AS baseline, arg_max(score, (ts, run_no)) AS current,
    coalesce(arg_max(driver, (ts, run_no)) FILTER (WHERE driver <> ''), '') AS driver, count(*) AS runs
  FROM scores WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY asset),
trend1 AS (SELECT *, {sql_round('current - baseline', 1)} AS delta FROM trend0),
trend AS (SELECT *, CASE WHEN abs(delta) < 2 THEN 'stable' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN current >= 90 THEN 'good' WHEN current >= 75 THEN 'fair' ELSE 'poor' END AS level FROM trend1)"""


@query("quality_trend", with_views("scores", extra=TREND_SQL) + "SELECT * FROM trend")
def _(spark, sf):
    return Q.quality_trend(view(spark, sf, "scores"), EVENTS_AS_OF)


@query("trend_first_last", with_views("scores") + f"""
SELECT asset, arg_min(score, (ts, run_no)) AS first_value, arg_max(score, (ts, run_no)) AS last_value, count(*) AS runs,
  {sql_round('arg_max(score, (ts, run_no)) - arg_min(score, (ts, run_no))', 1)} AS delta FROM scores GROUP BY asset""")
def _(spark, sf):
    return H.first_last(view(spark, sf, "scores"), ["asset"], ["ts", "run_no"], "score")


LATEST_SQL = """latest AS (SELECT * EXCLUDE rn FROM (
  SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, run_no DESC) AS rn FROM scores) WHERE rn = 1)"""


@query("latest_per_key", with_views("scores", extra=LATEST_SQL) + "SELECT * FROM latest")
def _(spark, sf):
    return H.latest_per_key(view(spark, sf, "scores"), ["asset"], ["ts", "run_no"])


@query("lookup_latest", with_views("scores", extra=LATEST_SQL + """,
names AS (SELECT DISTINCT 'table_' || CAST(c_custkey AS VARCHAR) AS asset FROM customer)""") + """
SELECT n.asset, l.ts, l.score, l.driver FROM names n LEFT JOIN latest l USING (asset)""")
def _(spark, sf):
    names = view(spark, sf, "customer").select(F.concat(F.lit("table_"), F.col("c_custkey").cast("string")).alias("asset"))
    last = H.latest_per_key(view(spark, sf, "scores"), ["asset"], ["ts", "run_no"]).select("asset", "ts", "score", "driver")
    return Q.latest_badge(names.distinct(), last)


@query("recent_n", with_views("scores") + f"""
SELECT asset, ts, run_no, score FROM scores
WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 3 DAY AND ts <= TIMESTAMP '{EVENTS_AS_OF}'""")
def _(spark, sf):
    return H.recent(view(spark, sf, "scores"), "ts", 3, EVENTS_AS_OF).select("asset", "ts", "run_no", "score")


@query("window_of_latest_run", with_views("scores") + """
SELECT asset AS table_name, CAST(ts AS DATE)::VARCHAR AS run_id, ts AS run_timestamp, run_no, score FROM scores s
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM scores x WHERE x.asset = s.asset)""")
def _(spark, sf):
    rows = view(spark, sf, "scores").select(
        F.col("asset").alias("table_name"), F.to_date("ts").cast("string").alias("run_id"),
        F.col("ts").alias("run_timestamp"), "run_no", "score",
    )
    return H.latest_run(rows)


_UP_SQL = """ups AS (SELECT e.to_fqn AS asset, e.from_fqn AS upstream, t.current, t.delta, t.direction
  FROM (SELECT DISTINCT from_fqn, to_fqn FROM score_edges) e JOIN trend t ON t.asset = e.from_fqn)"""


@query("upstream_join_trend", with_views("scores", "score_edges", extra=TREND_SQL + "," + _UP_SQL) + "SELECT * FROM ups")
def _(spark, sf):
    return Q.upstream_trends(view(spark, sf, "score_edges"), Q.quality_trend(view(spark, sf, "scores"), EVENTS_AS_OF))


@query("root_cause_upstream", with_views("scores", "score_edges", extra=TREND_SQL + "," + _UP_SQL) + """
SELECT u.asset, min(upstream) AS cause, arg_min(u.delta, upstream) AS cause_delta, count(*) AS falling_upstreams
FROM ups u JOIN trend t ON t.asset = u.asset AND t.direction = 'down' WHERE u.direction = 'down' GROUP BY u.asset""")
def _(spark, sf):
    trends = Q.quality_trend(view(spark, sf, "scores"), EVENTS_AS_OF)
    return Q.root_cause(view(spark, sf, "score_edges"), trends, trends.where(F.col("direction") == "down"))


def _profile_sql(source, cols, as_of):
    """(column, kind) pairs to the flat profile rows."""
    parts = []
    for c, kind in cols:
        num, tim, txt = kind == "numeric", kind == "temporal", kind == "string"

        def pick(flag, expr, typ):
            return expr if flag else f"CAST(NULL AS {typ})"

        avg = f"CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / count({c})"
        fps = {
            "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "ipv4": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
            "uuid": "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
            "url": "^(https?|s3a?|hdfs)://", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}",
        }
        looks = ", ".join(
            pick(txt, f"CASE WHEN count(*) FILTER (WHERE regexp_matches({c}, '{p}')) > 0 THEN "
                      + sql_round(f"count(*) FILTER (WHERE regexp_matches({c}, '{p}'))::DOUBLE / count({c})", 3) + " END", "DOUBLE")
            + f" AS looks_{n}" for n, p in fps.items()
        )
        parts.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS sampled,
  {sql_round(f'(count(*) - count({c}))::DOUBLE / count(*)', 4)} AS null_rate, count(DISTINCT {c}) AS n_distinct,
  {sql_round(f'count(DISTINCT {c})::DOUBLE / nullif(count({c}), 0)', 4)} AS distinct_ratio,
  {pick(num, f'CAST(min({c}) AS DOUBLE)', 'DOUBLE')} AS min_num, {pick(num, f'CAST(max({c}) AS DOUBLE)', 'DOUBLE')} AS max_num,
  {pick(num, sql_round(avg, 4), 'DOUBLE')} AS avg_num, {pick(num, f'count(*) FILTER (WHERE {c} < 0)', 'BIGINT')} AS negatives,
  {pick(tim, f'min({c})', 'TIMESTAMP')} AS min_time, {pick(tim, f'max({c})', 'TIMESTAMP')} AS max_time,
  {pick(tim, f"count(*) FILTER (WHERE {c} > TIMESTAMP '{as_of}')", 'BIGINT')} AS future_dates,
  {pick(txt, f'min(length({c}))', 'BIGINT')} AS min_len, {pick(txt, f'max(length({c}))', 'BIGINT')} AS max_len, {looks}
FROM {source}"""
        )
    return "\nUNION ALL\n".join(parts)


_SIGNAL_KINDS = [
    ("event_id", "numeric"), ("seen_at", "temporal"), ("made_at", "temporal"), ("ip_address", "string"),
    ("mac_address", "string"), ("email", "string"), ("note", "string"), ("latitude", "numeric"),
    ("longitude", "numeric"), ("port", "numeric"), ("age", "numeric"), ("completion_pct", "numeric"),
    ("amount", "numeric"), ("owner_id", "numeric"),
]
PROFILE = with_views("signals", extra="prof AS (" + _profile_sql("signals", _SIGNAL_KINDS, EVENTS_AS_OF) + ")")


def signal_profile(spark, sf):
    return P.sample_profile(view(spark, sf, "signals"), EVENTS_AS_OF, exact=True)


@query("sample_profile", PROFILE + "SELECT * FROM prof")
def _(spark, sf):
    return signal_profile(spark, sf)


@query("sample_profile_bernoulli")
def _(spark, sf):
    df = view(spark, sf, "order_events")
    return P.looks_like(P.sample_profile(df, AS_OF, fraction=0.01))


@query("min_max_avg_profile", PROFILE + """
SELECT "column", min_num, max_num, avg_num, negatives, min_time, max_time, future_dates, min_len, max_len FROM prof""")
def _(spark, sf):
    return P.type_profile(view(spark, sf, "signals"), EVENTS_AS_OF).select(
        "column", "min_num", "max_num", "avg_num", "negatives", "min_time", "max_time", "future_dates", "min_len", "max_len"
    )


@query("semantic_hints", PROFILE + """
SELECT "column", 'regex_match' AS "check", 'email' AS pattern FROM prof WHERE looks_email >= 0.8
UNION ALL SELECT "column", 'regex_match', 'ipv4' FROM prof WHERE looks_ipv4 >= 0.8
UNION ALL SELECT "column", 'regex_match', 'uuid' FROM prof WHERE looks_uuid >= 0.8
UNION ALL SELECT "column", 'regex_match', 'url' FROM prof WHERE looks_url >= 0.8
UNION ALL SELECT "column", 'non_negative', NULL FROM prof WHERE negatives = 0 AND min_num >= 0
UNION ALL SELECT "column", 'not_future', NULL FROM prof WHERE kind = 'temporal' AND future_dates = 0""")
def _(spark, sf):
    return P.semantic_hints(signal_profile(spark, sf))


@query("evaluator_scores", with_views("dirty_events", extra="n AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM dirty_events"""
    for c in _DIRTY_COLS) + "), s AS (SELECT *, " + sql_round("100 - nulls::DOUBLE / total * 100", 1) + " AS score FROM n)") + """
SELECT *, CASE WHEN score >= 80 THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN score < 50 THEN 'critical' WHEN score < 80 THEN 'warning' END AS severity FROM s""")
def _(spark, sf):
    return P.evaluator_scores(K.null_profile(view(spark, sf, "dirty_events")))


@query("quarantine_split", with_views("dirty_events") + """
SELECT event_id, concat_ws(',', CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN event_type IS NULL THEN 'event_type' END,
  CASE WHEN value IS NULL THEN 'value' END) AS reasons FROM dirty_events
WHERE user_id IS NULL OR event_type IS NULL OR value IS NULL""")
def _(spark, sf):
    _, bad = P.quarantine_split(view(spark, sf, "dirty_events"), ["user_id", "event_type", "value"])
    return bad.select("event_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("expected_defects", """
SELECT l_orderkey, l_linenumber, l_partkey, 'ship_before_order' AS "check" FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < o_orderdate
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'amount_above_100k' FROM lineitem WHERE l_extendedprice > 100000
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'line_out_of_range' FROM lineitem WHERE l_linenumber NOT BETWEEN 1 AND 5""")
def _(spark, sf):
    li = view(spark, sf, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    # a line without an order, or with several, has each of its own defects once
    own = C.cross_checks(
        li,
        "k",
        {
            "amount_above_100k": C.outside(F.col("l_extendedprice"), None, 100000),
            "line_out_of_range": C.outside(F.col("l_linenumber"), 1, 5),
        },
    )
    ordered = li.join(view(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = C.cross_checks(ordered, "k", {"ship_before_order": F.col("l_shipdate") < F.col("o_orderdate")})
    return found.unionByName(own).select("k.*", "check")


@query("zscore_outlier", """
SELECT event_id, value FROM events
WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)) > 3""")
def _(spark, sf):
    return C.zscore_outlier(view(spark, sf, "events"), "value").select("event_id", "value")


@query("spec_join", with_views("order_events") + """
SELECT 'volume' AS kind, '' AS "column", count(*)::DOUBLE AS value FROM order_events
UNION ALL SELECT 'non_null', 'customer_id', count(customer_id) FROM order_events
UNION ALL SELECT 'max', 'unit_price', max(unit_price) FROM order_events""")
def _(spark, sf):
    row = view(spark, sf, "order_events").agg(
        F.count(F.lit(1)).alias("n"), F.count("customer_id").alias("nn_0"), F.max("unit_price").alias("mx_0")
    )
    return H.unpivot_specs(
        row,
        [
            {"kind": "volume", "column": "", "alias": "n"},
            {"kind": "non_null", "column": "customer_id", "alias": "nn_0"},
            {"kind": "max", "column": "unit_price", "alias": "mx_0"},
        ],
    )


@query("regex_match", r"""
SELECT doc_id, regexp_matches(text, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS email,
  regexp_matches(source, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AS date_iso FROM documents""")
def _(spark, sf):
    return view(spark, sf, "documents").select(
        "doc_id", C.regex_match("text", "email").alias("email"), C.regex_match("source", "date_iso").alias("date_iso")
    )


@query("safe_literal", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'it''s; -- a view' ELSE event_type END AS label FROM events""")
def _(spark, sf):
    label = F.when(F.col("event_type") == S.safe_literal("view"), S.safe_literal("it's; -- a view")).otherwise(F.col("event_type"))
    return view(spark, sf, "events").select("event_id", label.alias("label"))


@query("trim_blank", with_views("signals") + "SELECT event_id, trim(note) = '' AS blank FROM signals")
def _(spark, sf):
    return view(spark, sf, "signals").select("event_id", C.trim_blank("note").alias("blank"))


@query("length_stats", """
SELECT lang, min(length(text)) AS min_len, max(length(text)) AS max_len,
  count(*) FILTER (WHERE length(text) BETWEEN 100 AND 5000) AS between_len FROM documents GROUP BY lang""")
def _(spark, sf):
    n = F.length("text")
    return view(spark, sf, "documents").groupBy("lang").agg(
        F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count_if(n.between(100, 5000)).alias("between_len")
    )


@query("round_pct_label", with_views("dirty_events") + "SELECT event_type, printf('%.1f%% null', " + sql_round(
    "100.0::DOUBLE * (count(*) - count(user_id)) / count(*)", 1) + ") AS label FROM dirty_events GROUP BY event_type")
def _(spark, sf):
    share = F.lit(100.0) * F.count_if(F.col("user_id").isNull()) / F.count(F.lit(1))
    return view(spark, sf, "dirty_events").groupBy("event_type").agg(S.pct_label(share, "null").alias("label"))
