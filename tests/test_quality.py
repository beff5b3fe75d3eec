from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.quality import checks as C
from tidemark.operators.quality import history as Q
from tidemark.operators.quality import profile as P
from tidemark.operators.quality import rules as R
from tidemark.operators.quality import scorecard as K

NOW = "2026-01-01 00:00:00"


@pytest.fixture(scope="module")
def people(spark):
    data = [(i, None if i == 3 else f"u{i}@mail.com", "INVALID_PHONE" if i == 7 else "+1 555 0100", float(i - 2)) for i in range(1, 9)]
    return spark.createDataFrame(data, "customer_id long, email string, phone string, amount double")


def status(graded, **where):
    for k, v in where.items():
        graded = graded.where(F.col(k) == v)
    return graded.first().status


def test_seeded_defects_are_found(people):
    card = K.scorecard(people, "customers", NOW, exact=True)
    assert status(card, check="completeness", column="email") == "warn"  # 12.5 % null
    assert status(card, check="completeness", column="customer_id") == "pass"
    assert status(card, check="uniqueness", column="customer_id") == "pass"
    assert status(card, check="validity", column="email") == "pass"
    assert status(card, check="validity", column="amount") == "fail"  # one of eight is negative
    plan = C.plan_checks({"scope": "full", "checks": [{"type": "regex_match", "col": "phone", "pattern": "phone"}]}, people.schema)
    assert status(C.run_plan(people, plan, NOW)) == "fail"


def test_score_and_driver(people):
    card = K.scorecard(people, "customers", NOW, exact=True)
    score = K.overall_score(card, ["asset"]).first()
    assert (score.n_warn, score.n_fail) == (1, 1) and score.driver == "amount 12.5% invalid"
    assert score.score == round((score.n_pass + 0.5) / (score.n_pass + 2) * 100, 1)
    assert K.worst_check(card, ["asset"]).first().column == "amount"


def test_exact_card_reads_its_table_once(spark, tmp_path):
    path = str(tmp_path / "orders")
    rows = [(i, i % 7 if i % 5 else None, -0.0 if i % 2 else 0.0, f"x{i % 3}") for i in range(200)]
    spark.createDataFrame(rows, "order_id long, customer_id long, zero_key double, note string").write.parquet(path)
    card = K.scorecard(spark.read.parquet(path), "orders", NOW, exact=True)
    assert card._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    hits = {r.column: r.hits for r in card.where("check = 'uniqueness'").collect()}
    assert hits == {"order_id": 200, "customer_id": 7, "zero_key": 1}


def test_sketch_and_exact_agree_on_small_tables(people):
    a = K.scorecard(people, "c", NOW, exact=True)
    b = K.scorecard(people, "c", NOW, exact=False)
    assert rows(a, "check", "column", "rule", "status") == rows(b, "check", "column", "rule", "status")


def test_empty_table_scores_100(people):
    empty = people.limit(0)
    card = K.scorecard(empty, "e", NOW, exact=True)
    assert {r.status for r in card.collect()} == {"pass"}
    assert K.overall_score(card, ["asset"]).first().score == 100.0


def test_info_rows_do_not_count(spark):
    df = spark.createDataFrame(
        [("a", "c", "x", "", "", "info", 9.0), ("a", "c", "y", "", "l", "fail", 0.5)],
        "asset string, check string, column string, rule string, label string, status string, metric_value double",
    )
    assert K.overall_score(df, ["asset"]).first().score == 0.0
    assert K.results_score(df, ["asset"]).first().score == 0.5


def test_not_null_can_fire(people):
    got = C.grade(C.run_checks(people, [C.Check(0, "not_null", "email")], NOW)).first()
    assert (got.hits, got.metric_value, got.status) == (1, 0.125, "warn")


def test_unsuitable_checks_become_error_rows_and_stop_no_other(people):
    bad = [
        {"type": "nope", "col": "email"}, {"type": "not_null", "col": "gone"}, "text", {"type": [], "col": {}},
        {"type": "regex_match", "col": "email", "pattern": "mine"}, {"type": "range", "col": "amount"},
        {"type": "range", "col": "amount", "min": True}, {"type": "range", "col": "amount", "max": float("inf")},
        {"type": "in_set", "col": "email", "values": []}, {"type": "in_set", "col": "amount", "values": ["a"]},
        {"type": "not_before", "col": "email", "date": "2020-01-01"}, {"type": "non_negative", "col": "email"},
        {"type": "length_between", "col": "amount", "min": 1},
    ]
    plan = C.plan_checks({"scope": "full", "checks": [*bad, {"type": "not_null", "col": "email"}]}, people.schema)
    got = C.run_plan(people, plan, NOW).collect()
    assert [r.check_no for r in got if r.status == "error"] == list(range(len(bad))) and all(r.label for r in got)
    assert [(r.check_no, r.hits, r.status) for r in got if r.status != "error"] == [(len(bad), 1, "warn")]
    assert C.run_plan(people, C.plan_checks({"checks": bad}, people.schema), NOW).count() == len(bad)
    assert C.plan_checks({"checks": "none"}, people.schema).checks == ()


def test_dates_are_read_whole(spark):
    df = spark.sql("SELECT DATE '2020-05-01' AS d")
    days = ["2020-99-99", "2020", 7, "2021-01-01"]
    plan = C.plan_checks({"scope": "full", "checks": [{"type": "not_before", "col": "d", "date": x} for x in days]}, df.schema)
    assert [r.no for r in plan.refused] == [0, 1, 2]
    assert [(r.hits, r.status) for r in C.run_plan(df, plan, NOW).where("status <> 'error'").collect()] == [(1, "fail")]


def test_no_number_of_checks_or_values_is_cut(people):
    many = [{"type": "in_set", "col": "amount", "values": list(range(60))}, {"type": "range", "col": "amount", "max": 1e16}]
    plan = C.plan_checks({"scope": "full", "checks": many + [{"type": "not_null", "col": "email"}] * 101}, people.schema)
    assert len(plan.checks) == 103 and not plan.refused and C.run_plan(people, plan, NOW).count() == 103


def test_a_sample_is_asked_for_with_its_share(spark):
    df = spark.range(1000)
    plan = C.plan_checks({"scope": "weird", "checks": [{"type": "not_null", "col": "id"}]}, df.schema, fraction=0.2)
    got = C.run_plan(df, plan, NOW).first()
    assert got.scope == "sample" and 100 < got.total < 300


def test_many_columns_are_sliced(spark):
    wide = spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(230)])
    got = K.null_profile(wide)
    assert got.count() == 230 and got.where("total = 10 AND nulls = 0").count() == 230


def test_unique_grade_limits(spark):
    df = spark.range(100).select(F.when(F.col("id") < 95, F.col("id")).otherwise(0).alias("x_id"), F.lit(None).cast("int").alias("n_id"))
    got = {r.column: r for r in C.grade(C.run_checks(df, [C.Check(i, "unique", c) for i, c in enumerate(df.columns)], NOW)).collect()}
    assert got["x_id"].status == "warn" and got["x_id"].label == "95.0% distinct"
    assert got["n_id"].status == "pass"  # nothing to compare


@pytest.mark.parametrize(
    "name,kind,token,written",
    [
        ("description", "string", ["non_empty"], ["ipv4_validation"]),
        ("source_ip", "string", ["ipv4_validation"], ["ipv4_validation"]),
        ("machine", "string", ["non_empty"], ["mac_validation"]),
        ("percentage", "double", ["percentage_range"], ["age_range"]),
        ("related_count", "long", ["non_negative"], ["latitude_range"]),
        ("page_number", "long", ["non_negative"], ["non_negative"]),
        ("customer_email", "string", ["email_validation"], ["email_validation"]),
        ("email", "long", ["non_negative"], ["non_negative"]),
        ("created_at", "timestamp", ["not_future", "not_too_old"], ["not_future", "not_too_old"]),
        ("event_timestamp", "long", ["non_negative"], ["non_negative"]),
        ("flag", "boolean", [], []),
    ],
)
def test_rule_inference_modes(spark, name, kind, token, written):
    df = spark.createDataFrame([(name, kind)], "name string, type string")
    got = df.select(R.rules_for("name", "type").alias("t"), R.rules_for("name", "type", "as_written").alias("w")).first()
    assert (got.t, got.w) == (token, written)


def test_schema_rules_equal_catalog_rules(spark):
    ddl = {"string": "string", "double": "double", "long": "bigint", "timestamp": "timestamp"}
    fields = [("customer_email", "string"), ("source_ip", "string"), ("lat", "double"), ("age", "long"), ("stage_no", "long"),
              ("created_at", "timestamp"), ("description", "string"), ("completion_rate", "double"), ("open_port", "long")]
    table = spark.createDataFrame([], ", ".join(f"{n} {ddl[t]}" for n, t in fields))
    for mode in ("token", "as_written"):
        got = R.infer_rules(spark.createDataFrame(fields, "name string, type string"), mode)
        assert sorted(R.schema_rules(table, mode)) == rows(got, "name", "rule")


def test_rule_errors_are_reported(people):
    got = K.rule_violations(people, "c", NOW, [("email", "email_validation"), ("gone", "not_null"), ("email", "odd_rule")])
    assert rows(got, "column", "rule", "status") == [
        ("email", "email_validation", "pass"), ("email", "odd_rule", "error"), ("gone", "not_null", "error"),
    ]


def test_profile_fingerprints_and_hints(people):
    profile = P.sample_profile(people, NOW, exact=True)
    email = profile.where("column = 'email'").first()
    assert (email.null_rate, email.looks_email, email.looks_ipv4) == (0.125, 1.0, None)
    assert P.looks_like(profile).where("column = 'email'").first().looks_like == {"email": 1.0}
    assert rows(P.semantic_hints(profile), "column", "check", "pattern") == [
        ("customer_id", "non_negative", None), ("email", "regex_match", "email"),
    ]


def test_evaluator_example(spark):
    df = spark.createDataFrame([("id", 1_000_000, 0), ("email", 1_000_000, 5_000), ("created_at", 1_000_000, 100), ("x", 0, 0), ("y", 10, 4), ("z", 10, 6)],
                               "column string, total long, nulls long")
    got = {r.column: (r.score, r.status, r.severity) for r in P.evaluator_scores(df).collect()}
    assert got["id"] == (100.0, "pass", None) and got["email"] == (99.5, "pass", None) and got["created_at"][0] == 100.0
    assert got["x"] == (0.0, "fail", "critical") and got["y"][2] == "warning" and got["z"][2] == "critical"


def test_quarantine_keeps_every_row(people):
    clean, held = P.quarantine_split(people, ["email", "phone"])
    assert (clean.count(), held.count()) == (7, 1) and held.first().reasons == ["email"]


def test_cross_checks(spark):
    df = spark.createDataFrame(
        [(1, datetime(2026, 1, 2), datetime(2026, 1, 1), 3), (2, datetime(2026, 1, 1), datetime(2026, 1, 2), 10), (3, datetime(2026, 1, 1), None, 5)],
        "id long, shipped timestamp, delivered timestamp, rating int",
    )
    got = C.cross_checks(df, "id", {"date_order": F.col("delivered") < F.col("shipped"), "range": C.outside(F.col("rating"), 1, 5)})
    assert rows(got) == [(1, "date_order"), (2, "range")]


def test_zscore_outlier_reads_one_scan(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") == 7, 999999.0).otherwise(F.col("id") * 1.0).alias("v"))
    assert rows(C.zscore_outlier(df, "v"), "id") == [(7,)]
    assert C.zscore_outlier(df.withColumn("v", F.lit(1.0)), "v").count() == 0


def test_trend_directions_and_root_cause(spark):
    t0, t1 = datetime(2026, 1, 1), datetime(2026, 1, 5)
    data = [("a", t0, 1, 90.0, ""), ("a", t1, 2, 70.0, "email null"), ("b", t0, 1, 80.0, "x"), ("b", t1, 2, 81.9, ""),
            ("c", t0, 1, 60.0, ""), ("c", t1, 2, 95.0, ""), ("old", datetime(2025, 1, 1), 1, 10.0, "")]
    scores = spark.createDataFrame(data, "asset string, ts timestamp, run_no long, score double, driver string")
    trend = Q.quality_trend(scores, "2026-01-06 00:00:00")
    assert rows(trend, "asset", "direction", "level", "driver") == [
        ("a", "down", "poor", "email null"), ("b", "stable", "fair", "x"), ("c", "up", "good", ""),
    ]
    edges = spark.createDataFrame([("a", "mart"), ("a", "mart"), ("b", "mart"), ("c", "other")], "from_fqn string, to_fqn string")
    assert rows(Q.root_cause(edges, trend), "asset", "cause", "falling_upstreams") == [("mart", "a", 1)]


def test_rounding_is_away_from_zero_and_keeps_large_numbers(spark):
    from tidemark.functions.scalar import half_up

    values = [1.7e15, -30.05, -2.5, 2.5, 1e300, -1e300, 0.125, -0.125]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(half_up("v", 1)).collect()]
    assert got == [1.7e15, -30.1, -2.5, 2.5, 1e300, -1e300, 0.1, -0.1]


def test_profile_mean_of_extreme_numbers(spark):
    df = spark.createDataFrame([(1e300, 1.7e15), (1.0, 1.7e15)], "a double, b double")
    got = {r["column"]: r["avg_num"] for r in P.type_profile(df, "2024-01-01 00:00:00").collect()}
    assert got["a"] == 5e299 and got["b"] == 1.7e15


def test_rules_that_do_not_fit_a_type_become_error_rows(people):
    rules = [("email", "non_negative"), ("amount", "email_validation"), ("amount", "not_future"), ("email", "not_null")]
    got = {(r.column, r.rule): r.status for r in K.rule_violations(people, "people", NOW, rules).collect()}
    assert got == dict.fromkeys(rules[:3], "error") | {rules[3]: "fail"}  # 12.5 % nulls, limits 1 and 10


def test_defects_of_lines_without_an_order(spark, sf_dir, tmp_path):
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    one = lines.limit(1).withColumns({"l_linenumber": F.lit(9).cast(lines.schema["l_linenumber"].dataType), "l_extendedprice": F.lit(200000.0)})
    one.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    found = entry.queries()["expected_defects"](spark, str(tmp_path))
    assert rows(found, "check") == [("amount_above_100k",), ("line_out_of_range",)]


def test_exact_card_keeps_one_count_beside_a_distinct_value(spark):
    cols = [f"c{i}_id" for i in range(3)] + [f"n{i}" for i in range(40)]
    data = [tuple(None if (r + i) % 5 == 0 else (r * (i + 1)) % 11 - 2 for i in range(43)) for r in range(50)] * 2
    card = K.scorecard(spark.createDataFrame(data, ", ".join(f"{c} long" for c in cols)), "wide", NOW, exact=True)
    for line in card._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if "Aggregate [" in line and "Aggregate [[" not in line and not line.split("Aggregate [")[1].startswith("]"):
            assert line.count("count") <= 2, line
    got = {(r.check, r.column, r.rule): (r.total, r.non_null, r.hits) for r in card.collect()}
    for i, c in enumerate(cols):
        held = [row[i] for row in data if row[i] is not None]
        assert got["completeness", c, ""] == (100, len(held), 100 - len(held))
        assert got["validity", c, "non_negative"] == (100, len(held), sum(v < 0 for v in held))
        assert ("uniqueness", c, "") not in got or got["uniqueness", c, ""] == (100, len(held), len(set(held)))
    none = K.scorecard(spark.createDataFrame([], "a_id long"), "none", NOW, exact=True)
    assert rows(none, "check", "total", "hits", "status") == [("completeness", 0, 0, "pass"), ("uniqueness", 0, 0, "pass"), ("validity", 0, 0, "pass")]


def test_rules_are_inferred_once_for_each_name_and_type(spark):
    fields = [("a", "source_ip", "string"), ("b", "source_ip", "string"), ("c", None, "long"), ("d", "age", None), ("e", None, None), ("f", "x", "blob")]
    found = R.infer_rules(spark.createDataFrame(fields, "asset string, name string, type string"))
    assert rows(found, "asset", "name", "type", "rule") == [
        ("a", "source_ip", "string", "ipv4_validation"), ("b", "source_ip", "string", "ipv4_validation"), ("c", None, "long", "non_negative"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString().upper()
    assert "RLIKE" not in plan  # no step over the rows holds the ladder, only the result of the distinct
