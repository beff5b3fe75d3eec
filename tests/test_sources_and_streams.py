import json
import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import health as O
from tidemark.operators import kpi as K
from tidemark.operators import shaping as H
from tidemark.sources import avro as A
from tidemark.sources import tables as S
from tidemark.streaming import jobs as J


def test_partitioned_write_and_refresh(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 70, "hot").otherwise("cold").alias("k"))
    path = str(tmp_path / "t")
    S.write_partitioned(df, path, ["k", "absent"])
    assert (tmp_path / "t" / "k=hot").exists()
    S.refresh_partition(df.where("k = 'cold'").limit(3), path, ["k"])
    assert spark.read.parquet(path).count() == 73
    S.write_partitioned(df, str(tmp_path / "plain"), ["absent"])
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 100


def test_copy_checks_types_first(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "src"))
    source = {"type": "table", "name": str(tmp_path / "src")}
    with pytest.raises(ValueError):
        S.copy(spark, source, {"type": "printer"})
    with pytest.raises(ValueError):
        S.copy(spark, {"type": "fax"}, {"type": "directory", "path": str(tmp_path / "x")})
    S.copy(spark, source, {"type": "table", "name": "copied", "mode": "overwrite", "bucket": (2, ["id"])})
    assert S.scan_table(spark, "copied", ["id"]).count() == 5


def test_bucketed_tables_join_without_shuffle(spark):
    for name in ("left_b", "right_b"):
        df = spark.range(1000).select(F.col("id").alias("k"), F.lit(name).alias(f"v_{name}"))
        S.write_sink(df, {"type": "table", "name": name, "mode": "overwrite", "bucket": (4, ["k"])})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("left_b").join(spark.table("right_b"), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_project_to_schema(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "A int, extra string, b double")
    sink = T.StructType().add("b", T.StringType()).add("a", T.LongType()).add("c", T.DateType())
    out = S.project_to_schema(df, sink)
    assert out.schema.simpleString() == "struct<b:string,a:bigint,c:date>" and rows(out) == [("2.0", 1, None)]


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "{oops"), (3, '{"b": "y"}'), (4, '{"a": "text"}'), (5, None)], "id int, body string")
    schema = T.StructType().add("a", T.LongType()).add("b", T.StringType())
    good, dead = S.split_bad(df, "body", schema, ["a"])
    assert rows(good) == [(1, 1, "x")]
    assert rows(dead, "id", "reason") == [(2, "unparsable"), (3, "missing a"), (4, "unparsable"), (5, "unparsable")]


def test_versions(spark):
    files = spark.createDataFrame([("t", "a", 1, datetime(2026, 1, 1)), ("t", "b", 2, datetime(2026, 1, 1)), ("u", "c", 1, datetime(2026, 1, 1))],
                                  "asset string, path string, size long, modified timestamp")
    now = S.listing_version(files)
    assert S.changed_assets(now, S.listing_version(files.orderBy("size"))).count() == 0
    grown = S.listing_version(files.withColumn("size", F.when(F.col("path") == "b", 3).otherwise(F.col("size")).cast("long")))
    assert rows(S.changed_assets(grown, now), "asset") == [("t",)]
    lost = now.withColumn("version", F.lit(None).cast("string"))
    assert S.changed_assets(now, lost).count() == 2


def test_table_facts(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(0, 100, 1, 4).write.parquet(path)
    got = S.table_stats(spark.read.parquet(path)).first()
    assert (got.row_count, got.file_count) == (100, 4) and got.total_bytes > 0
    files = S.object_inventory(spark, path).where(F.col("path").endswith(".parquet"))
    assert files.agg(F.sum("size")).first()[0] == got.total_bytes


def test_topk_moves_few_rows(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = H.topk(df, ["k"], [F.col("id").desc()], 3)
    assert rows(top, "id") == [(994,), (995,), (996,), (997,), (998,), (999,)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_threshold_monitor_percentile_of_a_hot_window(spark):
    data = [("2026-01-01 00:00:00", v * v % 101) for v in range(400)] + [("2026-01-01 00:07:00", v) for v in (5, 1, 4, 4, 2, 8, None)]
    data += [("2026-01-01 00:12:00", 7)] * 50 + [("2026-01-01 00:17:00", None)]
    df = spark.createDataFrame(data, "at string, write_ms long").select(
        F.col("at").cast("timestamp").alias("ts"), "write_ms", F.lit(1).cast("long").alias("consumer_lag"), F.lit(0.5).alias("error_rate")
    )
    got = O.threshold_monitor(df).select("window_start", "p75_write_ms", "error_rate")
    want = df.groupBy(F.window("ts", "5 minutes")["start"].alias("window_start")).agg(F.percentile("write_ms", 0.75), F.avg("error_rate"))
    assert rows(got) == rows(want)


def test_limits_are_asked_for(spark):
    df = spark.range(300)
    assert H.select_or_count(df, ["id"], "id").count() == 300 and H.select_or_count(df, ["id"], "id", 7).count() == 7


# --- registry and Avro ---------------------------------------------------------


def test_frames_round_trip(spark):
    df = spark.createDataFrame([(70000, bytearray(b"abc")), (1, bytearray(b""))], "id long, body binary")
    good, dead = A.split_frames(df.select(A.frame("id", "body").alias("value")), "value")
    assert rows(good.select("schema_id", F.col("payload").cast("string"))) == [(1, ""), (70000, "abc")] and dead.count() == 0
    raw = spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00\x01x"),), (bytearray(b"\x00\x00"),), (None,)], "value binary")
    good, dead = A.split_frames(raw, "value")
    assert (good.count(), dead.count()) == (0, 3)


@pytest.mark.parametrize(
    "text,kind,null",
    [('long', "bigint", False), ('["null","string"]', "string", True), ('["null",{"type":"long","logicalType":"timestamp-millis"}]', "timestamp", True),
     ('{"type":["null","int"]}', "int", True), ('{"type":"int","logicalType":"date"}', "date", False),
     ('{"type":"array","items":"string"}', "array", False), ('{"type":"record","fields":[]}', "struct", False), ("mystery", "string", False)],
)
def test_type_texts(spark, text, kind, null):
    got = spark.createDataFrame([(text,)], "t string").select(A.table_type("t").alias("k"), A.is_nullable("t").alias("n")).first()
    assert (got.k, got.n) == (kind, null)


def test_nested_schema_maps_recursively(spark):
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "id", "type": "long"}, {"name": "at", "type": ["null", {"type": "long", "logicalType": "timestamp-millis"}]},
        {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "m", "type": {"type": "map", "values": ["null", "int"]}},
        {"name": "in", "type": {"type": "record", "name": "x", "fields": [{"name": "y", "type": "double"}]}},
        {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 18, "scale": 2}}]}
    got = A.spark_schema(json.dumps(schema))
    assert got.simpleString() == "struct<id:bigint,at:timestamp,tags:array<string>,m:map<string,int>,in:struct<y:double>,d:decimal(18,2)>"
    assert got["at"].nullable and not got["id"].nullable
    assert A.spark_schema(A.avro_schema(got)).simpleString() == got.simpleString()


def test_broken_schema_text_gives_no_fields(spark):
    df = spark.createDataFrame([("{broken",), (None,), ('{"namespace":"n","fields":[{"name":"a","type":["null","int"]}]}',)], "t string")
    got = [(r.namespace, len(r.fields)) for r in A.avro_fields(df, "t").collect()]
    assert got == [("", 0), ("", 0), ("n", 1)]


def test_json_schema_skips_private_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x", "_p": 1}',), ('{"a": 1.5, "c": [1], "d": {"e": null}}',), ("{broken",)], "body string")
    assert rows(A.json_schema(df, "body").select("name", F.concat_ws(",", "types"))) == [("a", "float,int"), ("b", "str"), ("c", "list"), ("d", "dict")]


# --- streaming -------------------------------------------------------------------


SCHEMA = "id long, ts timestamp, v double"


def feed(spark, path, data):
    spark.createDataFrame([(i, datetime.fromisoformat(t), v) for i, t, v in data], SCHEMA).write.mode("append").parquet(path)


def test_landing_resumes_from_its_checkpoint(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for run in (1, 2, 2):
        if run == 1 or spark.read.parquet(src).count() == 2:
            feed(spark, src, [(run * 10, "2026-01-01T00:00:00", 1.0), (run * 10 + 1, "2026-01-01T00:00:00", 1.0)])
        J.land_stream(J.stream_files(spark, src, SCHEMA), out, cp, available_now=True).awaitTermination()
    assert rows(spark.read.parquet(out), "id") == [(10,), (11,), (20,), (21,)]


def test_windowed_checks_merge_late_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for data in ([(1, "2026-01-01T00:00:10", None)], [(2, "2026-01-01T00:00:20", 2.0)]):
        feed(spark, src, data)
        checked = J.schema_validation(J.stream_files(spark, src, SCHEMA), "ts", ["id", "v"], delay="1 day")
        J.land_updates(checked, out, cp).awaitTermination()
    last = H.latest_per_key(spark.read.parquet(out), ["window_start"], ["batch_id"])
    assert rows(last, "total", "complete", "complete_pct") == [(2, 1, 50.0)]


def test_dead_letter_stream_is_repeatable(spark, tmp_path):
    src = str(tmp_path / "src")
    feed(spark, src, [(1, "2026-01-01T00:00:10", None), (2, "2026-01-01T00:00:10", 1.0)])
    paths = [str(tmp_path / n) for n in ("good", "dead")]
    for attempt in ("cp1", "cp2"):  # a lost checkpoint replays batch 0
        J.land_with_dead_letters(
            J.stream_files(spark, src, SCHEMA), lambda b: (b.where("v IS NOT NULL"), b.where("v IS NULL")), *paths, str(tmp_path / attempt)
        ).awaitTermination()
    assert [spark.read.parquet(p).count() for p in paths] == [1, 1]


def test_unknown_stream_sink(spark):
    with pytest.raises(ValueError):
        J.continuous_copy(spark.range(1), {"type": "warehouse"}, "/tmp/none")


@pytest.mark.parametrize("last,grade", [("2026-01-01T11:00:00", "pass"), ("2026-01-01T07:00:00", "warn"), ("2026-01-01T06:59:00", "fail")])
def test_freshness(spark, last, grade):
    df = spark.createDataFrame([(datetime.fromisoformat(last),)], "ts timestamp")
    assert J.freshness(df, "ts", "2026-01-01 12:00:00").first().status == grade


# --- health and KPIs ---------------------------------------------------------------


@pytest.mark.parametrize(
    "lag,err,state,action",
    [(50000, 0.02, "healthy", "escalate"), (50001, 0.0, "degraded", "escalate"), (100001, 0.0, "critical", "restart_consumers"),
     (0, 0.11, "critical", "scale_workers"), (0, 0.1, "degraded", "escalate"), (None, None, "healthy", "escalate")],
)
def test_health_limits_are_strict(spark, lag, err, state, action):
    df = spark.createDataFrame([(lag, err)], "consumer_lag long, error_rate double")
    got = O.heal_or_escalate(O.diagnose(O.health(df))).first()
    assert (got.state, got.action) == (state, action)


def test_retry_states(spark):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("b", t, 2), ("c", t, 3)], "id string, failed_at timestamp, attempt int")
    assert rows(O.retry_schedule(df, "2026-01-01 00:00:02"), "id", "state") == [("a", "ready"), ("b", "pending"), ("c", "exhausted")]


def test_kpi_example(spark):
    t = datetime(2026, 1, 1, 0, 5)
    data = [("SUCC", 8400), ("FAIL_RADIO", 320), ("FAIL_CORE", 100), ("FAIL_AUTH", 180)]
    df = spark.createDataFrame([("area1", "s", "c", 1, t, n, v) for n, v in data],
                               "area string, spectrum string, carrier string, cell int, ts timestamp, counter string, value long")
    assert K.success_rate(df, ["area"]).first().success_pct == 93.33
    daily = K.success_rate(df.withColumn("day", F.to_date("ts")), ["day", "area"])
    assert K.sla_status(daily, ["area"], "success_pct", 95.0, 90.0).first().status == "WARNING"
    roll = K.hierarchy_rollup(df)
    assert roll.count() == 5 and {r.success_pct for r in roll.collect()} == {93.33}
    assert K.cause_breakdown(df, ["area"]).where("counter = 'FAIL_RADIO'").first().share_pct == 53.33
    assert K.success_rate(df.limit(0), ["area"]).count() == 0


def test_forecast(spark):
    df = spark.createDataFrame([("a", f"2026-01-{d:02d}", 50.0 + d) for d in range(1, 11)] + [("flat", f"2026-01-{d:02d}", 10.0) for d in range(1, 4)],
                               "k string, d string, v double").withColumn("day", F.to_date("d"))
    got = {r.k: (r.slope, r.days_left) for r in K.saturation(df, ["k"], "v").collect()}
    assert got == {"a": (1.0, 35), "flat": (0.0, None)}


def test_a_recomputed_empty_day_is_removed(spark, tmp_path):
    from tidemark.sources import tables

    path = str(tmp_path / "days")
    df = spark.createDataFrame([(1, "d1"), (2, "d2")], "v int, day string")
    tables.write_partitioned(df, path, ["day"])
    tables.refresh_partition(df.where("v > 9"), path, ["day"], replaced=[{"day": "d1"}])
    assert [tuple(r) for r in spark.read.parquet(path).select("v", "day").collect()] == [(2, "d2")]


def test_registry_keeps_key_and_value_schemas_apart(spark):
    from tidemark.sources import avro

    raw = spark.createDataFrame(
        [(("x-key", "g"), [([(1, "k")],)]), (("x-value", "g"), [([(2, "v")],)]), (("y", "g"), None)],
        "schemaMetadata struct<name:string,schemaGroup:string>, "
        "schemaBranches array<struct<schemaVersionInfos:array<struct<version:int,schemaText:string>>>>",
    )
    got = {(r.name, r.topic, r.version) for r in avro.registry_latest(raw).collect()}
    assert got == {("x-key", "x", 1), ("x-value", "x", 2), ("y", "y", 0)}


def test_a_backlog_lands_in_bounded_batches_of_few_files(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df = spark.range(600).select("id", (F.col("id") % 3).alias("month"), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("k"), "id")).alias("tags"))
    df.repartition(6).write.parquet(src)
    stream = J.stream_files(spark, src, df.schema, per_batch=2).repartition(8)
    J.land_stream(stream, out, cp, ["month"], available_now=True, files=2).awaitTermination()
    batches = [f for f in os.listdir(f"{cp}/commits") if f.isdigit()]
    assert len(batches) == 3
    for month in range(3):
        held = [f for f in os.listdir(f"{out}/month={month}") if f.endswith(".parquet")]
        assert 1 < len(held) <= 3 * 2
    assert rows(spark.read.parquet(out).select("id")) == rows(df.select("id"))


def test_schemas_are_dealt_before_they_are_sorted(spark):
    flat = spark.createDataFrame([("a-value", 3, "g", "old"), ("a-value", 2, "g", "x"), ("b-key", 1, None, "k")], "subject string, version int, schema_group string, schema_text string")
    latest = A.registry_latest(A.nest_registry(flat))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert rows(latest, "name", "topic", "schema_group", "version", "schema_text") == [("a-value", "a", "g", 3, "old"), ("b-key", "b", "Kafka", 1, "k")]
    assert "SortAggregate" in plan and plan.rindex("SortAggregate") < plan.index("Exchange")
