import random
import re

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import catalog as C
from tidemark.operators import governance as G
from tidemark.operators import shaping as H


@pytest.fixture(scope="module")
def shop(spark):
    """Four assets on different storage, three of them with a position field."""
    assets = spark.createDataFrame(
        [
            ("o", "iceberg_table", "demo.orders", "ofs://volume/orders", None, "2", None, None, None, None, 5),
            ("c", "iceberg_table", "demo.customers", "s3a://bucket/customers", None, "2", None, None, None, None, None),
            ("p", "iceberg_table", "demo.products", "hdfs:///products", "", None, None, None, "rest", "shop", 50),
            ("s", "kafka_topic", "shipments", "o3fs://volume/shipments", None, None, "AVRO", None, None, None, 1),
        ],
        "asset_id string, asset_type string, name string, location string, storage string, format_version string, "
        "schema_type string, format string, catalog string, namespace string, created_ms long",
    )
    fields = spark.createDataFrame(
        [("o", 0, "order_id"), ("o", 1, "geolocation"), ("c", 0, "Customer_ID"), ("c", 1, "GeoLocation"),
         ("p", 0, "product_id"), ("p", 1, "name"), ("s", 0, "shipment_id"), ("s", 1, "geolocation")],
        "asset_id string, ordinal int, name string",
    ).withColumn("type", F.lit("string"))
    return assets, fields


def test_negated_storage_and_required_field(shop):
    assets, fields = shop
    wanted = C.intent_filters({"storage": {"value": "ozone", "negate": True}, "format": None})
    assert wanted == {"storage": "!ozone"}
    left = C.metadata_filter(C.asset_normalize(assets), wanted)
    assert rows(C.required_fields(left, fields, ["geolocation"]), "name") == [("demo.customers",)]


def test_missing_property(shop):
    assets, _ = shop
    norm = C.asset_normalize(assets)
    assert rows(C.metadata_filter(norm, {"format": "!avro"}), "asset_id") == [("c",), ("o",), ("p",)]
    assert rows(C.metadata_filter(norm, {"format": "avro"}), "asset_id") == [("s",)]
    got = {r.asset_id: (r.storage, r.format, r.catalog, r.namespace) for r in norm.collect()}
    assert got["p"] == ("hdfs", None, "rest", "shop") and got["o"] == ("ozone", "iceberg", "hms", "default")
    assert got["s"] == ("ozone", "avro", None, None)


@pytest.mark.parametrize(
    "uri,kind",
    [("ofs://a", "ozone"), ("o3fs://a", "ozone"), ("s3://a", "s3"), ("s3a://a", "s3a"), ("s3n://a", "s3a"), ("adl://a", "azure"),
     ("adls://a", "azure"), ("abfs://a", "azure"), ("abfss://a", None), ("wasb://a", "azure"), ("gs://a", "gcs"), ("gcs://a", "gcs"),
     ("hdfs://a", "hdfs"), ("/a", "local"), ("", None), (None, None)],
)
def test_storage_kind(spark, uri, kind):
    df = spark.createDataFrame([(uri, "")], "u string, s string")
    assert df.select(N.storage_kind("u", "s").alias("k")).first().k == kind
    assert df.select(N.storage_kind("u", F.lit("set")).alias("k")).first().k == "set"


def test_name_and_time_filters(shop):
    assets, _ = shop
    assert rows(C.name_filter(assets, "starts", "ORD"), "asset_id") == [("o",)]
    assert rows(C.name_filter(assets, "ends", "s"), "asset_id") == [("c",), ("o",), ("p",), ("s",)]
    assert rows(C.name_filter(assets, "equals", "Products"), "asset_id") == [("p",)]
    assert rows(C.created_after(assets, 10), "asset_id") == [("c",), ("p",), ("s",)]
    with pytest.raises(ValueError):
        C.name_filter(assets, "like", "x")


def test_column_and_family_filters(shop):
    assets, fields = shop
    assert rows(C.column_exists(assets, fields, ["ordr_id"]), "asset_id") == [("o",)]
    assert C.column_exists(assets, fields, []).count() == 4
    assert C.column_exists(assets, fields.where("asset_id = 'p'"), ["zzzzzzz"]).count() == 3
    assert rows(C.field_family(assets, fields, C.goal_family("tables with GPS data")), "asset_id") == [("c",), ("o",), ("s",)]
    assert C.goal_family("anything") is None and C.field_family(assets, fields, None).count() == 4


def test_search_treats_wildcards_literally(spark):
    df = spark.createDataFrame([("a_b", None), ("axb", "100%")], "name string, note string")
    assert rows(C.substring_search(df, ["name", "note"], "A_B", ["name"]), "name") == [("a_b",)]
    assert rows(C.substring_search(df, ["name", "note"], "%", ["name"]), "name") == [("axb",)]


def test_confidence(spark):
    df = spark.createDataFrame([(69.9,), (70.0,), (None,)], "score double")
    assert C.confidence_gate(df, "score", 70).count() == 2
    assert C.uncertain(df.select((F.col("score") / 100).alias("score")), "score").count() == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abAB019 _-.é", max_size=24), min_size=1, max_size=8))
def test_tokens_equal_python_rule(spark, texts):
    def words(text):
        runs = re.findall("[a-z]+|[0-9]+", text.lower())
        return {w for w in runs if len(w) > 1} - set(N.STOP_WORDS)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: set(r.w) for r in df.select("i", N.tokens("t").alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == words(t), t


def test_keyword_scores(spark):
    assets = spark.createDataFrame([("1", "red widget"), ("2", "redder"), ("3", "other"), ("4", "nothing")], "asset_id string, name string")
    fields = spark.createDataFrame([("3", "red_flag"), ("4", "blue")], "asset_id string, name string")
    got = C.keyword_rank(assets, fields, "find red widget", 8)
    assert [(r.asset_id, r.score) for r in got.collect()] == [("1", 6), ("2", 2), ("3", 1)]
    assert C.keyword_rank(assets, fields, "show me the table", 2).count() == 2


def brute_related(sets, left, right, threshold, k):
    out = {}
    for a, (ta, na, fa) in sets.items():
        if ta != left or not fa:
            continue
        scored = []
        for b, (tb, nb, fb) in sets.items():
            if tb == right and fb:
                s = len(fa & fb) / max(len(fa), len(fb))
                if s >= threshold:
                    scored.append((-s, nb, b))
        out[a] = [b for _, _, b in sorted(scored)[:k]]
    return {a: v for a, v in out.items() if v}


@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.75, 1.0])
def test_schema_match_equals_brute_force_with_hot_names_and_copies(spark, threshold):
    rng = random.Random(3)
    words = ["id", "name", "ts"] + [f"w{i}" for i in range(12)]
    sets, data = {}, []
    for i in range(240):
        kind = "kafka_topic" if i % 2 else "iceberg_table"
        # a third are copies of one schema, "id" is in nearly all the others
        picked = {"id", "name", "w1"} if i % 3 == 0 else {"id", *rng.sample(words, rng.randint(1, 6))}
        sets[f"a{i}"] = (kind, f"n{i % 50}", picked)
        data += [(f"a{i}", kind, f"n{i % 50}", w.upper() if i % 4 == 0 else w) for w in picked]
    fields = spark.createDataFrame(data, "asset_id string, asset_type string, asset_name string, name string")
    got = {}
    found = C.related(fields, "kafka_topic", "iceberg_table", threshold, 3).collect()
    for r in found:
        got.setdefault(r.asset_id, set()).add(r.match_id)
    want = {a: set(v) for a, v in brute_related(sets, "kafka_topic", "iceberg_table", threshold, 3).items()}
    assert got == want
    for r in found:
        fa, fb = sets[r.asset_id][2], sets[r.match_id][2]
        assert r.matched == ",".join(sorted(fa & fb))


def test_best_match_first_pattern_wins_ties(spark):
    df = spark.createDataFrame([("abc",)], "n string").select(C.best_match("n", ["abx", "aby"]).alias("b"))
    assert df.first().b.pattern == "abx"


def test_resolve_prefers_tables(spark):
    assets = spark.createDataFrame([("t", "iceberg_table", "x"), ("k", "kafka_topic", "x"), ("k2", "kafka_topic", "y")],
                                   "asset_id string, asset_type string, name string")
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "typed string")
    assert rows(C.resolve_names(names, assets)) == [("x", "t", "table"), ("y", "k2", "topic"), ("z", None, None)]


def test_set_helpers(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = df.select(H.overlap(F.col("a"), F.col("b")).alias("o"), H.missing(F.col("a"), F.col("b")).alias("m")).first()
    assert (got.o, got.m) == (["b"], ["a"])


# --- governance ---------------------------------------------------------------


def test_pii_words_normalise_both_sides(spark):
    df = spark.createDataFrame([("Credit-Card",), ("first_name",), ("creditcardno",), ("quantity",)], "name string")
    got = {r.name: r.p for r in df.select("name", G.is_pii_word("name").alias("p")).collect()}
    assert got == {"Credit-Card": True, "first_name": True, "creditcardno": True, "quantity": False}


def test_phrase_both_ways(spark):
    df = spark.createDataFrame([("dob",), ("ssn_last4",), ("number",), ("zzz",)], "name string")
    got = {r.name: r.match for r in G.pii_fallback(df).collect()}
    assert got == {"dob": "dob", "ssn_last4": "ssn", "number": "social security number", "zzz": ""}


def test_strictest_level_and_reason(spark):
    data = [("a", 0, "Passport_No"), ("a", 1, "email"), ("b", 0, "phone1"), ("b", 1, "phone2"), ("b", 2, "phone3"), ("b", 3, "phone4"), ("c", 0, "qty")]
    f = spark.createDataFrame(data, "asset_id string, ordinal int, name string")
    assert rows(G.classify(f)) == [("a", "confidential"), ("b", "restricted"), ("c", "internal")]
    assert rows(G.explain(f)) == [
        ("a", "Contains sensitive fields: passport_no"), ("b", "Contains PII fields: phone1, phone2, phone3"), ("c", "No high-risk PII detected"),
    ]
    assert rows(G.sensitivity_summary(G.classify(f))) == [("confidential", 1), ("internal", 1), ("public", 0), ("restricted", 1)]


def test_policy_unknown_is_internal(spark):
    df = spark.createDataFrame([("secret",), ("public",)], "sensitivity string")
    got = {r.sensitivity: (r.retention, r.access_level, r.require_approval) for r in G.assign_policy(df).collect()}
    assert got == {"secret": ("1y", "internal", False), "public": ("indefinite", "public", False)}


def test_mask_keeps_nulls_and_needs_a_key(spark):
    df = spark.createDataFrame([("x",), (None,)], "v string")
    for how in ("hash", "redact", "tokenise", "encrypt"):
        got = [r.v for r in G.mask(df, ["v"], how, key="0123456789abcdef").collect()]
        assert got[0] not in ("x", None) and got[1] is None
    with pytest.raises(ValueError):
        G.mask(df, ["v"], "tokenise")
    with pytest.raises(ValueError):
        G.mask(df, ["v"], "blur")


def test_semantic_mapping_and_conflicts(spark):
    names = ["customer_id", "customer_email", "email_address", "order_id", "sale_amount", "total_amount", "purchase_date", "transaction_timestamp"]
    f = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "asset_id string, ordinal int, name string")
    mapped = G.map_fields(f)
    got = {r.name: r.entity for r in mapped.collect()}
    assert got == {
        "customer_id": "customer", "customer_email": "customer", "email_address": "customer", "order_id": "transaction",
        "sale_amount": "transaction", "total_amount": "transaction", "transaction_timestamp": "transaction",
    }
    assert rows(G.mapping_conflicts(mapped), "type", "field1", "field2") == [("metric_conflict", "customer_id", "order_id")]


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(5)
    parts = ["id", "email", "amount", "date", "order_id", "status", "price", "customer_id", "x"]
    data = [(f"a{a}", i, "_".join(rng.sample(parts, rng.randint(1, 3)))) for a in range(12) for i in range(8)]
    data.append(("a0", 8, data[0][2]))  # the same name twice
    mapped = G.map_fields(spark.createDataFrame(data, "asset_id string, ordinal int, name string")).cache()
    want = []
    by_asset = {}
    for r in mapped.collect():
        by_asset.setdefault(r.asset_id, []).append(r)
    for a, fs in by_asset.items():
        fs.sort(key=lambda r: r.ordinal)
        for i, x in enumerate(fs):
            for y in fs[i + 1:]:
                if x.entity == y.entity and (x.name in y.name or y.name in x.name):
                    want.append((a, "ambiguous_mapping", x.name, y.name))
                if x.entity != y.entity and any(w in x.name and w in y.name for w in ("amount", "date", "id")):
                    want.append((a, "metric_conflict", x.name, y.name))
    assert rows(G.mapping_conflicts(mapped), "asset_id", "type", "field1", "field2") == sorted(want)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 2.5), (1, 2.5), (2, 1.0)], "customer_id long, total_amount double")
    assert G.pick_metrics(df.columns) == {"total_revenue": "total_amount", "unique_entities": "customer_id"}
    assert rows(G.suggest_metrics(df)) == [(6.0, 2)]
    with pytest.raises(ValueError):
        G.suggest_metrics(df.select(F.lit(1).alias("x")))


def test_feedback(spark):
    c = spark.createDataFrame([("a", "internal"), ("b", "internal")], "asset_id string, sensitivity string")
    f = spark.createDataFrame([("a", "restricted"), ("b", "accept_guess")], "asset_id string, feedback string")
    assert rows(G.apply_feedback(c, f), "asset_id", "sensitivity", "corrected") == [("a", "restricted", True), ("b", "internal", False)]


def test_text_patterns_count_whole_texts(spark):
    text = "x " * 50_000 + "mail a@b.io and c@d.org from 10.0.0.1"
    got = G.pii_in_text(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").first()
    assert (got.n_email, got.n_ipv4) == (2, 1) and len(re.findall("@", text)) == 2
