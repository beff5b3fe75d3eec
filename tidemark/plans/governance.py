"""Queries on personal data, sensitivity, policies, masking and semantic mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import governance as G
from tidemark.operators import shaping as H
from tidemark.plans.registry import query
from tidemark.plans.views import AS_OF, view, with_views
from tidemark.sources import avro as A


def fields(spark, sf):
    return view(spark, sf, "asset_fields")


@query("pii_exact", with_views("asset_fields") + """
SELECT asset_id, bool_or(lower(name) IN ('email', 'ssn', 'social_security', 'phone', 'dob', 'date_of_birth', 'member_id',
  'patient_id', 'credit_card')) AS pii_risk FROM asset_fields GROUP BY asset_id""")
def _(spark, sf):
    return G.pii_exact(fields(spark, sf))


_WORD_RE = "|".join(sorted({w.replace("_", "") for w in G.PII_WORDS}))


@query("pii_keyword", with_views("asset_fields") + f"""
SELECT asset_id, ordinal, name, regexp_matches(replace(replace(lower(name), '_', ''), '-', ''), '{_WORD_RE}') AS pii_risk
FROM asset_fields""")
def _(spark, sf):
    return G.pii_keyword(fields(spark, sf)).select("asset_id", "ordinal", "name", "pii_risk")


@query("pii_pattern_fallback", with_views("asset_fields", extra="p(rank, phrase) AS (VALUES " + ", ".join(
    f"({i}, '{p}')" for i, p in enumerate(G.PII_PHRASES)) + """),
uniq AS (SELECT DISTINCT lower(name) AS n FROM asset_fields),
m AS (SELECT n, arg_min(phrase, rank) AS match FROM uniq, p WHERE contains(n, phrase) OR contains(phrase, n) GROUP BY n)""") + """
SELECT asset_id, ordinal, name, coalesce(match, '') AS match, match IS NOT NULL AS is_pii,
  CASE WHEN match IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
FROM asset_fields LEFT JOIN m ON m.n = lower(name)""")
def _(spark, sf):
    return G.pii_fallback(fields(spark, sf)).select("asset_id", "ordinal", "name", "match", "is_pii", "confidence")


def _share(c, p):
    return f"floor(count(*) FILTER (WHERE regexp_matches({c}, '{p}'))::DOUBLE / count({c}) * 10000 + 0.5) / 10000"


_VALUE_RE = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "ipv4": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
    "uuid": "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "url": "^(https?|s3a?|hdfs)://", "phone": "^[+]?[0-9 ()-]{7,20}$",
}


@query("pii_values", with_views("signals") + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null, """ + ", ".join(f"{_share(c, p)} AS {k}" for k, p in _VALUE_RE.items())
    + " FROM signals" for c in ("email", "ip_address", "note")))
def _(spark, sf):
    return G.pii_values(view(spark, sf, "signals"), ["email", "ip_address", "note"])


_TEXT_SQL = ", ".join(f"len(regexp_extract_all({{c}}, '{p}')) AS n_{k}" for k, p in G.TEXT_PATTERNS.items()).replace("{c}", "@@")


@query("pii_in_documents", "SELECT doc_id, " + _TEXT_SQL.replace("@@", "text") + " FROM documents")
def _(spark, sf):
    return G.pii_in_text(view(spark, sf, "documents"), "doc_id", "text")


@query("pii_in_pages", "SELECT page_id, " + _TEXT_SQL.replace("@@", "html") + " FROM pages")
def _(spark, sf):
    return G.pii_in_text(view(spark, sf, "pages"), "page_id", "html")


LEVEL_SQL = """levels AS (SELECT asset_id, CASE
    WHEN bool_or(regexp_matches(lower(name), 'ssn|credit_card|passport')) THEN 'confidential'
    WHEN bool_or(regexp_matches(lower(name), 'email|phone|latitude|longitude|address|geolocation')) THEN 'restricted'
    ELSE 'internal' END AS sensitivity FROM asset_fields GROUP BY asset_id)"""
LEVELS = with_views("asset_fields", extra=LEVEL_SQL)


def levels(spark, sf):
    return G.classify(fields(spark, sf))


@query("sensitivity_classify", LEVELS + "SELECT * FROM levels")
def _(spark, sf):
    return levels(spark, sf)


@query("policy_assign", LEVELS + """
SELECT asset_id, sensitivity, CASE sensitivity WHEN 'confidential' THEN '7y' WHEN 'restricted' THEN '90d' ELSE '1y' END AS retention,
  sensitivity AS access_level, sensitivity = 'confidential' AS require_approval,
  CASE sensitivity WHEN 'confidential' THEN 'data-governance-team' WHEN 'restricted' THEN 'data-steward' ELSE 'data-team' END AS owner
FROM levels""")
def _(spark, sf):
    return G.assign_policy(levels(spark, sf))


@query("sensitivity_summary", LEVELS + """
SELECT l.sensitivity, count(x.asset_id) AS n_assets
FROM (VALUES ('confidential'), ('restricted'), ('internal'), ('public')) l(sensitivity) LEFT JOIN levels x USING (sensitivity) GROUP BY 1""")
def _(spark, sf):
    return G.sensitivity_summary(levels(spark, sf))


_PATS = [w for _, ws in G.LEVEL_WORDS for w in ws]


@query("classification_reason", with_views("asset_fields", extra="p(pno, w) AS (VALUES " + ", ".join(
    f"({i}, '{w}')" for i, w in enumerate(_PATS)) + """),
hit AS (SELECT f.asset_id, f.ordinal, lower(f.name) AS n, p.pno FROM asset_fields f JOIN p ON contains(lower(f.name), p.w)),
firsts AS (SELECT *, min(pno) OVER (PARTITION BY asset_id) AS best FROM hit),
named AS (SELECT asset_id, best, n, ordinal, row_number() OVER (PARTITION BY asset_id ORDER BY ordinal, n) AS rn FROM firsts WHERE pno = best),
txt AS (SELECT asset_id, min(best) AS best, string_agg(n, ', ' ORDER BY ordinal, n) AS t FROM named WHERE rn <= 3 GROUP BY asset_id)""") + """
SELECT a.asset_id, CASE WHEN t IS NULL THEN 'No high-risk PII detected' WHEN best < 3 THEN 'Contains sensitive fields: ' || t
  ELSE 'Contains PII fields: ' || t END AS reason FROM (SELECT DISTINCT asset_id FROM asset_fields) a LEFT JOIN txt USING (asset_id)""")
def _(spark, sf):
    return G.explain(fields(spark, sf))


@query("metadata_coverage", LEVELS + f"""
SELECT f.asset_id, count(*) AS total_fields,
  count(*) FILTER (WHERE regexp_matches(replace(replace(lower(name), '_', ''), '-', ''), '{_WORD_RE}')) AS pii_fields,
  1.0::DOUBLE AS typed_share, any_value(l.sensitivity) AS sensitivity
FROM asset_fields f JOIN levels l USING (asset_id) GROUP BY f.asset_id""".replace("{_WORD_RE}", _WORD_RE))
def _(spark, sf):
    return G.coverage(fields(spark, sf), levels(spark, sf))


@query("feedback_learn", LEVELS[:-1] + """,
fb AS (SELECT asset_id, CASE WHEN namespace = 'sales' THEN 'public' ELSE 'accept_guess' END AS feedback FROM assets WHERE namespace IS NOT NULL)
SELECT l.asset_id, l.sensitivity AS original_guess, coalesce(nullif(fb.feedback, 'accept_guess'), l.sensitivity) AS sensitivity,
  coalesce(nullif(fb.feedback, 'accept_guess') <> l.sensitivity, false) AS corrected FROM levels l LEFT JOIN fb USING (asset_id)""")
def _(spark, sf):
    said = view(spark, sf, "assets").where(F.col("namespace").isNotNull()).select(
        "asset_id", F.when(F.col("namespace") == "sales", "public").otherwise("accept_guess").alias("feedback")
    )
    return G.apply_feedback(levels(spark, sf), said)


@query("mask_pii", """
SELECT c_custkey, sha256(c_name) AS c_name, '***' AS c_mktsegment,
  'tok_' || substr(sha256('k1' || sha256('k1' || CAST(c_nationkey AS VARCHAR))), 1, 24) AS c_nationkey FROM customer""")
def _(spark, sf):
    df = view(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    masked = G.mask(G.mask(df, ["c_name"], "hash"), ["c_mktsegment"], "redact")
    return G.mask(masked, ["c_nationkey"], "tokenise", key="k1")


@query("mask_pii_encrypt", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    key = "0123456789abcdef"
    df = G.mask(view(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"], "encrypt", key=key)
    return df.withColumn("c_name", F.aes_decrypt(F.unbase64("c_name"), F.lit(key)).cast("string"))


@query("retention_filter", f"""
SELECT o_orderkey, 'restricted' AS level FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY
UNION ALL SELECT o_orderkey, 'internal' FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH
UNION ALL SELECT o_orderkey, 'confidential' FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 84 MONTH
UNION ALL SELECT o_orderkey, 'public' FROM orders""")
def _(spark, sf):
    o = view(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    kept = [
        G.retain(o, "o_orderdate", level, AS_OF).select("o_orderkey", F.lit(level).alias("level"))
        for level in ("restricted", "internal", "confidential", "public")
    ]
    return H.union_assets(*kept)


ENTITY_SQL = """ent AS (SELECT asset_id, ordinal, name, CASE
    WHEN regexp_matches(lower(name), 'customer_id|customer_name|email') OR contains('customer_id', lower(name))
      OR contains('customer_name', lower(name)) OR contains('email', lower(name)) THEN 'customer'
    WHEN regexp_matches(lower(name), 'order_id|amount|timestamp|status') OR contains('order_id', lower(name))
      OR contains('amount', lower(name)) OR contains('timestamp', lower(name)) OR contains('status', lower(name)) THEN 'transaction'
    WHEN regexp_matches(lower(name), 'product_id|product_name|category|price') OR contains('product_id', lower(name))
      OR contains('product_name', lower(name)) OR contains('category', lower(name)) OR contains('price', lower(name)) THEN 'product'
    END AS entity FROM asset_fields),
mapped AS (SELECT *, CASE entity WHEN 'customer' THEN 'customer_id' WHEN 'transaction' THEN 'order_id' ELSE 'product_id' END AS mapped_to,
  0.9::DOUBLE AS confidence FROM ent WHERE entity IS NOT NULL)"""
MAPPED = with_views("asset_fields", extra=ENTITY_SQL)


def mapped(spark, sf):
    return G.map_fields(fields(spark, sf).select("asset_id", "ordinal", "name"))


@query("semantic_field_map", MAPPED + "SELECT * FROM mapped")
def _(spark, sf):
    return mapped(spark, sf)


_CONFLICT_SQL = """
SELECT a.asset_id, CASE WHEN a.entity = b.entity THEN 'ambiguous_mapping' ELSE 'metric_conflict' END AS type,
  CASE WHEN a.entity = b.entity THEN 'warning' ELSE 'info' END AS severity, a.name AS field1, b.name AS field2,
  a.entity AS entity1, b.entity AS entity2
FROM mapped a JOIN mapped b ON a.asset_id = b.asset_id AND a.ordinal < b.ordinal
WHERE a.entity = b.entity AND (contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)))
   OR a.entity <> b.entity AND (contains(lower(a.name), 'amount') AND contains(lower(b.name), 'amount')
     OR contains(lower(a.name), 'date') AND contains(lower(b.name), 'date') OR contains(lower(a.name), 'id') AND contains(lower(b.name), 'id'))"""


@query("mapping_conflicts", MAPPED + _CONFLICT_SQL)
def _(spark, sf):
    return G.mapping_conflicts(mapped(spark, sf))


@query("self_join_conflicts", MAPPED + "SELECT type, entity1, entity2, count(*) AS n_pairs FROM (" + _CONFLICT_SQL + ") GROUP BY ALL")
def _(spark, sf):
    return H.group_count(G.mapping_conflicts(mapped(spark, sf)), ["type", "entity1", "entity2"], "n_pairs")


@query("suggest_metrics", """
SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(20,6))) AS DOUBLE) AS total_revenue FROM orders""")
def _(spark, sf):
    return G.suggest_metrics(view(spark, sf, "orders"))


@query("suggest_metrics_active", f"""
SELECT count(DISTINCT o_custkey) AS active_customers FROM orders WHERE o_orderdate > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def _(spark, sf):
    return G.active_customers(view(spark, sf, "orders"), "o_custkey", "o_orderdate", AS_OF)


# --- registry ----------------------------------------------------------------

_AVRO_SQL = """parsed AS (SELECT subject, version, CASE WHEN json_valid(schema_text) THEN schema_text::JSON END AS j FROM registry),
fl AS (SELECT subject, version, unnest(coalesce(CAST(j->'$.fields' AS JSON[]), []::JSON[])) AS f, j FROM parsed),
fields AS (SELECT subject, version, f->>'$.name' AS name, CASE WHEN json_type(f->'$.type') = 'VARCHAR' THEN f->>'$.type'
  ELSE CAST(f->'$.type' AS VARCHAR) END AS type FROM fl)"""


@query("avro_fields", with_views("registry", extra=_AVRO_SQL) + """
SELECT p.subject, coalesce(p.j->>'$.namespace', '') AS namespace, coalesce(n.n_fields, 0) AS n_fields, coalesce(n.names, '') AS names
FROM parsed p LEFT JOIN (SELECT subject, count(*) AS n_fields, string_agg(name, ',' ORDER BY name) AS names FROM fields GROUP BY 1) n
USING (subject)""")
def _(spark, sf):
    parsed = A.avro_fields(view(spark, sf, "registry"), "schema_text")
    return parsed.select(
        "subject", "namespace", F.size("fields").alias("n_fields"),
        F.concat_ws(",", F.array_sort(F.transform("fields", lambda f: f["name"]))).alias("names"),
    )


@query("avro_type_map", with_views("registry", extra=_AVRO_SQL) + f"""
SELECT subject, name AS source_field, replace(lower(name), '-', '_') AS column_name,
  CASE WHEN type LIKE '[%' THEN 'string' WHEN type LIKE '{{%' THEN 'timestamp' WHEN type = 'long' THEN 'bigint' ELSE type END AS table_type,
  type LIKE '[%' AS nullable, regexp_matches(replace(replace(lower(name), '_', ''), '-', ''), '{_WORD_RE}') AS pii_risk FROM fields""")
def _(spark, sf):
    mapping = A.avro_type_map(view(spark, sf, "registry"), "schema_text")
    return mapping.select("subject", "source_field", "column_name", "table_type", "nullable", "pii_risk")


@query("registry_latest", with_views("registry") + """
SELECT subject AS name, regexp_replace(subject, '-(value|key)$', '') AS topic, schema_group, version, schema_text FROM registry""")
def _(spark, sf):
    return A.registry_latest(A.nest_registry(view(spark, sf, "registry")))


@query("registry_stats", with_views("registry") + """
SELECT schema_group, count(*) AS n_schemas, max(updated_ms) AS last_indexed_ms, max(updated_ms) < 1000000 AS is_stale
FROM registry GROUP BY schema_group""")
def _(spark, sf):
    return A.registry_stats(view(spark, sf, "registry"), as_of_ms=1_600_000, ttl_ms=600_000)


@query("group_count", with_views("registry") + "SELECT schema_group, count(*) AS n FROM registry GROUP BY 1")
def _(spark, sf):
    return H.group_count(view(spark, sf, "registry"), ["schema_group"])


@query("confluent_frame", "SELECT event_id, 1 + event_id % 70000 AS schema_id, props AS payload, false AS dead FROM events WHERE value <= 50 "
       "UNION ALL SELECT event_id, NULL, NULL, true FROM events WHERE value > 50")
def _(spark, sf):
    ev = view(spark, sf, "events")
    framed = A.frame(F.lit(1) + F.col("event_id") % 70000, F.col("props"))
    messages = ev.select("event_id", F.when(F.col("value") > 50, F.col("props").cast("binary")).otherwise(framed).alias("value"))
    good, dead = A.split_frames(messages, "value")
    return good.select("event_id", "schema_id", F.col("payload").cast("string").alias("payload"), F.lit(False).alias("dead")).unionByName(
        dead.select("event_id", F.lit(None).cast("long").alias("schema_id"), F.lit(None).cast("string").alias("payload"), F.lit(True).alias("dead"))
    )


@query("json_schema_infer", """
SELECT * FROM (VALUES ('user_id', 'int'), ('event_type', 'str'), ('value', 'float'), ('big', 'bool')) v(name, types)""")
def _(spark, sf):
    ev = view(spark, sf, "events")
    body = F.to_json(F.struct("user_id", "event_type", "value", (F.col("value") > 9).alias("big"), F.col("event_id").alias("_offset")))
    return A.json_schema(ev.select(body.alias("body")), "body").select("name", F.concat_ws(",", "types").alias("types"))


