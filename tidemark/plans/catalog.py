"""Queries over the catalog views: search, filters, matching, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import catalog as C
from tidemark.operators import lineage as L
from tidemark.operators import shaping as H
from tidemark.plans.registry import query
from tidemark.plans.views import view, with_views
from tidemark.session import settle


def assets(spark, sf):
    return view(spark, sf, "assets")


def fields(spark, sf):
    return view(spark, sf, "asset_fields")


NORM_SQL = """norm AS (SELECT asset_id, asset_type, name, description, location,
  coalesce(storage, CASE WHEN location LIKE 'ofs://%' OR location LIKE 'o3fs://%' THEN 'ozone'
    WHEN location LIKE 's3://%' THEN 's3' WHEN location LIKE 's3a://%' OR location LIKE 's3n://%' THEN 's3a'
    WHEN regexp_matches(location, '^(adls?|abfs|wasb)://') THEN 'azure' WHEN regexp_matches(location, '^gc?s://') THEN 'gcs'
    WHEN location LIKE 'hdfs://%' THEN 'hdfs' WHEN location LIKE '/%' THEN 'local' END) AS storage,
  format_version, schema_type,
  coalesce(format, CASE WHEN format_version IS NOT NULL THEN 'iceberg' ELSE lower(schema_type) END) AS format,
  coalesce(catalog, CASE WHEN asset_type = 'iceberg_table' THEN 'hms' END) AS catalog,
  coalesce(namespace, CASE WHEN asset_type = 'iceberg_table' THEN 'default' END) AS namespace, created_ms, seed, n_fields
  FROM assets)"""
NORM = with_views("assets", extra=NORM_SQL)


@query("asset_normalize", NORM + "SELECT * FROM norm")
def _(spark, sf):
    return C.asset_normalize(assets(spark, sf))


@query("uri_scheme_to_storage", NORM + "SELECT asset_id, location, storage FROM norm")
def _(spark, sf):
    return assets(spark, sf).select("asset_id", "location", N.storage_kind("location", "storage").alias("storage"))


@query("metadata_filter", NORM + """SELECT asset_id, name, storage, format FROM norm
WHERE coalesce(storage, '') <> 'ozone' AND format = 'iceberg'""")
def _(spark, sf):
    wanted = C.intent_filters({"storage": {"value": "ozone", "negate": True}, "format": {"value": "iceberg"}})
    return C.metadata_filter(C.asset_normalize(assets(spark, sf)), wanted).select("asset_id", "name", "storage", "format")


@query("required_fields_filter", with_views("assets", "asset_fields") + """
SELECT asset_id, name FROM assets a WHERE (SELECT count(DISTINCT lower(f.name)) FROM asset_fields f
  WHERE f.asset_id = a.asset_id AND lower(f.name) IN ('customer_id', 'order_id')) = 2""")
def _(spark, sf):
    return C.required_fields(assets(spark, sf), fields(spark, sf), ["Customer_ID", "order_id"]).select("asset_id", "name")


@query("name_pattern_filter", with_views("assets") + """
SELECT asset_id, name, 'starts' AS how FROM assets WHERE lower(split_part(name, '.', -1)) LIKE 'red%'
UNION ALL SELECT asset_id, name, 'ends' FROM assets WHERE lower(split_part(name, '.', -1)) LIKE '%7'
UNION ALL SELECT asset_id, name, 'equals' FROM assets WHERE lower(split_part(name, '.', -1)) = 'red_widget_1'""")
def _(spark, sf):
    a = assets(spark, sf).select("asset_id", "name")
    found = [
        C.name_filter(a, how, text).withColumn("how", F.lit(how))
        for how, text in (("starts", "Red"), ("ends", "7"), ("equals", "red_widget_1"))
    ]
    return H.union_assets(*found)


@query("created_after_filter", with_views("assets") + """
SELECT asset_id, created_ms FROM assets
WHERE NOT (asset_type = 'iceberg_table' AND created_ms IS NOT NULL AND created_ms < 9500000000000)""")
def _(spark, sf):
    return C.created_after(assets(spark, sf), 9500000000000).select("asset_id", "created_ms")


_FUZZY_SQL = """near AS (SELECT asset_id, max(greatest(
    1 - levenshtein('invice_id', lower(name))::DOUBLE / greatest(9, length(name)),
    1 - levenshtein('shiping_address', lower(name))::DOUBLE / greatest(15, length(name)))) AS best FROM asset_fields GROUP BY 1)"""


@query("column_exists_filter", with_views("assets", "asset_fields", extra=_FUZZY_SQL) + """
SELECT a.asset_id, a.name FROM assets a LEFT JOIN near n ON n.asset_id = a.asset_id WHERE n.best IS NULL OR n.best >= 0.8""")
def _(spark, sf):
    return C.column_exists(assets(spark, sf), fields(spark, sf), ["invice_id", "shiping_address"]).select("asset_id", "name")


@query("field_family_filter", with_views("assets", "asset_fields") + """
SELECT a.asset_id, a.name FROM assets a
WHERE NOT EXISTS (SELECT 1 FROM asset_fields f WHERE f.asset_id = a.asset_id)
   OR EXISTS (SELECT 1 FROM asset_fields f WHERE f.asset_id = a.asset_id AND regexp_matches(lower(f.name),
     'lat|lon|lng|geohash|geo_hash|coordinate|gps|location|position|altitude|elevation|accuracy'))""")
def _(spark, sf):
    family = C.goal_family("tables with location data")
    return C.field_family(assets(spark, sf), fields(spark, sf), family).select("asset_id", "name")


@query("substring_search", with_views("assets") + """
SELECT asset_id, name FROM assets WHERE lower(name) LIKE '%widget%' OR lower(description) LIKE '%widget%'
  OR lower(namespace) LIKE '%widget%'""")
def _(spark, sf):
    found = C.substring_search(assets(spark, sf), ["name", "description", "namespace"], "Widget", ["name"])
    return found.select("asset_id", "name")


@query("confidence_gate", """
SELECT doc_id, score FROM (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality * 60 + d.n_chars % 40 END AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE score >= 70 OR score IS NULL""")
def _(spark, sf):
    scored = view(spark, sf, "documents").join(view(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", (F.col("quality") * 60 + F.col("n_chars") % 40).alias("score")
    )
    return C.confidence_gate(scored, "score", 70)


@query("semi_join_candidates", with_views("assets", "registry") + """
SELECT asset_id, name FROM assets a WHERE EXISTS (SELECT 1 FROM registry r WHERE a.asset_type = 'kafka_topic'
  AND a.name = regexp_replace(r.subject, '-(value|key)$', '') AND r.version >= 2)""")
def _(spark, sf):
    hits = view(spark, sf, "registry").where(F.col("version") >= 2).select(
        F.lit("kafka_topic").alias("asset_type"), N.strip_topic_suffix("subject").alias("name")
    )
    return C.restrict(assets(spark, sf), hits).select("asset_id", "name")


_PATTERNS = ["customer id", "email address", "phone number", "first name", "order date", "payment method"]


@query("cross_join_best_match", with_views("asset_fields", extra="p(rank, pattern) AS (VALUES " + ", ".join(
    f"({i}, '{p}')" for i, p in enumerate(_PATTERNS)) + """),
uniq AS (SELECT DISTINCT name FROM asset_fields),
sims AS (SELECT u.name, p.rank, p.pattern, 1 - levenshtein(u.name, p.pattern)::DOUBLE / greatest(length(u.name), length(p.pattern)) AS s
  FROM uniq u, p)""") + """
SELECT f.asset_id, f.ordinal, f.name, b.pattern, floor(b.similarity * 1000000 + 0.5) / 1000000 AS similarity
FROM asset_fields f JOIN (SELECT name, arg_max(pattern, (s, -rank)) AS pattern, max(s) AS similarity FROM sims GROUP BY name) b
  ON b.name = f.name""")
def _(spark, sf):
    from tidemark.functions.scalar import half_up

    return (
        fields(spark, sf)
        .withColumn("b", C.best_match("name", _PATTERNS))
        .select("asset_id", "ordinal", "name", "b.pattern", half_up("b.similarity", 6).alias("similarity"))
    )


@query("collect_fields", with_views("asset_fields") + """
SELECT asset_id, count(*) AS n_fields, string_agg(name, ',' ORDER BY ordinal) AS field_csv,
  string_agg(name || ' ' || type, ', ' ORDER BY ordinal) AS field_text FROM asset_fields GROUP BY asset_id""")
def _(spark, sf):
    return C.collect_fields(fields(spark, sf))


@query("asset_document", with_views("assets", "asset_fields", extra=NORM_SQL + """,
ft AS (SELECT asset_id, string_agg(name || ' ' || type, ', ' ORDER BY ordinal) AS t FROM asset_fields GROUP BY asset_id)""") + """
SELECT n.asset_id, concat_ws(' | ', asset_type || ' ' || name, 'fields: ' || t, 'description: ' || nullif(description, ''),
  'namespace: ' || namespace, 'storage ' || storage, 'format ' || format) AS document
FROM norm n LEFT JOIN ft USING (asset_id)""")
def _(spark, sf):
    return C.asset_document(assets(spark, sf), fields(spark, sf))


@query("normalize_name", with_views("asset_fields") + """
SELECT asset_id, ordinal, replace(replace(lower(name), '_', ''), '-', '') AS squashed, replace(lower(name), '-', '_') AS safe,
  split_part(asset_name, '.', -1) AS short FROM asset_fields""")
def _(spark, sf):
    return fields(spark, sf).select(
        "asset_id", "ordinal", N.squash("name").alias("squashed"), N.column_safe("name").alias("safe"),
        N.last_part("asset_name").alias("short"),
    )


_STOP = "', '".join(N.STOP_WORDS)


def _tok_sql(x: str) -> str:
    spaced = (
        f"regexp_replace(regexp_replace(lower({x}), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')"
    )
    return (
        f"list_distinct(list_filter(regexp_split_to_array({spaced}, '[^a-z0-9]+'), "
        f"lambda t: length(t) >= 2 AND NOT list_contains(['{_STOP}'], t)))"
    )


@query("tokenize", f"""SELECT doc_id, array_to_string(list_sort({_tok_sql("text")}), ' ') AS words FROM documents""")
def _(spark, sf):
    docs = view(spark, sf, "documents")
    return docs.select("doc_id", F.concat_ws(" ", F.array_sort(N.tokens("text"))).alias("words"))


@query("fuzzy_ratio", """
SELECT p_partkey, 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) AS similarity FROM part""")
def _(spark, sf):
    return view(spark, sf, "part").select("p_partkey", N.edit_similarity("p_name", "p_type").alias("similarity"))


_WORDS = "red widget 12 email"
_RANK_SQL = f"""q(w) AS (VALUES ('red'), ('widget'), ('12'), ('email')),
nt AS (SELECT asset_id, name, {_tok_sql("name")} AS toks FROM assets),
ftok AS (SELECT DISTINCT asset_id, unnest({_tok_sql("name")}) AS tok FROM asset_fields),
pts AS (SELECT nt.asset_id, nt.name, CASE WHEN list_contains(toks, w) THEN 3
    WHEN len(list_filter(toks, lambda t: contains(t, w) OR contains(w, t))) > 0 THEN 2
    WHEN EXISTS (SELECT 1 FROM ftok WHERE ftok.asset_id = nt.asset_id AND ftok.tok = q.w) THEN 1 ELSE 0 END AS p
  FROM nt, q)"""
_RANK = with_views("assets", "asset_fields", extra=_RANK_SQL) + """
SELECT asset_id, name, CAST(sum(p) AS BIGINT) AS score FROM pts GROUP BY asset_id, name HAVING sum(p) > 0
ORDER BY score DESC, name, asset_id LIMIT """


@query("keyword_rank", _RANK + "8")
def _(spark, sf):
    return C.keyword_rank(assets(spark, sf), fields(spark, sf), "find the red widget12 email table", 8)


@query("keyword_topk", _RANK + "10")
def _(spark, sf):
    return C.keyword_rank(assets(spark, sf), fields(spark, sf), _WORDS, 10)


@query("resolve_name", with_views("assets", extra="""typed AS (
  SELECT 'demo.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS typed FROM part
  UNION ALL SELECT lower(c_mktsegment) || '-events-' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT s_name FROM supplier)""") + """
SELECT t.typed, coalesce(a.asset_id, b.asset_id) AS asset_id,
  CASE WHEN a.asset_id IS NOT NULL THEN 'table' WHEN b.asset_id IS NOT NULL THEN 'topic' END AS resolved_as
FROM typed t LEFT JOIN assets a ON a.name = t.typed AND a.asset_type = 'iceberg_table'
LEFT JOIN assets b ON b.name = t.typed AND b.asset_type = 'kafka_topic'""")
def _(spark, sf):
    tables = view(spark, sf, "part").select(
        F.concat(F.lit("demo."), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("typed")
    )
    topics = view(spark, sf, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit("-events-"), F.col("c_custkey").cast("string")).alias("typed")
    )
    others = view(spark, sf, "supplier").select(F.col("s_name").alias("typed"))
    return C.resolve_names(tables.unionByName(topics).unionByName(others), assets(spark, sf))


# --- sets and schema matching ---------------------------------------------

_SETS_SQL = """sets AS (SELECT asset_id, asset_type, asset_name,
  list_sort(list_distinct(list(replace(replace(lower(name), '_', ''), '-', '')))) AS names
  FROM asset_fields GROUP BY asset_id, asset_type, asset_name)"""


@query("union_assets", with_views("assets") + """
SELECT asset_type, regexp_replace(name, '-(value|key)$', '') AS name FROM assets""")
def _(spark, sf):
    a = assets(spark, sf)
    kinds = ["kafka_topic", "iceberg_table", "ozone_volume"]
    parts = [a.where(F.col("asset_type") == k).select("asset_type", "name") for k in kinds]
    return H.union_assets(*parts).withColumn("name", N.strip_topic_suffix("name"))


@query("set_overlap", with_views("asset_fields", extra=_SETS_SQL + """,
sigs AS (SELECT asset_type, names, count(*) AS n, min(asset_id) AS first_id FROM sets GROUP BY asset_type, names)""") + """
SELECT a.first_id AS first_left, b.first_id AS first_right, a.n AS n_left, b.n AS n_right, len(list_intersect(a.names, b.names)) AS n_shared,
  array_to_string(list_sort(list_intersect(a.names, b.names)), ',') AS shared
FROM sigs a JOIN sigs b ON a.asset_type = 'kafka_topic' AND b.asset_type = 'iceberg_table' AND list_has_any(a.names, b.names)""")
def _(spark, sf):
    return C.signature_overlap(C.field_sets(fields(spark, sf)), "kafka_topic", "iceberg_table")


@query("set_difference", with_views("asset_fields", extra=_SETS_SQL) + """
SELECT asset_id, array_to_string(list_filter(['email', 'phone', 'status'], lambda x: NOT list_contains(names, x)), ',') AS missing FROM sets""")
def _(spark, sf):
    wanted = F.array(F.lit("email"), F.lit("phone"), F.lit("status"))
    return C.field_sets(fields(spark, sf)).select(
        "asset_id", F.concat_ws(",", H.missing(wanted, F.col("names"))).alias("missing")
    )


_PAIRS_SQL = _SETS_SQL + """,
sigs AS (SELECT DISTINCT asset_type, names FROM sets),
pairs AS (SELECT a.names AS left_names, b.names AS right_names,
    len(list_intersect(a.names, b.names))::DOUBLE / greatest(len(a.names), len(b.names)) AS score
  FROM sigs a JOIN sigs b ON a.asset_type = 'kafka_topic' AND b.asset_type = 'iceberg_table'
  WHERE len(list_intersect(a.names, b.names))::DOUBLE / greatest(len(a.names), len(b.names)) >= 0.5)"""


@query("schema_overlap_join", with_views("asset_fields", extra=_PAIRS_SQL) + """
SELECT array_to_string(left_names, ',') AS topic_fields, array_to_string(right_names, ',') AS table_fields,
  floor(score * 1000000 + 0.5) / 1000000 AS score FROM pairs""")
def _(spark, sf):
    from tidemark.functions.scalar import half_up

    pairs = C.similar_signatures(C.field_sets(fields(spark, sf)), "kafka_topic", "iceberg_table")
    return pairs.select(
        F.concat_ws(",", "left_names").alias("topic_fields"), F.concat_ws(",", "right_names").alias("table_fields"),
        half_up("score", 6).alias("score"),
    )


def _related_sql(left: str, right: str) -> str:
    return with_views("asset_fields", extra=_SETS_SQL + f""",
sig AS (SELECT DISTINCT names FROM sets WHERE asset_type = '{left}'),
cand AS (SELECT s.names, b.asset_id AS match_id, b.asset_name, b.names AS bn,
    len(list_intersect(s.names, b.names))::DOUBLE / greatest(len(s.names), len(b.names)) AS score
  FROM sig s JOIN sets b ON b.asset_type = '{right}'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY names ORDER BY score DESC, asset_name, match_id) AS rn
  FROM cand WHERE score >= 0.5)""") + f"""
SELECT a.asset_id, r.match_id, floor(r.score * 1000000 + 0.5) / 1000000 AS score,
  array_to_string(list_sort(list_intersect(r.names, r.bn)), ',') AS matched
FROM sets a JOIN ranked r ON a.names = r.names AND r.rn <= 3 WHERE a.asset_type = '{left}'"""


@query("schema_match", _related_sql("kafka_topic", "iceberg_table"))
def _(spark, sf):
    return C.related(fields(spark, sf), "kafka_topic", "iceberg_table")


@query("related_topk", _related_sql("iceberg_table", "kafka_topic"))
def _(spark, sf):
    return C.related(fields(spark, sf), "iceberg_table", "kafka_topic")


# --- lineage ----------------------------------------------------------------

ROOT = "my_hive.customer_1"
WALK_SQL = f"""
u1 AS (SELECT DISTINCT from_fqn AS node FROM edges WHERE to_fqn = '{ROOT}'),
u2 AS (SELECT DISTINCT from_fqn AS node FROM edges WHERE to_fqn IN (SELECT node FROM u1) EXCEPT (SELECT node FROM u1 UNION ALL SELECT '{ROOT}')),
u3 AS (SELECT DISTINCT from_fqn AS node FROM edges WHERE to_fqn IN (SELECT node FROM u2)
  EXCEPT (SELECT node FROM u1 UNION ALL SELECT node FROM u2 UNION ALL SELECT '{ROOT}')),
d1 AS (SELECT DISTINCT to_fqn AS node FROM edges WHERE from_fqn = '{ROOT}'),
d2 AS (SELECT DISTINCT to_fqn AS node FROM edges WHERE from_fqn IN (SELECT node FROM d1) EXCEPT (SELECT node FROM d1)),
walk AS (SELECT '{ROOT}' AS node, 0 AS depth UNION ALL SELECT node, -1 FROM u1 UNION ALL SELECT node, -2 FROM u2
  UNION ALL SELECT node, -3 FROM u3 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2)"""
WALK = with_views("edges", extra=WALK_SQL)


#: Services of the edge view: topics and tables under the names of their deployment.
SERVICES = L.SERVICE_TYPES | {"my_kafka": "topic", "my_hive": "table"}


def edges(spark, sf):
    return view(spark, sf, "edges")


@query("lineage_bfs", WALK + "SELECT * FROM walk")
def _(spark, sf):
    return L.lineage(edges(spark, sf), ROOT)


@query("edge_walk_join", WALK + "SELECT node FROM u2 UNION ALL SELECT node FROM u1 WHERE node IN "
       "(SELECT from_fqn FROM edges WHERE to_fqn IN (SELECT node FROM u1))")
def _(spark, sf):
    e = settle(edges(spark, sf), "edges")
    start = spark.createDataFrame([(ROOT,)], "node string")
    return L.edge_step(L.edge_step(start, e, upstream=True), e, upstream=True)


@query("lineage_neighbours", WALK + "SELECT * FROM walk WHERE abs(depth) = 1")
def _(spark, sf):
    return L.neighbours(L.lineage(edges(spark, sf), ROOT, 1, 1))


@query("union_edges_distinct", WALK + """
SELECT DISTINCT from_fqn, to_fqn FROM edges WHERE from_fqn IN (SELECT node FROM walk) AND to_fqn IN (SELECT node FROM walk)""")
def _(spark, sf):
    e = settle(edges(spark, sf), "edges")
    return L.distinct_edges(e, e, L.lineage(e, ROOT, stored=True))


@query("lineage_impact", with_views("edges", extra="""
d1 AS (SELECT DISTINCT to_fqn AS node FROM edges WHERE from_fqn = 'my_kafka.supplier_1'),
d2 AS (SELECT DISTINCT to_fqn AS node FROM edges WHERE from_fqn IN (SELECT node FROM d1)),
d3 AS (SELECT DISTINCT to_fqn AS node FROM edges WHERE from_fqn IN (SELECT node FROM d2)),
d4 AS (SELECT DISTINCT to_fqn AS node FROM edges WHERE from_fqn IN (SELECT node FROM d3)),
d5 AS (SELECT DISTINCT to_fqn AS node FROM edges WHERE from_fqn IN (SELECT node FROM d4)),
down AS (SELECT node, 1 AS depth FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3
  UNION ALL SELECT node, 4 FROM d4 UNION ALL SELECT node, 5 FROM d5),
attrs AS (SELECT 'my_hive.customer_' || CAST(c_custkey AS VARCHAR) AS node, c_mktsegment AS owner FROM customer)""") + """
SELECT node, depth, owner, CASE WHEN node LIKE 'dbt.%' THEN 'pipeline' WHEN node LIKE 'looker.%' OR node LIKE 'superset.%'
  THEN 'dashboard' ELSE 'table' END AS entity_type FROM down LEFT JOIN attrs USING (node)""")
def _(spark, sf):
    owners = view(spark, sf, "customer").select(
        F.concat(F.lit("my_hive.customer_"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("owner")
    )
    return L.impact(edges(spark, sf), "my_kafka.supplier_1", owners, services=SERVICES)


@query("entity_type_infer", with_views("edges") + """
SELECT DISTINCT from_fqn, CASE split_part(from_fqn, '.', 1) WHEN 'my_kafka' THEN 'topic' WHEN 'dbt' THEN 'pipeline'
  WHEN 'looker' THEN 'dashboard' ELSE 'table' END AS entity_type FROM edges""")
def _(spark, sf):
    return edges(spark, sf).select("from_fqn").distinct().withColumn("entity_type", L.entity_type("from_fqn", services=SERVICES))


@query("record_usage", """
SELECT 'table_' || CAST(user_id AS VARCHAR) AS asset, CAST(ts AS DATE) AS day, count(*) AS queries FROM events GROUP BY 1, 2""")
def _(spark, sf):
    log = view(spark, sf, "scores")
    return L.usage_daily(log, "asset", "ts")


@query("usage_rank", """
SELECT 'table_' || CAST(user_id AS VARCHAR) AS asset, count(*) AS queries, rank() OVER (ORDER BY count(*) DESC) AS popularity_rank
FROM events GROUP BY 1""")
def _(spark, sf):
    return L.usage_rank(view(spark, sf, "scores"), "asset")


@query("lineage_edges_from_jobs", with_views("edges") + """
SELECT from_fqn, to_fqn, CASE WHEN from_fqn LIKE 'looker.%' THEN 'rebuilt' ELSE pipeline END AS pipeline,
  CASE WHEN from_fqn LIKE 'looker.%' THEN 2 ELSE 1 END AS built_at FROM edges
UNION ALL SELECT 'superset.region_' || CAST(r_regionkey AS VARCHAR), 'mail.' || lower(r_name), 'rebuilt', 2 FROM region""")
def _(spark, sf):
    e = edges(spark, sf).withColumn("built_at", F.lit(1))
    rebuilt = e.where(F.col("from_fqn").startswith("looker.")).select(
        "from_fqn", "to_fqn", F.lit("rebuilt").alias("pipeline"), F.lit(2).alias("built_at")
    )
    fresh = view(spark, sf, "region").select(
        F.concat(F.lit("superset.region_"), F.col("r_regionkey").cast("string")).alias("from_fqn"),
        F.concat(F.lit("mail."), F.lower("r_name")).alias("to_fqn"),
        F.lit("rebuilt").alias("pipeline"), F.lit(2).alias("built_at"),
    )
    return L.add_edges(e, rebuilt.unionByName(fresh))
