"""Queries over the stored search index of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import search_index as S
from tidemark.plans.catalog import _tok_sql
from tidemark.plans.registry import query
from tidemark.plans.views import view, with_views
from tidemark.session import scratch_path


def index(spark, sf) -> S.Index:
    """The index of all assets, built at once."""
    path = scratch_path(spark, "search-index")
    S.build(path, view(spark, sf, "assets"), view(spark, sf, "asset_fields"))
    return S.Index(spark, path)


def grown_index(spark, sf) -> S.Index:
    """The same in steps: tables and volumes, topics under an old name with ids that go, then the topics as they are."""
    path = scratch_path(spark, "search-index")
    assets, fields = view(spark, sf, "assets"), view(spark, sf, "asset_fields")
    is_topic = F.col("asset_type") == "kafka_topic"
    S.build(path, assets.where(~is_topic), fields)
    topics = assets.where(is_topic)
    old = topics.withColumns({"name": F.concat(F.lit("old email "), "name"), "description": F.lit("geolocation")})
    unused = old.withColumn("asset_id", F.concat(F.lit("gone-"), "asset_id"))
    S.update(path, old.unionByName(unused), fields)
    S.update(path, topics, fields, removed=unused.select("asset_id"))
    return S.Index(spark, path)


def typed_texts(spark, sf):
    """Part names, each also without its last letter and in the plural."""
    name = F.col("p_name")
    forms = F.array(name, name.substr(F.lit(1), F.length(name) - 1), F.concat(name, F.lit("s")))
    return view(spark, sf, "part").select(F.explode(forms).alias("query")).distinct()


_TYPED_SQL = """typed AS (SELECT DISTINCT unnest([p_name, substr(p_name, 1, length(p_name) - 1), p_name || 's']) AS query FROM part)"""


def _points_sql(typed: str, text: str) -> str:
    return f"""
qw AS (SELECT {text}, unnest({_tok_sql(text)}) AS w FROM (SELECT DISTINCT {text} FROM {typed} WHERE {text} IS NOT NULL)),
words AS (SELECT DISTINCT w FROM qw),
nt AS (SELECT asset_id, name, {_tok_sql("name")} AS toks FROM assets),
ftok AS (SELECT DISTINCT asset_id, unnest({_tok_sql("name")}) AS tok FROM asset_fields),
pts AS (SELECT w, asset_id, name, max(p) AS p FROM (
    SELECT w, asset_id, name, CASE WHEN t = w THEN 3 ELSE 2 END AS p
    FROM (SELECT asset_id, name, unnest(toks) AS t FROM nt) JOIN words ON contains(t, w) OR contains(w, t)
    UNION ALL SELECT w, nt.asset_id, nt.name, 1 FROM nt JOIN ftok USING (asset_id) JOIN words ON tok = w) GROUP BY ALL),
best AS (SELECT {text}, asset_id, name, CAST(sum(p) AS BIGINT) AS score FROM qw JOIN pts USING (w) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {text} ORDER BY score DESC, name, asset_id) AS INT) AS rank FROM best)"""


@query("index_search", with_views("assets", "asset_fields", extra=_TYPED_SQL + "," + _points_sql("typed", "query")) + """
SELECT query, rank, asset_id, name, score FROM ranked WHERE rank <= 8""")
def _(spark, sf):
    return grown_index(spark, sf).search(typed_texts(spark, sf), 8)


_FAMILY_VALUES = ", ".join(f"('{f}', '{p}')" for f, ps in S.KEYWORD_FIELDS.items() for p in ps)
_ASKED = [*S.KEYWORD_FIELDS, "Widget PII", "red_ created-at"]


@query("index_family_search", with_views("assets", "asset_fields", extra=f"""fam(keyword, pattern) AS (VALUES {_FAMILY_VALUES}),
asked AS (SELECT DISTINCT lower(c_mktsegment) || ' order' AS query FROM customer UNION SELECT unnest({_ASKED})),
kw AS (SELECT DISTINCT query, unnest(string_split(lower(query), ' ')) AS keyword FROM asked),
hit AS (SELECT kw.query, kw.keyword, a.asset_id, a.asset_type, a.name, 'name' AS why, NULL AS f FROM kw JOIN assets a
    ON contains(lower(concat_ws(' ', a.name, a.description)), kw.keyword)
  UNION ALL SELECT kw.query, kw.keyword, a.asset_id, a.asset_type, a.name, 'field', lower(f.name) FROM asset_fields f JOIN assets a USING (asset_id)
    JOIN kw ON contains(lower(f.name), kw.keyword)
  UNION ALL SELECT kw.query, kw.keyword, a.asset_id, a.asset_type, a.name, 'family', NULL FROM asset_fields f JOIN assets a USING (asset_id)
    JOIN fam ON contains(lower(f.name), fam.pattern) JOIN kw USING (keyword) WHERE a.asset_type = 'iceberg_table')""") + """
SELECT query, asset_id, asset_type, name, bool_or(why = 'name') AS by_name, bool_or(why = 'field') AS by_field, bool_or(why = 'family') AS by_family,
  count(DISTINCT keyword) FILTER (WHERE contains(lower(name), keyword)) AS name_hits,
  coalesce(array_to_string(list_sort(list_distinct(list(f) FILTER (WHERE f IS NOT NULL))), ','), '') AS matching_fields
FROM hit GROUP BY query, asset_id, asset_type, name""")
def _(spark, sf):
    segments = view(spark, sf, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(" order")).alias("query"))
    listed = spark.createDataFrame([(t,) for t in _ASKED], "query string")
    return index(spark, sf).families(segments.unionByName(listed))


@query("index_resolve", with_views("assets", "asset_fields", extra="""typed AS (
  SELECT 'demo.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS typed FROM part
  UNION ALL SELECT lower(c_mktsegment) || '-events-' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT s_name FROM supplier UNION ALL SELECT DISTINCT p_name || ' tables' FROM part),
tab AS (SELECT name, min(asset_id) AS id FROM assets WHERE asset_type = 'iceberg_table' GROUP BY name),
top AS (SELECT name, min(asset_id) AS id FROM assets WHERE asset_type = 'kafka_topic' GROUP BY name),
rest AS (SELECT typed FROM typed WHERE typed NOT IN (SELECT name FROM tab) AND typed NOT IN (SELECT name FROM top)),"""
+ _points_sql("rest", "typed")) + """
SELECT t.typed, coalesce(a.id, b.id, r.asset_id) AS asset_id,
  CASE WHEN a.id IS NOT NULL THEN 'table' WHEN b.id IS NOT NULL THEN 'topic' WHEN r.asset_id IS NOT NULL THEN 'search' END AS resolved_as
FROM typed t LEFT JOIN tab a ON a.name = t.typed LEFT JOIN top b ON b.name = t.typed
LEFT JOIN ranked r ON r.typed = t.typed AND r.rank = 1""")
def _(spark, sf):
    tables = view(spark, sf, "part").select(
        F.concat(F.lit("demo."), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("typed")
    )
    topics = view(spark, sf, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit("-events-"), F.col("c_custkey").cast("string")).alias("typed")
    )
    others = view(spark, sf, "supplier").select(F.col("s_name").alias("typed"))
    loose = view(spark, sf, "part").select(F.concat("p_name", F.lit(" tables")).alias("typed")).distinct()
    return index(spark, sf).resolve(tables.unionByName(topics).unionByName(others).unionByName(loose))
