"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import half_up
from tidemark.functions.vectors import cosine
from tidemark.operators import governance as G
from tidemark.operators import vectors as V
from tidemark.operators.sinks import upsert_latest
from tidemark.plans.registry import query
from tidemark.plans.views import view

CENTROID_SQL = """WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, CAST(sum(CAST(CAST(x AS DOUBLE) AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS m FROM parts GROUP BY 1, 2),
cent AS (SELECT label, list(m ORDER BY pos) AS vec FROM means GROUP BY label),
sims AS (SELECT c.label AS query_id, e.vec_id, e.vec_id // 4 AS owner_id, e.label,
    round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vec), 9) AS s FROM embeddings e, cent c)
"""


def centroids(spark, sf):
    return V.centroids(view(spark, sf, "embeddings"), "label", "embedding")


def as_queries(df):
    return df.select(F.col("label").cast("long").alias("query_id"), F.col("embedding").alias("vec"))


def as_corpus(df):
    owner = F.floor(F.col("vec_id") / 4).cast("long")
    return df.select(F.col("vec_id").alias("item_id"), owner.alias("owner_id"), F.col("embedding").alias("vec"))


@query("cosine", CENTROID_SQL + "SELECT vec_id, round(s, 6) AS similarity FROM sims WHERE label = query_id")
def _(spark, sf):
    means = centroids(spark, sf).withColumnRenamed("embedding", "mean")
    return view(spark, sf, "embeddings").join(means, "label").select(
        "vec_id", half_up(F.round(cosine("embedding", "mean"), 9), 6).alias("similarity")
    )


_TOP_SQL = """, best AS (SELECT query_id, owner_id, arg_max(vec_id, (s, -vec_id)) AS item_id, max(s) AS s FROM sims {w} GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, owner_id) AS rn FROM best)
SELECT query_id, item_id, owner_id, round(s, 6) AS similarity FROM ranked WHERE rn <= 10"""


@query("vector_topk", CENTROID_SQL.rstrip() + _TOP_SQL.format(w=""))
def _(spark, sf):
    found = V.vector_topk(as_queries(centroids(spark, sf)), as_corpus(view(spark, sf, "embeddings")), 10)
    return found.withColumn("similarity", half_up("similarity", 6))


@query("topk_vector", CENTROID_SQL.rstrip() + _TOP_SQL.format(w="WHERE label >= 5"))
def _(spark, sf):
    only = view(spark, sf, "embeddings").where(F.col("label") >= 5)
    found = V.vector_topk(as_queries(centroids(spark, sf)), as_corpus(only), 10)
    return found.withColumn("similarity", half_up("similarity", 6))


def _nearest_pattern(spark, sf, limit):
    e = view(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    stored = as_queries(centroids(spark, sf)).select(F.col("query_id").alias("item_id"), F.col("query_id").alias("owner_id"), "vec")
    return V.nearest(rows, stored, limit)


_NEAREST = CENTROID_SQL.rstrip() + """, near AS (SELECT vec_id, arg_max(query_id, (s, -query_id)) AS item_id, max(s) AS s FROM sims GROUP BY vec_id)
"""


@query("nearest_with_threshold", _NEAREST + """SELECT vec_id AS query_id, CASE WHEN s >= 0.3 THEN item_id END AS item_id,
  round(s, 6) AS similarity, s >= 0.3 AS hit FROM near""")
def _(spark, sf):
    return _nearest_pattern(spark, sf, 0.3).withColumn("similarity", half_up("similarity", 6))


@query("pii_semantic", _NEAREST + """SELECT vec_id AS query_id, item_id, s >= 0.65 AS is_pii, round(s, 2) AS confidence FROM near""")
def _(spark, sf):
    return G.pii_semantic(_nearest_pattern(spark, sf, -1.0)).select("query_id", "item_id", "is_pii", "confidence")


@query("embedding_upsert", """SELECT sha256('vec' || chr(1) || CAST(vec_id AS VARCHAR)) AS point_id, vec_id,
  CASE WHEN label % 2 = 0 THEN 'new' ELSE 'old' END AS payload, CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS indexed_at,
  len(embedding) AS dims FROM embeddings""")
def _(spark, sf):
    e = view(spark, sf, "embeddings").select(
        V.stable_id(F.lit("vec"), F.col("vec_id").cast("string")).alias("point_id"), "vec_id", "label",
        F.lit("old").alias("payload"), F.lit(1).alias("indexed_at"), "embedding",
    )
    fresh = e.where(F.col("label") % 2 == 0).withColumns({"payload": F.lit("new"), "indexed_at": F.lit(2)})
    merged = upsert_latest(e, fresh, ["point_id"], ["indexed_at"])
    return merged.select("point_id", "vec_id", "payload", "indexed_at", F.size("embedding").alias("dims"))
