import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine
from tidemark.operators import lineage as L
from tidemark.operators import vectors as V
from tidemark.operators.sinks import upsert_latest
from tidemark.session import shared_dir

EDGES = [("events", "raw"), ("raw", "enriched"), ("customers", "enriched"), ("products", "enriched"), ("enriched", "mart")]


def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, "p") for a, b in pairs], "from_fqn string, to_fqn string, pipeline string")


def test_depth_from_the_mart(spark):
    got = L.lineage(edge_frame(spark, EDGES), "mart")
    assert rows(got) == sorted([("mart", 0), ("enriched", -1), ("raw", -2), ("customers", -2), ("products", -2), ("events", -3)], key=str)
    assert rows(L.neighbours(got), "node") == [("enriched",)]


def test_cycles_end_and_upstream_wins(spark):
    cyc = edge_frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "d")])
    assert rows(L.lineage(cyc, "a", 10, 10)) == [("a", 0), ("b", -2), ("c", -1)]
    assert rows(L.lineage(cyc, "a", 0, 10)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_depth_cap_and_unknown_root(spark):
    e = edge_frame(spark, EDGES)
    assert rows(L.lineage(e, "mart", 1, 0), "node") == [("enriched",), ("mart",)]
    assert rows(L.lineage(e, "nowhere")) == [("nowhere", 0)]


def test_edges_inside_the_walk(spark):
    e = edge_frame(spark, EDGES + EDGES[:2] + [("mart", "report")])
    walked = L.lineage(e, "mart", 3, 0)
    assert rows(L.distinct_edges(e, e, walked)) == sorted(EDGES)


def test_impact_has_no_cap(spark):
    e = edge_frame(spark, [("r", f"n{i}") for i in range(100)])
    attrs = spark.createDataFrame([("n1", "ann")], "node string, owner string")
    got = L.impact(e, "r", attrs)
    assert got.count() == 100 and got.where("owner = 'ann'").count() == 1


def test_entity_types(spark):
    df = spark.createDataFrame([("x_kafka.t", None), ("hive.t", ""), ("dbt.m", None), ("looker.d", "table"), ("odd", None)], "f string, e string")
    got = {r.f: r.t for r in df.select("f", L.entity_type("f", "e", {**L.SERVICE_TYPES, "x_kafka": "topic"}).alias("t")).collect()}
    assert got == {"x_kafka.t": "topic", "hive.t": "table", "dbt.m": "pipeline", "looker.d": "table", "odd": "table"}
    # a first part that merely ends in a service is another service
    assert df.where("f = 'x_kafka.t'").select(L.entity_type("f")).first()[0] == "table"


def test_usage_rank_ties(spark):
    log = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "asset string")
    assert rows(L.usage_rank(log, "asset"), "asset", "popularity_rank") == [("a", 1), ("b", 1), ("c", 3)]


def test_upsert_both_ways(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 1), (2, "late", 4), (3, "n", 1), (3, "n2", 2)], "k int, v string, at int")
    want = [(1, "x", 1), (2, "b", 5), (3, "n2", 2)]
    assert rows(upsert_latest(old, new, ["k"], ["at"])) == want
    assert rows(upsert_latest(old, new, ["k"], ["at"], old_unique=True)) == want


def test_cosine_edges(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([2.0, 2.0], [-1.0, -1.0])],
        "a array<float>, b array<float>",
    )
    got = [r.c for r in df.select(F.round(cosine("a", "b"), 6).alias("c")).collect()]
    assert got == [0.707107, 0.0, 0.0, None, -1.0]


def vector_frames(spark, n_q, n_c, dims=6, copies=False):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(n_q, dims)).round(2)
    c = rng.normal(size=(n_c, dims)).round(2)
    if copies:
        c[: n_c // 3] = c[0]  # a third are the same vector
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    corpus = spark.createDataFrame([(i, i // 3, v.tolist()) for i, v in enumerate(c)], "item_id long, owner_id long, vec array<double>")
    return q, c, queries, corpus


def brute(q, c, k):
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    cn = c / np.linalg.norm(c, axis=1, keepdims=True)
    sims = np.round(qn @ cn.T, 9)
    out = []
    for i, row in enumerate(sims):
        best = {}
        for j, s in enumerate(row):
            o = j // 3
            if o not in best or (-s, j) < best[o]:
                best[o] = (-s, j)
        for o, (s, j) in sorted(best.items(), key=lambda t: (t[1][0], t[0]))[:k]:
            out.append((i, j, o))
    return sorted(out)


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("plan", ["send_queries", "send_corpus", "grid"])
def test_topk_plans_are_exact(spark, monkeypatch, plan, copies):
    q, c, queries, corpus = vector_frames(spark, 40, 300, copies=copies)
    if plan == "send_corpus":
        monkeypatch.setattr(V, "_small", lambda df: None if "query_id" in df.columns else df.collect())
    if plan == "grid":
        monkeypatch.setattr(V, "_small", lambda df: None)
        whole = V._grid
        monkeypatch.setattr(V, "_grid", lambda a, b, k: whole(a, b, k, q_block=16, c_block=64))
    got = V.vector_topk(queries, corpus.repartition(5), 4)
    assert sorted((r.query_id, r.item_id, r.owner_id) for r in got.collect()) == brute(q, c, 4)


def test_blocks_smaller_than_the_data(spark, monkeypatch):
    q, c, queries, corpus = vector_frames(spark, 10, 200)
    monkeypatch.setattr(V, "BLOCK", 7)
    got = V._block_topk(list(range(10)), V._matrix(q.tolist()), np.arange(200), np.arange(200) // 3, V._matrix(c.tolist()), 5)
    assert sorted(zip(got.query_id, got.item_id, got.owner_id)) == brute(q, c, 5)


def test_empty_queries_and_threshold(spark):
    _, _, queries, corpus = vector_frames(spark, 3, 9)
    assert V.vector_topk(queries.limit(0), corpus, 3).count() == 0
    same = corpus.where("item_id < 3").select(F.col("item_id").alias("query_id"), "vec")
    assert rows(V.nearest(same, corpus, 0.99), "query_id", "item_id", "hit") == [(0, 0, True), (1, 1, True), (2, 2, True)]
    assert V.nearest(same, corpus, 1.1).where("item_id IS NULL AND NOT hit").count() == 3


def test_checkpoint_folder_comes_from_the_session(spark):
    class Stated:
        """A cluster session naming its folder, or naming none."""

        def __init__(self, folder):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})
            self.used = []
            self.sparkContext = self
            self.master = "yarn"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.used.append(path)

    cluster = Stated("hdfs:///shared/checkpoints/")
    assert shared_dir(cluster) == "hdfs:///shared/checkpoints" and cluster.used == ["hdfs:///shared/checkpoints/"]
    with pytest.raises(RuntimeError):
        shared_dir(Stated(None))
    assert shared_dir(spark)  # a local session gets a folder of its own


def test_impact_walks_a_long_chain_to_its_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "p") for i in range(15)], "from_fqn string, to_fqn string, pipeline string")
    attrs = spark.createDataFrame([("n15", "x")], "node string, owner string")
    assert L.impact(edges, "n0", attrs).count() == 15
    assert L.impact(edges, "n0", attrs, down=4).count() == 4


def test_other_widths_change_no_result(spark, monkeypatch):
    _, _, queries, corpus = vector_frames(spark, 12, 90)
    odd = spark.createDataFrame([(900, 900, [1.0] * 9), (901, 901, [1.0]), (902, 902, None), (903, 903, [])], corpus.schema)
    mixed = corpus.unionByName(odd)
    want = rows(V.vector_topk(queries, corpus, 4))
    for n in (1, 3, 7):
        assert rows(V.vector_topk(queries, mixed.repartition(n), 4)) == want
    asked = queries.unionByName(spark.createDataFrame([(77, [1.0, 1.0]), (78, None)], queries.schema))
    missed = V.nearest(asked, mixed.repartition(3), -1.0).where("query_id in (77, 78)")
    assert rows(missed) == [(77, None, 0.0, False), (78, None, 0.0, False)]
    assert rows(V._merge(V._grid(asked, mixed, 4, 5, 40), 4)) == want
    monkeypatch.setattr(V, "SENT_ROWS", 0)
    assert rows(V.vector_topk(asked, mixed.repartition(3), 4)) == want


def test_edges_are_dealt_before_they_are_sorted(spark):
    schema = "from_fqn string, to_fqn string, pipeline string, built_at int"
    old = spark.createDataFrame([("a", "b", "p", 1), ("a", "b", "p", 1), ("a", "c", "p", 5), (None, "c", "p", 1)], schema)
    merged = L.add_edges(old, spark.createDataFrame([("a", "b", "q", 2), ("a", "c", "q", 2), ("x", "y", "q", 2)], schema))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert rows(merged) == [(None, "c", "p", 1), ("a", "b", "q", 2), ("a", "c", "p", 5), ("x", "y", "q", 2)]
    assert "SortAggregate" in plan and plan.rindex("SortAggregate") < plan.index("Exchange")
