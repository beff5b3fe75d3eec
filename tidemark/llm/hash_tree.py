"""Shards by a hierarchical weighted hash tree.

A tree has levels, here regions, racks and shards; a node weighs as much as the shards below it.
A document starts at the root and at each level draws once for each child: with ``u`` a uniform
number from the hash of the child's name and the document's key, the child of the least
``-ln(u) / weight`` wins, so children win in proportion to their weights. Draws of one node do not
depend on those of another, so a changed weight moves documents only between the changed node and
its siblings, on the path to it; all else stays in place.

A shard that joins as a region of its own changes no other weight. So it takes documents only into
itself, whatever the number of shards was: the law ``key``.

All of it is DataFrame expressions on the document's key. Numbers inside a shard come from
ranges of keys, counted first and numbered range by range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .common import documents
from .registry import register

LEVELS = (2, 3, 4)
LAW = "key"
SEED = "tree-1"
#: Bits of a draw, all of them exact in a double.
DRAW_BITS = 52
EXTRA_BYTES = 8
PLACE_BITS = 60
#: Rows of one shard that are numbered together, on average.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A name that no sibling has, and either children or a shard with its weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 0.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(levels: tuple[int, ...] = LEVELS, joined: int = 0, weights: dict[int, float] | None = None) -> Node:
    """A regular tree, and ``joined`` shards that came later, each with a region and a rack of its own.

    Shards are numbered from left to right and weigh 1 unless ``weights`` says otherwise. Names are
    paths, so the draws of a node stay the same when others come or go.
    """
    given = weights or {}
    count = 0

    def grow(name: str, below: tuple[int, ...]) -> Node:
        nonlocal count
        if not below:
            count += 1
            return Node(name, shard=count - 1, own=float(given.get(count - 1, 1.0)))
        return Node(name, tuple(grow(f"{name}/{i}", below[1:]) for i in range(below[0])))

    founded = grow("", levels)
    late = [grow(f"/{levels[0] + i}", (1,) * (len(levels) - 1)) for i in range(joined)]
    return Node("", (*founded.children, *late))


def key_of(docs: DataFrame) -> Column:
    """The document's id as text; the checksum of its text where it has none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.md5(text)))


def _uniform(name: str, key: Column) -> Column:
    """A number in (0, 1) from the hash of a node's name and a key."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:{name}:"), key).cast("binary"))
    whole = F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long").cast("double")
    return (whole + 0.5) / float(2**DRAW_BITS)


def descend(node: Node, key: Column) -> Column:
    """The shard that a key reaches from a node; only the children of nodes on its way are drawn for."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0] or [*node.children]
    if len(live) == 1:
        return descend(live[0], key)
    draws = F.array(*[F.struct((-F.ln(_uniform(c.name, key)) / (c.weight or 1.0)).alias("cost"), F.lit(i).alias("child")) for i, c in enumerate(live)])
    below = [descend(c, key) for c in live]

    def pick(winner: Column) -> Column:
        out = below[-1]
        for i in range(len(live) - 2, -1, -1):
            out = F.when(winner == i, below[i]).otherwise(out)
        return out

    return F.transform(F.array(F.array_min(draws)["child"]), pick)[0]


def assign(docs: DataFrame, root: Node, grown: Node | None = None) -> DataFrame:
    """``docs`` with shard and, if a ``grown`` tree is given, grown_shard; no row moves.

    Needs doc_id and text; columns called shard or grown_shard are replaced. A row without a doc_id is
    placed by its text, a null text counts as empty, rows of one doc_id share a shard, an empty table
    gives an empty result.
    """
    placed = docs.withColumn("shard", descend(root, key_of(docs)).cast("int"))
    return placed.withColumn("grown_shard", descend(grown, key_of(docs)).cast("int")) if grown else placed


def place_of(key: Column, text: Column) -> Column:
    """60 uniform bits from a key and a text: a row's place among the rows of its shard."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{SEED}:slot"), key, F.md5(text)).cast("binary"))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def numbered(rows: DataFrame, by: list[str], place: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with slot, gapless from 0 within each value of ``by`` and ascending by ``place`` and ``order``.

    Equal rows come back as one, with the number of their ``copies`` and the first of their slots: they
    are combined before they move, so none is too frequent. ``place`` is uniform, so ranges of it hold
    about equally many rows; each is numbered on its own and shifted by the counts of those before it.
    """
    names = rows.columns
    once = settle(rows.groupBy(*names).agg(F.count("*").alias("copies")), "slot-rows")
    sizes = once.groupBy(*by).agg(F.ceil(F.count("*") / range_rows).alias("ranges"))
    span = F.floor(F.col(place) / F.lit(float(2**PLACE_BITS)) * F.col("ranges"))
    ranged = once.join(sizes, by).withColumn("range", F.least(span, F.col("ranges") - 1))
    totals = ranged.groupBy(*by, "range").agg(F.sum("copies").alias("total"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(*by, "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*by, "range").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, -1)
    slot = F.col("first") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    return ranged.join(firsts, [*by, "range"]).select(*names, "copies", slot.alias("slot"))


def shards(docs: DataFrame, root: Node | None = None, grown: Node | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, one row per row of ``docs``.

    size is the text's bytes and eight more, slot the row's place in its shard, gapless from 0.
    Needs doc_id and text as in :func:`assign`; other columns are ignored. Rows that repeat take
    neighbouring slots.
    """
    root, grown = root or tree(), grown or tree(joined=1)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", "text")
    rows = assign(narrow, root, grown).select(
        "doc_id",
        (F.octet_length(text) + F.lit(EXTRA_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        "shard",
        "grown_shard",
        place_of(key_of(narrow), text).alias("place"),
    )
    found = numbered(rows, ["shard"], "place", ["doc_id", "size", "text_crc32"], range_rows)
    each = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("copies") - 1))
    return found.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", each.alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, root: Node | None = None, files: int = 1) -> None:
    """Write whole documents to one folder a shard (``shard=n``), about ``files`` files in each.

    Rows are dealt to the files of their shard by number, so a document that repeats does not fill one.
    """
    dealt = assign(docs, root or tree()).withColumn("_file", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)))
    dealt.repartition("shard", "_file").drop("_file").write.partitionBy("shard").mode("errorifexists").parquet(path)


def _sql(node: Node, key: str) -> str:
    """The descent as an SQL expression."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql(node.children[0], key)
    costs = [
        f"-ln((('0x' || substr(md5('{SEED}:{c.name}:' || {key}), 1, {DRAW_BITS // 4}))::BIGINT::DOUBLE + 0.5) / {2**DRAW_BITS}.0) / {c.weight}"
        for c in node.children
    ]
    # the first child of the least cost
    branches = " ".join(f"WHEN {i} THEN {_sql(c, key)}" for i, c in enumerate(node.children, 1))
    return f"CASE list_position([{', '.join(costs)}], list_min([{', '.join(costs)}])) {branches} END"


CHECK = f"""
WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
           FROM range(256) AS r(i)),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('i' || doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS k FROM documents),
b AS (SELECT d.*, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
c AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda h, x: xor(h >> 8, t.t[(xor(h, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
s AS (SELECT doc_id, (len(bytes) + {EXTRA_BYTES})::BIGINT AS size, text_crc32,
             ({_sql(tree(), "k")})::INT AS shard, ({_sql(tree(joined=1), "k")})::INT AS grown_shard,
             ('0x' || substr(md5('{SEED}:slot:' || k || ':' || md5(text)), 1, {PLACE_BITS // 4}))::BIGINT AS place FROM c)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""


@register("op12_hash_tree_shards", CHECK)
def op12_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))
