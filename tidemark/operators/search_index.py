"""A stored inverted index of the catalog: search, family search and name resolution for many typed texts at once.

The index is a set of generations. Each holds ``postings`` (kind, term, asset), ``grams`` (the distinct terms by the pieces of
three characters that they contain, shorter terms by themselves) and ``frequencies`` of those pieces. Searches go from typed words to terms through grams and from terms
to assets through postings; the catalog itself is not read. "Part of a name" is found through one gram of the needle, the rarest, and
verified by ``contains``, so no term is missed whatever the frequencies say.

An update writes a generation of the changed assets and the ids that it replaces, then a manifest that names the generations in use. Readers
take the newest complete manifest, so they see an update whole or not at all; :func:`compact` merges the generations.

Null and empty names, words and texts match nothing. Repeated rows of an asset or a field count once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.names import tokens
from tidemark.operators.mart_store import versions
from tidemark.operators.shaping import topk
from tidemark.session import settle, shuffle_parts, shuffles_dropped

ASSET = ["asset_id", "asset_type", "name"]
#: Longest piece of a term that is indexed.
GRAM = 3
#: Points of a word of the name, a part of one and a word of a field.
WHOLE, PART, IN_FIELD = 3, 2, 1

# What a keyword of the family search also looks for in field names.
KEYWORD_FIELDS = {
    "geolocation": ["latitude", "longitude", "lat", "lon", "address", "location", "geo"],
    "email": ["email", "mail", "contact_email"],
    "phone": ["phone", "mobile", "telephone", "contact_phone"],
    "pii": ["ssn", "social_security", "passport", "credit_card"],
    "date": ["date", "timestamp", "created_at", "updated_at"],
    "customer": ["customer", "client", "account"],
}


def _pieces(term: Column, lengths) -> Column:
    """Distinct substrings of the given lengths."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(term) - n + 1)
        cut = F.transform(starts, lambda i: term.substr(i, F.lit(n)))
        return F.when(F.length(term) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in lengths])))


# --- writing ---------------------------------------------------------------


def postings_of(assets: DataFrame, fields: DataFrame) -> DataFrame:
    """(kind, term, asset) rows: ``name`` as it is, ``token`` and ``field_token`` words, ``text`` the lower-case name
    and description, ``field`` lower-case field names. Repeats of assets are left; they go where the rows are dealt to files."""
    own = assets.select(*ASSET, "description")
    # an asset's field names meet it as one row
    named = fields.groupBy("asset_id").agg(F.collect_set("name").alias("_fields"))
    with_field = own.select(*ASSET).distinct().join(named, "asset_id")

    def rows(df: DataFrame, kind: str, terms: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.explode(terms).alias("term"), *ASSET)

    parts = [
        rows(own, "name", F.array("name")),
        rows(own, "token", tokens("name")),
        rows(own, "text", F.array(F.lower(F.concat_ws(" ", "name", "description")))),
        rows(with_field, "field_token", F.array_distinct(F.flatten(F.transform("_fields", tokens)))),
        rows(with_field, "field", F.array_distinct(F.transform("_fields", F.lower))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("term") != "")


def _write(path: str, version: int, postings: DataFrame, gone: DataFrame, kept: list[int]) -> int:
    """A generation, then the manifest of the generations in use, which is all that readers look for."""
    spark = postings.sparkSession
    place = f"{path}/postings/g{version}"
    # a term in a third of all assets is dealt over several files; repeats meet there, so no shuffle is for them alone
    sorted_rows = postings.repartitionByRange("kind", "term", "asset_id").distinct().sortWithinPartitions("kind", "term", "asset_id")
    _store(sorted_rows, place)
    stored = spark.read.schema(postings.schema).parquet(place)
    terms = stored.where(F.col("kind").isin("token", "text", "field")).select("kind", "term").distinct()
    # a term has some twenty pieces: by explicit numbers of tasks, as AQE sizes tasks by the few bytes that go in
    parts = shuffle_parts(spark)
    stored_pieces = F.when(F.length("term") < GRAM, F.array("term")).otherwise(_pieces(F.col("term"), [GRAM]))
    spread = terms.repartition(parts, "term")  # by other columns than the distinct, whose exchange would else stand in for it
    cut = settle(spread.select("kind", F.explode(stored_pieces).alias("gram"), "term"), "grams")
    counted = cut.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n_terms"))
    _store(counted, f"{path}/frequencies/g{version}")
    counts = spark.read.schema(counted.schema).parquet(f"{path}/frequencies/g{version}")
    # a word that holds a token holds its key too: the rarest of the token's pieces; only tokens have one
    is_token = F.col("kind") == "token"
    key = (
        cut.where(is_token)
        .join(counts, ["kind", "gram"])
        .groupBy("kind", "term")
        .agg(F.min(F.struct("n_terms", "gram"))["gram"].alias("key"))
    )
    of_tokens = cut.where(is_token).repartition(parts, "kind", "term").join(key, ["kind", "term"], "left")
    marked = of_tokens.select("kind", "gram", "term", F.coalesce(F.col("gram") == F.col("key"), F.lit(False)).alias("is_key"))
    marked = cut.where(~is_token).select("kind", "gram", "term", F.lit(False).alias("is_key")).unionByName(marked)
    _store(marked.repartitionByRange(parts, "kind", "gram", "term").sortWithinPartitions("kind", "gram"), f"{path}/grams/g{version}")
    _store(gone.select("asset_id").distinct(), f"{path}/gone/g{version}")
    live = spark.createDataFrame([(g,) for g in [*kept, version]], "generation long")
    live.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/v{version}")
    return version


def _store(df: DataFrame, place: str) -> None:
    """Write a table of a generation, compressed well as it is written once and sorted, without leaving shuffle files."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(place)


def build(path: str, assets: DataFrame, fields: DataFrame) -> int:
    """Index all assets and fields at ``path`` and return the version."""
    version = (versions(assets.sparkSession, path) or [-1])[-1] + 1
    return _write(path, version, postings_of(assets, fields), assets.select("asset_id").limit(0), [])


def update(path: str, assets: DataFrame, fields: DataFrame, removed: DataFrame | None = None) -> int:
    """Put changed and new ``assets``, with all of their ``fields``, in place of what is stored of those ids, and drop the ids of ``removed``.

    Writes a generation of the size of the change; what is stored is not rewritten. Fields of other assets are ignored.
    """
    spark = assets.sparkSession
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no index at {path}")
    gone = assets.select("asset_id")
    if removed is not None:
        gone = gone.unionByName(removed.select("asset_id"))
    return _write(path, known[-1] + 1, postings_of(assets, fields), gone, _generations(spark, path))


def compact(spark: SparkSession, path: str) -> int:
    """Merge the generations in use into one."""
    live = Index(spark, path).postings()
    return _write(path, versions(spark, path)[-1] + 1, live, live.select("asset_id").limit(0), [])


def _generations(spark: SparkSession, path: str) -> list[int]:
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no index at {path}")
    stored = spark.read.schema("generation long").parquet(f"{path}/manifest/v{known[-1]}")
    return sorted(r[0] for r in stored.collect())  # one row an update since the last compaction


# --- reading ---------------------------------------------------------------


class Index:
    """The newest complete version of the index at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.live = _generations(spark, path)

    def _table(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{kind}/g{g}" for g in self.live])

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """Postings that no later generation replaces; those of ``terms`` (kind, term, ...) only, beside their other columns.

        Terms are met first, so only what they find is compared with the replaced ids.
        """

        def met(rows: DataFrame) -> DataFrame:
            return rows if terms is None else rows.join(terms, ["kind", "term"])

        if len(self.live) == 1:
            return met(self._table("postings"))

        def marked(kind: str, label: str, live: list[int]) -> DataFrame:
            parts = [self.spark.read.parquet(f"{self.path}/{kind}/g{g}").withColumn(label, F.lit(g)) for g in live]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        # nothing replaces what the newest generation holds
        newest = met(self.spark.read.parquet(f"{self.path}/postings/g{self.live[-1]}"))
        last = marked("gone", "_g", self.live).groupBy("asset_id").agg(F.max("_g").alias("_gone"))
        rows = met(marked("postings", "_own", self.live[:-1])).join(last, "asset_id", "left")
        kept = rows.where(F.col("_gone").isNull() | (F.col("_own") >= F.col("_gone")))
        return kept.select(newest.columns).unionByName(newest)

    def containing(self, needles: DataFrame) -> DataFrame:
        """(kind, needle, term): the terms of a kind that contain a needle, for distinct (kind, needle) rows."""
        asked = needles.where(F.col("needle") != "").select("kind", "needle")
        cut = asked.where(F.length("needle") >= GRAM).select("kind", "needle", F.explode(_pieces(F.col("needle"), [GRAM])).alias("gram"))
        counts = self._table("frequencies").groupBy("kind", "gram").agg(F.sum("n_terms").alias("n_terms"))
        # a piece that no term has is the rarest of all: nothing is found
        ranked = cut.join(counts, ["kind", "gram"], "left").groupBy("kind", "needle")
        chosen = ranked.agg(F.min(F.struct(F.coalesce("n_terms", F.lit(0)), F.col("gram")))["gram"].alias("gram"))
        # a shorter needle stands inside pieces
        inside = counts.select("kind", "gram", F.explode(_pieces(F.col("gram"), range(1, GRAM))).alias("needle"))
        chosen = chosen.unionByName(asked.where(F.length("needle") < GRAM).join(inside, ["kind", "needle"]).select("kind", "needle", "gram"))
        met = self._table("grams").select("kind", "gram", "term").join(chosen, ["kind", "gram"])
        return met.where(F.col("term").contains(F.col("needle"))).select("kind", "needle", "term").distinct()

    def contained(self, words: DataFrame) -> DataFrame:
        """(needle, term): the tokens that stand inside a word, for distinct ``needle`` rows."""
        cut = words.select("needle", F.explode(_pieces(F.col("needle"), range(1, GRAM + 1))).alias("gram"))
        keys = self._table("grams").where((F.col("kind") == "token") & F.col("is_key")).select("gram", "term")
        return keys.join(cut, "gram").where(F.col("needle").contains(F.col("term"))).select("needle", "term").distinct()

    def word_hits(self, words: DataFrame) -> DataFrame:
        """(word, asset_id, name, points) of distinct ``word`` rows: the best hit of a word in each asset."""
        needles = words.select(F.col("word").alias("needle"))
        inside = self.containing(needles.withColumn("kind", F.lit("token"))).select("needle", "term")
        parts = inside.unionByName(self.contained(needles)).distinct()
        points = F.when(F.col("needle") == F.col("term"), WHOLE).otherwise(PART)
        terms = parts.select("needle", F.lit("token").alias("kind"), "term", points.alias("points")).unionByName(
            needles.select("needle", F.lit("field_token").alias("kind"), F.col("needle").alias("term"), F.lit(IN_FIELD).alias("points"))
        )
        # dealt by asset, as the hits of an asset may be gathered next
        found = self.postings(terms).where(F.col("kind").isin("token", "field_token")).repartition("asset_id")
        return found.groupBy(F.col("needle").alias("word"), "asset_id", "name").agg(F.max("points").alias("points"))

    def _leading(self, hits: DataFrame, k: int) -> DataFrame:
        """The hits of the ``k`` first assets, by name and id, of those that the same words hit with the same points; assets without a name or id go."""
        hits = hits.where(F.col("asset_id").isNotNull() & F.col("name").isNotNull())  # scores find assets by both
        alike = F.array_sort(F.collect_list(F.struct("word", "points"))).alias("alike")
        first = topk(hits.groupBy("asset_id", "name").agg(alike), ["alike"], [F.col("name"), F.col("asset_id")], k)
        return first.select("asset_id", "name", F.inline("alike")).select("word", "asset_id", "name", "points")

    def search(self, queries: DataFrame, k: int = 8, text: str = "query") -> DataFrame:
        """The k best assets of every distinct text: ``text``, rank, asset_id, name, score.

        Scores and ties are those of :func:`catalog.keyword_rank`; a text without words finds nothing.
        Exact, but words in many assets are not joined for every query: candidates of a query's rarest word give a k-th score that
        the answer must reach, and words which together stay below it cannot bring in an asset, so they only add to the
        scores of assets that other words found. Assets that the same words hit with the same points score alike in every text, so of
        those only the k first by name and id can be in an answer, and only they go on.
        """
        asked = queries.select(F.col(text).alias("_q")).where(F.col("_q").isNotNull()).distinct()
        typed = settle(asked.select("_q", F.explode(F.array_distinct(tokens("_q"))).alias("word")), "typed")
        hits = settle(self._leading(self.word_hits(typed.select("word").distinct()), k), "word-hits")
        weight = hits.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("points").alias("best"))
        by_query = Window.partitionBy("_q")  # the words of one typed text
        asked_words = typed.join(weight, "word").withColumn("nth", F.row_number().over(by_query.orderBy("n", "word")))
        asked_words = settle(asked_words, "asked-words")

        def scored(words: DataFrame) -> DataFrame:
            found = words.select("_q", "word").join(hits, "word").select("_q", "asset_id", "name").distinct()
            pairs = found.join(asked_words.select("_q", "word"), "_q").join(hits, ["word", "asset_id", "name"])
            return pairs.groupBy("_q", "asset_id", "name").agg(F.sum("points").alias("score"))

        order = [F.col("score").desc(), F.col("name"), F.col("asset_id")]
        first = topk(scored(asked_words.where(F.col("nth") == 1)), ["_q"], order, k)
        reached = first.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0).alias("needed"))
        commoner = by_query.orderBy(F.col("nth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        essential = asked_words.withColumn("most", F.sum("best").over(commoner)).join(reached, "_q")
        best = topk(scored(essential.where(F.col("most") >= F.col("needed"))), ["_q"], order, k)
        rank = F.row_number().over(by_query.orderBy(*order))
        return best.select(F.col("_q").alias(text), rank.alias("rank"), "asset_id", "name", "score")

    def families(self, queries: DataFrame, text: str = "query", known: dict[str, list[str]] | None = None, types: tuple[str, ...] = ("iceberg_table",)) -> DataFrame:
        """Every asset that a keyword of a text finds, keywords being what blanks part, in any case: ``text``, asset_id, asset_type, name,
        by_name (in name or description), by_field (in a field name), by_family (the keyword names a family, ``known``, and an asset of
        ``types`` has a field of it), name_hits (keywords in the name) and the matching fields."""
        families = KEYWORD_FIELDS if known is None else known
        asked = queries.select(F.col(text).alias("_q")).where(F.col("_q").isNotNull()).distinct()
        keywords = F.array_remove(F.array_distinct(F.split(F.lower("_q"), r"\s+")), "")
        typed = settle(asked.select("_q", F.explode(keywords).alias("keyword")), "keywords")
        words = typed.select("keyword").distinct()
        pattern = F.create_map(*[c for f, ps in families.items() for c in (F.lit(f), F.array(*[F.lit(p) for p in ps]))]) if families else None
        needles = [
            words.select("keyword", F.lit("text").alias("kind"), F.col("keyword").alias("needle"), F.lit("name").alias("why")),
            words.select("keyword", F.lit("field").alias("kind"), F.col("keyword").alias("needle"), F.lit("field").alias("why")),
        ]
        if pattern is not None:
            listed = F.explode(F.try_element_at(pattern, F.col("keyword"))).alias("needle")
            needles.append(words.select("keyword", F.lit("field").alias("kind"), listed, F.lit("family").alias("why")))
        sought = needles[0]
        for n in needles[1:]:
            sought = sought.unionByName(n)
        terms = sought.join(self.containing(sought.select("kind", "needle").distinct()), ["kind", "needle"])
        terms = terms.select("keyword", "kind", "term", "why").distinct()
        found = self.postings(terms).where(F.col("kind").isin("text", "field"))
        found = found.where((F.col("why") != "family") | F.col("asset_type").isin(*types))

        def any_of(why: str) -> Column:
            return F.bool_or(F.col("why") == why)

        direct = F.collect_set(F.when(F.col("why") == "field", F.col("term")))  # one asset's own fields
        # per keyword first: a text's keywords meet as one row an asset
        by_word = found.groupBy("keyword", *ASSET).agg(
            any_of("name").alias("by_name"), any_of("field").alias("by_field"), any_of("family").alias("by_family"), direct.alias("_f")
        )
        in_name = F.coalesce(F.lower("name").contains(F.col("keyword")), F.lit(False))
        return (
            typed.join(by_word, "keyword")
            .groupBy(F.col("_q").alias(text), *ASSET)
            .agg(
                F.bool_or("by_name").alias("by_name"), F.bool_or("by_field").alias("by_field"), F.bool_or("by_family").alias("by_family"),
                F.count_if(in_name).alias("name_hits"),
                F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("_f"))))).alias("matching_fields"),
            )
        )

    def resolve(self, names: DataFrame, col: str = "typed") -> DataFrame:
        """Typed name to asset: a table of that name, else a topic of that name, else the best hit of a search.

        Adds ``asset_id`` and ``resolved_as`` (table, topic, search or null) to every row of ``names``.
        """
        typed = names.select(F.col(col).alias("_typed")).where(F.col("_typed").isNotNull()).distinct()

        def first(kind: str) -> Column:
            return F.min(F.when(F.col("asset_type") == kind, F.col("asset_id")))

        exact = self.postings(typed.select(F.lit("name").alias("kind"), F.col("_typed").alias("term"), "_typed"))
        exact = exact.groupBy("_typed").agg(first("iceberg_table").alias("_table"), first("kafka_topic").alias("_topic"))
        known = settle(typed.join(exact, "_typed", "left"), "resolved")
        rest = known.where(F.coalesce("_table", "_topic").isNull()).select("_typed")
        hit = self.search(rest, 1, "_typed").select("_typed", F.col("asset_id").alias("_hit"))
        found = known.join(hit, "_typed", "left").select(
            "_typed",
            F.coalesce("_table", "_topic", "_hit").alias("asset_id"),
            F.when(F.col("_table").isNotNull(), "table").when(F.col("_topic").isNotNull(), "topic").when(F.col("_hit").isNotNull(), "search").alias("resolved_as"),
        )
        return names.drop("asset_id", "resolved_as").join(found, F.col(col) == F.col("_typed"), "left").drop("_typed")
