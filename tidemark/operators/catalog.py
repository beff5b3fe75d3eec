"""Search and filters over catalog tables: assets and their fields.

``assets`` has one row per asset, ``fields`` one row per (asset, field). Word
lists are literals of the plan; nothing here multiplies the fields by a list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import edit_similarity, last_part, squash, storage_kind, tokens
from tidemark.functions.scalar import col_of, half_up
from tidemark.operators.shaping import topk
from tidemark.session import settle

# Word parts that prove a family of data is present.
FIELD_FAMILIES = {
    "geolocation": [
        "lat", "lon", "lng", "latitude", "longitude", "geohash", "geo_hash", "coordinates", "coordinate",
        "gps", "location", "position", "altitude", "elevation", "accuracy",
    ],
    "address": [
        "address", "street", "city", "zip", "postal", "postcode", "country", "state", "region", "district", "suburb",
    ],
    "email": ["email", "e_mail", "mail_address"],
    "phone": ["phone", "mobile", "telephone", "cell", "msisdn", "contact_no"],
    "financial": [
        "amount", "price", "cost", "revenue", "payment", "transaction", "charge", "fee", "balance", "invoice", "billing",
    ],
    "identity": [
        "ssn", "social_security", "national_id", "passport", "dob", "date_of_birth", "birth_date", "member_id", "patient_id",
    ],
}

# Phrase in a goal to family, the first phrase found decides.
GOAL_FAMILIES = [
    ("geolocation", "geolocation"), ("geo location", "geolocation"), ("location data", "geolocation"),
    ("location field", "geolocation"), ("coordinates", "geolocation"), ("latitude", "geolocation"),
    ("longitude", "geolocation"), ("gps data", "geolocation"), ("address", "address"), ("email", "email"),
    ("phone", "phone"), ("financial", "financial"), ("payment", "financial"), ("invoice", "financial"),
    ("identity", "identity"), ("ssn", "identity"), ("date of birth", "identity"),
]


def contains_any(text: Column, words: list[str]) -> Column:
    """True if any word is a part of the text."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def asset_normalize(assets: DataFrame) -> DataFrame:
    """Storage from the URI, format, catalog and namespace defaults; set values win."""
    is_table = F.col("asset_type") == "iceberg_table"

    def filled(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    return assets.withColumns(
        {
            "storage": storage_kind("location", "storage"),
            "format": F.coalesce(
                filled("format"),
                F.when(F.col("format_version").isNotNull(), "iceberg"),
                F.lower(F.col("schema_type")),
            ),
            "catalog": F.coalesce(filled("catalog"), F.when(is_table, "hms")),
            "namespace": F.coalesce(filled("namespace"), F.when(is_table, "default")),
        }
    )


def metadata_filter(assets: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Every property must equal its value, or differ from it when written '!value'.
    A missing property passes a negated filter and fails a positive one."""
    keep = F.lit(True)
    for key, wanted in filters.items():
        actual = F.coalesce(F.lower(F.col(key)), F.lit(""))
        test = actual != wanted[1:].lower() if wanted.startswith("!") else actual == wanted.lower()
        keep = keep & test
    return assets.where(keep)


def intent_filters(intent: dict) -> dict[str, str]:
    """{'storage': {'value': 'x', 'negate': True}, 'format': None} -> {'storage': '!x'}."""
    out = {}
    for key, given in intent.items():
        if isinstance(given, dict) and given.get("value"):
            out[key] = ("!" if given.get("negate") else "") + str(given["value"]).lower()
        elif isinstance(given, str) and given:
            out[key] = given.lower()
    return out


def required_fields(assets: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """Assets having all the named fields, whatever the case."""
    wanted = sorted({n.lower() for n in names})
    if not wanted:
        return assets
    found = (
        fields.select("asset_id", F.lower("name").alias("n"))
        .where(F.col("n").isin(wanted))
        .groupBy("asset_id")
        .agg(F.count_distinct("n").alias("k"))
        .where(F.col("k") == len(wanted))
    )
    return assets.join(found, "asset_id", "left_semi")


def name_filter(assets: DataFrame, mode: str, text: str) -> DataFrame:
    """starts | ends | equals on the last dotted part of the name."""
    short, text = F.lower(last_part("name")), text.lower()
    tests = {"starts": short.startswith(text), "ends": short.endswith(text), "equals": short == text}
    if mode not in tests:
        raise ValueError("mode is 'starts', 'ends' or 'equals'")
    return assets.where(tests[mode])


def created_after(assets: DataFrame, cutoff_ms: int) -> DataFrame:
    """Tables created since the cutoff; unknown times and other kinds pass."""
    born = F.col("created_ms")
    return assets.where((F.col("asset_type") != "iceberg_table") | born.isNull() | (born >= cutoff_ms))


def column_exists(assets: DataFrame, fields: DataFrame, cols: list[str], ratio: float = 0.8, similarity=None) -> DataFrame:
    """Assets with one of the named columns, or one spelled nearly so.

    Assets without fields pass, as does everything when no column is named.
    ``similarity`` of two columns defaults to edit similarity.
    """
    if not cols:
        return assets
    sim = similarity or edit_similarity
    name = F.lower("name")
    near = F.greatest(F.lit(0.0), *[sim(F.lit(c.lower()), name) for c in cols])
    judged = fields.groupBy("asset_id").agg(F.max(near).alias("_best"))
    return assets.join(judged, "asset_id", "left").where(F.col("_best").isNull() | (F.col("_best") >= ratio)).drop("_best")


def goal_family(goal: str) -> str | None:
    return next((family for phrase, family in GOAL_FAMILIES if phrase in goal.lower()), None)


def field_family(assets: DataFrame, fields: DataFrame, family: str | None) -> DataFrame:
    """Assets with a field of the family; without a family, or without fields, pass."""
    if family is None:
        return assets
    hit = contains_any(F.lower("name"), FIELD_FAMILIES[family])
    judged = fields.groupBy("asset_id").agg(F.bool_or(hit).alias("_hit"))
    return assets.join(judged, "asset_id", "left").where(F.coalesce(F.col("_hit"), F.lit(True))).drop("_hit")


def substring_search(df: DataFrame, cols: list[str], q: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows with the text in any column, any case; % and _ are plain characters. With a ``limit``, the first by ``order``."""
    out = df.where(contains_any(F.lower(F.concat_ws("\u0001", *cols)), [q.lower()]))
    return out if limit is None else out.orderBy(*order).limit(limit)


def confidence_gate(df: DataFrame, col: str, min_score: float, null_passes: bool = True) -> DataFrame:
    keep = F.col(col) >= min_score
    return df.where(keep | F.col(col).isNull() if null_passes else keep)


def uncertain(df: DataFrame, col: str, threshold: float = 0.75) -> DataFrame:
    """Rows under the threshold; an unknown confidence counts as 0."""
    return df.where(F.coalesce(F.col(col), F.lit(0.0)) < threshold)


def restrict(assets: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Only assets found by a search; no search means all."""
    return assets if candidates is None else assets.join(candidates, ["asset_type", "name"], "left_semi")


def best_match(name, patterns: list[str], sim=edit_similarity) -> Column:
    """(similarity, pattern) of the closest pattern, the first one winning a tie.

    Evaluated inside the row over a literal list: no join, no row expansion.
    """
    scored = [
        F.struct(sim(col_of(name), F.lit(p)).alias("similarity"), F.lit(-i).alias("rank"), F.lit(p).alias("pattern"))
        for i, p in enumerate(patterns)
    ]
    best = F.array_max(F.array(*scored))
    return F.struct(best["similarity"].alias("similarity"), best["pattern"].alias("pattern"))


def collect_fields(fields: DataFrame) -> DataFrame:
    """Field names and 'name type' texts per asset, in field order. Repeated rows of a
    field collapse in every task; what is gathered is one schema."""
    entry = F.struct("ordinal", "name", "type")
    return (
        fields.where(F.col("name") != "")
        .groupBy("asset_id")
        .agg(F.array_sort(F.collect_set(entry)).alias("_f"))
        .select(
            "asset_id",
            F.size("_f").alias("n_fields"),
            F.concat_ws(",", F.transform("_f", lambda f: f["name"])).alias("field_csv"),
            F.concat_ws(", ", F.transform("_f", lambda f: F.concat_ws(" ", f["name"], f["type"]))).alias("field_text"),
        )
    )


def asset_document(assets: DataFrame, fields: DataFrame) -> DataFrame:
    """One search text per asset: kind, name, fields, description, namespace, storage, format."""

    def part(label: str, c: str) -> Column:
        filled = F.nullif(F.col(c), F.lit(""))
        return F.when(filled.isNotNull(), F.concat(F.lit(label), filled))

    full = asset_normalize(assets).join(collect_fields(fields).drop("n_fields"), "asset_id", "left")
    return full.select(
        "asset_id",
        F.concat_ws(
            " | ",
            F.concat_ws(" ", "asset_type", "name"),
            part("fields: ", "field_text"), part("description: ", "description"), part("namespace: ", "namespace"),
            part("storage ", "storage"), part("format ", "format"),
        ).alias("document"),
    )


def keyword_rank(assets: DataFrame, fields: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Top k assets by query words: 3 for a word of the name, 2 for a part of one
    (either way round), 1 for a word of a field name. Ties by name, then id. A query
    without a word lists the first k assets, each with 0."""
    words = tokens(F.lit(query))
    # at most the words of the query for each asset
    in_field = (
        fields.select("asset_id", F.explode(F.array_intersect(tokens("name"), words)).alias("w"))
        .groupBy("asset_id").agg(F.collect_set("w").alias("_f"))
    )
    named = assets.select("asset_id", "name", tokens("name").alias("_n")).join(in_field, "asset_id", "left")

    def points(word: Column) -> Column:
        partly = F.exists("_n", lambda t: t.contains(word) | word.contains(t))
        by_field = F.coalesce(F.array_contains("_f", word), F.lit(False))
        return F.when(F.array_contains("_n", word), 3).when(partly, 2).when(by_field, 1).otherwise(0)

    score = F.aggregate(words, F.lit(0), lambda total, word: total + points(word))
    scored = named.select("asset_id", "name", score.alias("score"))
    hit = (F.col("score") > 0) | (F.size(words) == 0)
    return scored.where(hit).orderBy(F.col("score").desc(), "name", "asset_id").limit(k)


def resolve_names(names: DataFrame, assets: DataFrame, col: str = "typed") -> DataFrame:
    """Typed name to asset: a table of that name, else a topic of that name."""

    def of(kind: str, out: str) -> DataFrame:
        return (
            assets.where(F.col("asset_type") == kind)
            .groupBy(F.col("name").alias(col))
            .agg(F.min("asset_id").alias(out))
        )

    joined = names.join(of("iceberg_table", "_table"), col, "left").join(of("kafka_topic", "_topic"), col, "left")
    return joined.withColumns(
        {
            "asset_id": F.coalesce("_table", "_topic"),
            "resolved_as": F.when(F.col("_table").isNotNull(), "table").when(F.col("_topic").isNotNull(), "topic"),
        }
    ).drop("_table", "_topic")


# --- schema matching -------------------------------------------------------


def field_sets(fields: DataFrame) -> DataFrame:
    """One row per asset with the sorted set of its squashed field names. The set is
    combined in every task; its size is one schema's vocabulary, not its row count."""
    return fields.groupBy("asset_id", "asset_type", "asset_name").agg(
        F.array_sort(F.collect_set(squash("name"))).alias("names")
    )


def signatures(sets: DataFrame) -> DataFrame:
    """Distinct field sets of each asset type: signature, the sorted names, how many assets have them and the first of those."""
    named = sets.where(F.size("names") > 0).withColumn("signature", F.to_json(F.array_sort("names")))
    return named.groupBy("asset_type", "signature").agg(
        F.count(F.lit(1)).alias("n_assets"), F.min("asset_id").alias("first_id"), F.first(F.array_sort("names")).alias("names")
    )


def signature_overlap(sets: DataFrame, left: str, right: str) -> DataFrame:
    """Every signature of type ``left`` with every one of type ``right`` that shares a name: first_left, first_right,
    n_left and n_right assets, n_shared and shared. Equal field sets are one signature, so copies add no pairs;
    signatures meet by shared names only.
    """
    known = signatures(sets)

    def side(kind: str, tag: str) -> DataFrame:
        own = known.where(F.col("asset_type") == kind)
        return own.select(F.col("signature").alias(f"sig_{tag}"), F.explode("names").alias("name"))

    pairs = side(left, "left").join(side(right, "right"), "name").groupBy("sig_left", "sig_right").agg(F.array_sort(F.collect_set("name")).alias("names"))
    for kind, tag in ((left, "left"), (right, "right")):
        own = known.where(F.col("asset_type") == kind)
        pairs = pairs.join(own.select(F.col("signature").alias(f"sig_{tag}"), F.col("first_id").alias(f"first_{tag}"), F.col("n_assets").alias(f"n_{tag}")), f"sig_{tag}")
    return pairs.select(
        "first_left", "first_right", "n_left", "n_right", F.size("names").alias("n_shared"), F.concat_ws(",", "names").alias("shared")
    )


def match_score(a, b) -> Column:
    """Shared names over the larger set; 0 if either is empty."""
    a, b = col_of(a), col_of(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def similar_signatures(sets: DataFrame, left_type: str, right_type: str, threshold: float = 0.5) -> DataFrame:
    """Pairs of distinct field sets (left kind, right kind) scoring at least the threshold.

    Two steps keep this far from all pairs, without losing any pair:

    * assets with the same field set are one signature, so copies cost nothing;
    * names are ordered rarest first. Sets sharing ``threshold * size`` names must
      share one of their first ``size - ceil(threshold * size) + 1``, so only
      those prefixes are joined. Common names sit at the end and mostly drop out.

    A pair meeting on several names is kept at the smallest one only, which saves
    a distinct over the pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return _similar(_signatures(sets, left_type, right_type), left_type, right_type, threshold).select(
        "left_names", "right_names", "score"
    )


def _signatures(sets: DataFrame, left_type: str, right_type: str) -> DataFrame:
    """Distinct non-empty field sets of both kinds with a number, stored once, so the
    numbers are the same for every reader."""
    of_kind = F.col("asset_type").isin(left_type, right_type)
    distinct = sets.where((F.size("names") > 0) & of_kind).select("asset_type", "names").distinct()
    return settle(distinct.withColumn("sig", F.monotonically_increasing_id()), "signatures")


def _similar(sigs: DataFrame, left_type: str, right_type: str, threshold: float) -> DataFrame:
    """The pairs of :func:`similar_signatures` with their signature numbers."""
    rows = sigs.withColumn("name", F.explode("names"))
    df = rows.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    n = F.size("names")
    keep = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)) + 1
    prefix = (
        rows.join(df, "name")
        .groupBy("asset_type", "sig", "names")
        .agg(F.array_sort(F.collect_list(F.struct("df", "name"))).alias("_o"))
        .withColumn("prefix", F.transform(F.slice("_o", F.lit(1), keep.cast("int")), lambda s: s["name"]))
        .drop("_o")
    )
    exploded = prefix.withColumn("name", F.explode("prefix"))

    def side(kind: str, p: str) -> DataFrame:
        return exploded.where(F.col("asset_type") == kind).select(
            "name", F.col("sig").alias(f"{p}_sig"), F.col("names").alias(f"{p}_names"), F.col("prefix").alias(f"{p}_prefix")
        )

    a, b = F.size("left_names"), F.size("right_names")
    return (
        side(left_type, "left")
        .join(side(right_type, "right"), "name")
        .where(F.least(a, b) >= F.greatest(a, b) * threshold)
        .where(F.array_min(F.array_intersect("left_prefix", "right_prefix")) == F.col("name"))
        .withColumn("score", match_score("left_names", "right_names"))
        .where(F.col("score") >= threshold)
        .select("left_sig", "right_sig", "left_names", "right_names", "score")
    )


def related(fields: DataFrame, left_type: str, right_type: str, threshold: float = 0.5, k: int = 3) -> DataFrame:
    """The k best-matching right assets of every left asset, ties by name and id.

    Ranking happens between signatures; of each signature only its first k assets
    by name can appear in a top k, so only those are joined back.
    """
    sets = settle(field_sets(fields), "field-sets")
    sigs = _signatures(sets, left_type, right_type)
    signed = sets.join(sigs, ["asset_type", "names"])
    right = signed.where(F.col("asset_type") == right_type).select(
        F.col("sig").alias("right_sig"), F.col("asset_id").alias("match_id"), F.col("asset_name").alias("match_name")
    )
    first_k = topk(right, ["right_sig"], [F.col("match_name"), F.col("match_id")], k)
    # pairs move as two numbers and a score; the names come back with the winners
    pairs = _similar(sigs, left_type, right_type, threshold).select("left_sig", "right_sig", "score")
    best = topk(
        pairs.join(first_k, "right_sig"),
        ["left_sig"],
        [F.col("score").desc(), F.col("match_name"), F.col("match_id")],
        k,
    )
    right_names = sigs.select(F.col("sig").alias("right_sig"), F.col("names").alias("right_names"))
    left = signed.where(F.col("asset_type") == left_type).select(
        "asset_id", F.col("sig").alias("left_sig"), F.col("names").alias("left_names")
    )
    return left.join(best.join(right_names, "right_sig"), "left_sig").select(
        "asset_id", "match_id", half_up("score", 6).alias("score"),
        F.concat_ws(",", F.array_sort(F.array_intersect("left_names", "right_names"))).alias("matched"),
    )


def expected_prefix(size: int, threshold: float) -> int:
    """Prefix length used above, for tests and sizing."""
    return size - math.ceil(threshold * size - 1e-9) + 1


