"""Column profiles, hints drawn from them, evaluator scores, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import as_ts, half_up
from tidemark.operators.quality.checks import COLUMNS_PER_PASS, PATTERNS, distinct_count, sketch_distinct
from tidemark.operators.quality.rules import schema_kind
from tidemark.operators.quality.sampling import exact_sample
from tidemark.session import settle

FINGERPRINTS = {
    "email": PATTERNS["email"],
    "ipv4": PATTERNS["ipv4"],
    "uuid": PATTERNS["uuid"],
    "url": PATTERNS["url"],
    "date": PATTERNS["date_iso"],
}
PROFILE_FIELDS = [
    ("column", "string"), ("kind", "string"), ("sampled", "long"), ("non_null", "long"), ("n_distinct", "long"),
    ("min_num", "double"), ("max_num", "double"), ("avg_num", "double"), ("negatives", "long"),
    ("min_time", "timestamp"), ("max_time", "timestamp"), ("future_dates", "long"),
    ("min_len", "long"), ("max_len", "long"),
    *[(f"fp_{name}", "long") for name in FINGERPRINTS],
]


def type_profile(df: DataFrame, as_of, exact: bool = False) -> DataFrame:
    """Counts and extremes of every column by its type, in one aggregate per slice."""
    parts = []
    fields = list(df.schema)
    for at in range(0, len(fields), COLUMNS_PER_PASS):
        aggs, rows = [F.count(F.lit(1)).alias("sampled")], []
        for i, f in enumerate(fields[at : at + COLUMNS_PER_PASS]):
            c, kind = F.col(f.name), schema_kind(f.dataType)
            made: dict[str, Column] = {"non_null": F.count(c)}
            if not exact:
                made["n_distinct"] = sketch_distinct(f.name)
            if kind == "numeric":
                made |= {
                    "min_num": F.min(c).cast("double"), "max_num": F.max(c).cast("double"),
                    "avg_num": half_up(F.avg(c.cast("double")), 4),
                    "negatives": F.count_if(c < 0),
                }
            elif kind == "temporal":
                made |= {
                    "min_time": F.min(c).cast("timestamp"), "max_time": F.max(c).cast("timestamp"),
                    "future_dates": F.count_if(c > as_ts(as_of)),
                }
            elif kind == "string":
                made |= {"min_len": F.min(F.length(c)).cast("long"), "max_len": F.max(F.length(c)).cast("long")}
                made |= {f"fp_{n}": F.count_if(c.rlike(p)) for n, p in FINGERPRINTS.items()}
            aggs += [v.alias(f"{k}_{i}") for k, v in made.items()]
            given = {"column": F.lit(f.name), "kind": F.lit(kind), "sampled": F.col("sampled")}
            given |= {k: F.col(f"{k}_{i}") for k in made}
            rows.append(
                F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in PROFILE_FIELDS])
            )
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if exact:
        counts = distinct_count(df, df.columns[0], True)
        for c in df.columns[1:]:
            counts = counts.unionByName(distinct_count(df, c, True))
        # each column has one row on either side, so the maximum puts them together
        both = out.drop("n_distinct").unionByName(counts.withColumnRenamed("ndv", "n_distinct"), allowMissingColumns=True)
        out = both.groupBy("column").agg(*[F.max(n).alias(n) for n, _ in PROFILE_FIELDS if n != "column"])
    return out


def sample_profile(df: DataFrame, as_of, fraction: float = 1.0, seed: int = 42, exact: bool = False, rows: int | None = None) -> DataFrame:
    """Profile of a Bernoulli sample, or of exactly ``rows`` rows, with rates per column.

    Sampling is by row after the scan: it saves aggregation, not reading. So many ``rows`` are stored,
    as an exact profile reads them once for each column. Fingerprint
    shares are of non-null values; a fingerprint without hits stays null.
    """
    if rows is not None:
        source = settle(exact_sample(df, rows), "sample")
    else:
        source = df if fraction >= 1.0 else df.sample(fraction=fraction, seed=seed)
    p = type_profile(source, as_of, exact)
    nn = F.col("non_null").cast("double")
    shares = {
        f"looks_{n}": F.when(F.col(f"fp_{n}") > 0, half_up(F.try_divide(F.col(f"fp_{n}").cast("double"), nn), 3))
        for n in FINGERPRINTS
    }
    return p.select(
        "column", "kind", "sampled",
        half_up(F.try_divide((F.col("sampled") - F.col("non_null")).cast("double"), F.col("sampled")), 4).alias("null_rate"),
        F.col("n_distinct"),
        half_up(F.try_divide(F.col("n_distinct").cast("double"), nn), 4).alias("distinct_ratio"),
        "min_num", "max_num", "avg_num", "negatives", "min_time", "max_time", "future_dates", "min_len", "max_len",
        *[v.alias(k) for k, v in shares.items()],
    )


def looks_like(profile: DataFrame) -> DataFrame:
    """Adds the sparse map fingerprint -> share."""
    entries = F.array_compact(
        F.array(*[F.when(F.col(f"looks_{n}").isNotNull(), F.struct(F.lit(n).alias("k"), F.col(f"looks_{n}").alias("v"))) for n in FINGERPRINTS])
    )
    return profile.withColumn("looks_like", F.map_from_entries(entries))


def semantic_hints(profile: DataFrame, strong: float = 0.8) -> DataFrame:
    """Checks a profile suggests: strong fingerprints, never-negative numbers, no future dates."""
    proposed = [
        F.when(F.col(f"looks_{n}") >= strong, F.struct(F.lit("regex_match").alias("check"), F.lit(n).alias("pattern")))
        for n in ("email", "ipv4", "uuid", "url")
    ]
    none = F.lit(None).cast("string")
    proposed.append(
        F.when(
            (F.col("negatives") == 0) & (F.col("min_num") >= 0),
            F.struct(F.lit("non_negative").alias("check"), none.alias("pattern")),
        )
    )
    proposed.append(
        F.when(
            (F.col("kind") == "temporal") & (F.coalesce(F.col("future_dates"), F.lit(0)) == 0),
            F.struct(F.lit("not_future").alias("check"), none.alias("pattern")),
        )
    )
    return profile.select("column", F.inline(F.array_compact(F.array(*proposed))))


def evaluator_scores(profile: DataFrame, rows: str = "total", nulls: str = "nulls") -> DataFrame:
    """Completeness score per column, 0 for an empty table; below 80 is a violation,
    critical under 50."""
    score = half_up(
        F.coalesce(F.lit(100.0) - F.try_divide(F.col(nulls).cast("double"), F.col(rows)) * 100, F.lit(0.0)), 1
    )
    return profile.withColumn("score", score).withColumns(
        {
            "status": F.when(F.col("score") >= 80, "pass").otherwise("fail"),
            "severity": F.when(F.col("score") < 50, "critical").when(F.col("score") < 80, "warning"),
        }
    )


def quarantine_split(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with the names of their null columns)."""
    reasons = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
