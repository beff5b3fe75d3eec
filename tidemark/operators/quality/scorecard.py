"""Whole-table scorecards: completeness, uniqueness, rule violations, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import half_up, pct_label, three_level
from tidemark.operators.quality.checks import COLUMNS_PER_PASS, distinct_status, sketch_distinct
from tidemark.operators.quality.rules import RULE_LIMITS, RULES, rule_fits, schema_rules

WARN_NULL, FAIL_NULL = 0.05, 0.20
FLAG_BITS = 62  # flags that share a number


def is_id_column(name: str, with_uuid: bool = False) -> bool:
    n = name.lower()
    return n == "id" or n.endswith(("_id", "_key")) or (with_uuid and n.endswith("_uuid"))


def measure(df: DataFrame, table: str, as_of, ids: list[str], rules: list[tuple[str, str]], exact: bool) -> DataFrame:
    """Counts of every check of a table in one aggregate, one row per check.

    Rows: kind, column, rule, total, non_null, hits (violations or distinct).
    Tables wider than ``COLUMNS_PER_PASS`` are aggregated slice by slice. Exact distinct counts are part of
    the same scan: every task combines (column, value) rows before they move, beside the
    rows of all other counts.
    """
    parts = []
    for at in range(0, len(df.columns), COLUMNS_PER_PASS):
        cols = df.columns[at : at + COLUMNS_PER_PASS]
        flags, distinct, rows = {}, {}, []

        def row(kind, col, rule, nn, hits):
            rows.append(
                F.struct(
                    F.lit(kind).alias("check"), F.lit(col).alias("column"), F.lit(rule).alias("rule"),
                    F.col("total"), nn.alias("non_null"), hits.cast("long").alias("hits"),
                )
            )

        for i, c in enumerate(cols):
            flags[f"nn_{i}"] = F.col(c).isNotNull()
            row("completeness", c, "", F.col(f"nn_{i}"), F.col("total") - F.col(f"nn_{i}"))
            if c in ids:
                distinct[f"ndv_{i}"] = c
                row("uniqueness", c, "", F.col(f"nn_{i}"), F.col(f"ndv_{i}"))
            for j, rule in enumerate(r for col, r in rules if col == c):
                flags[f"v_{i}_{j}"] = RULES[rule](F.col(c), as_of)
                row("validity", c, rule, F.col(f"nn_{i}"), F.col(f"v_{i}_{j}"))
        if exact and distinct:
            counts = _exact_counts(df, flags, distinct)
        else:
            aggs = [F.count_if(f).alias(n) for n, f in flags.items()] + [sketch_distinct(c).alias(n) for n, c in distinct.items()]
            counts = df.agg(F.count(F.lit(1)).alias("total"), *aggs)
        parts.append(counts.select(F.lit(table).alias("asset"), F.inline(F.array(*rows))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _exact_counts(df: DataFrame, flags: dict[str, Column], distinct: dict[str, str]) -> DataFrame:
    """``total``, how often each flag is true and the distinct values of columns, as one row from one scan.

    A row's flags are the bits of a few numbers, and rows are counted by these numbers as well as by each column's
    values. So a value that a task keeps carries one count, not a buffer for every check.
    """
    names = list(flags)
    blocks = [names[i : i + FLAG_BITS] for i in range(0, len(names), FLAG_BITS)]
    masks = [
        sum(
            (F.when(flags[n], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(block)), F.lit(0).cast("long")
        )
        for block in blocks
    ]
    mask_cols = [f"_m{i}" for i in range(len(blocks))]
    id_cols = [f"_{n}" for n in distinct]
    coded = df.select(*[m.alias(n) for m, n in zip(masks, mask_cols)], *[F.col(c).alias(n) for c, n in zip(distinct.values(), id_cols)])
    keys = mask_cols + id_cols
    grouped = coded.groupingSets([mask_cols, *[[c] for c in id_cols]], *keys).agg(
        F.count(F.lit(1)).alias("_n"), *[(F.grouping(c) == 0).alias(f"in{c}") for c in (mask_cols[0], *id_cols)]
    )
    rows_of = F.col(f"in{mask_cols[0]}")

    def counted(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("_n"))), F.lit(0).cast("long"))

    aggs = [counted(rows_of).alias("total")]
    for mask, block in zip(mask_cols, blocks):
        aggs += [counted(rows_of & (F.col(mask).bitwiseAND(F.lit(1 << i)) != 0)).alias(n) for i, n in enumerate(block)]
    aggs += [F.count_if(F.col(f"in{c}") & F.col(c).isNotNull()).alias(n) for n, c in zip(distinct, id_cols)]
    return grouped.agg(*aggs)


def grade_scorecard(measured: DataFrame) -> DataFrame:
    """metric value, label and status per measured check.

    Completeness grades the null rate, uniqueness the distinct share of all rows,
    validity the violation share of non-null rows.
    """
    limits = F.create_map(
        *[x for r, (w, f) in RULE_LIMITS.items() for x in (F.lit(r), F.array(F.lit(w), F.lit(f)))]
    )
    hits = F.col("hits").cast("double")
    nulls = F.coalesce(F.try_divide(hits, F.col("total")), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(hits, F.col("total")), F.lit(1.0))
    base = F.when(F.col("rule") == "not_null", F.col("total")).otherwise(F.col("non_null"))
    share = F.coalesce(F.try_divide(hits, base), F.lit(0.0))
    kind = F.col("check")
    bounds = F.element_at(limits, F.col("rule"))
    status = (
        F.when(kind == "completeness", three_level(nulls, WARN_NULL, FAIL_NULL))
        .when(kind == "uniqueness", distinct_status(ratio))
        .otherwise(three_level(share * 100, bounds[0], bounds[1]))
    )
    value = F.when(kind == "completeness", nulls).when(kind == "uniqueness", F.lit(1.0) - ratio).otherwise(share)
    label = (
        F.when(kind == "completeness", pct_label(nulls * 100, "null"))
        .when(kind == "uniqueness", pct_label(ratio * 100, "distinct"))
        .otherwise(pct_label(share * 100, "invalid"))
    )
    return measured.select(
        "asset", "check", "column", "rule", "total", "non_null", "hits",
        half_up(value, 4).alias("metric_value"), label.alias("label"), status.alias("status"),
    )


def scorecard(df: DataFrame, table: str, as_of, mode: str = "token", exact: bool = False) -> DataFrame:
    """Completeness, uniqueness of id columns and inferred rules of a whole table.

    One scan, with approximate distinct counts or, if ``exact``, with exact ones.
    """
    ids = [c for c in df.columns if is_id_column(c)]
    return grade_scorecard(measure(df, table, as_of, ids, schema_rules(df, mode), exact))


def completeness(df: DataFrame, table: str = "") -> DataFrame:
    return grade_scorecard(measure(df, table, None, [], [], False))


def uniqueness(df: DataFrame, ids: list[str], denom: str = "total", exact: bool = True) -> DataFrame:
    """Distinct share of id-like columns, over all rows or over non-null rows."""
    if denom not in ("total", "non_null"):
        raise ValueError("denom is 'total' or 'non_null'")
    narrow = df.select(*ids)
    rows = measure(narrow, "", None, ids, [], exact).where(F.col("check") == "uniqueness")
    ratio = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col(denom)), F.lit(1.0))
    return rows.select(
        "column", "total", "non_null", "hits", half_up(ratio, 4).alias("ratio"), distinct_status(ratio).alias("status")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Row count and non-null count of every column, one scan."""
    return measure(df, "", None, [], [], False).select("column", "total", "non_null", F.col("hits").alias("nulls"))


def rule_violations(df: DataFrame, table: str, as_of, rules: list[tuple[str, str]]) -> DataFrame:
    """Total, violations and share per (column, rule); unknown columns and rules, and
    rules that do not fit their column's type, are reported with status ``error`` and not run."""
    types = {f.name: f.dataType for f in df.schema.fields}
    good = [(c, r) for c, r in rules if c in types and rule_fits(r, types[c])]
    bad = [(c, r) for c, r in rules if (c, r) not in good]
    narrow = df.select(*dict.fromkeys(c for c, _ in good))
    graded = grade_scorecard(measure(narrow, table, as_of, [], good, False)).where(F.col("check") == "validity")
    base = F.when(F.col("rule") == "not_null", F.col("total")).otherwise(F.col("non_null"))
    out = graded.select(
        "column", "rule", base.alias("checked"), F.col("hits").alias("violations"), "metric_value", "status"
    )
    if bad:
        spark = df.sparkSession
        rows = spark.createDataFrame(
            [(c, r, None, None, None, "error") for c, r in bad],
            "column string, rule string, checked long, violations long, metric_value double, status string",
        )
        out = out.unionByName(rows)
    return out


def overall_score(checks: DataFrame, by: list[str]) -> DataFrame:
    """100 * mean of pass=1, warn=0.5, fail=0; info rows ignored, none graded = 100.

    The driver is the non-passing check with the largest metric value.
    """
    graded = F.col("status").isin("pass", "warn", "fail")
    weight = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    bad = F.col("status").isin("warn", "fail")
    n = F.count_if(graded)
    # min_by over the negated value: the largest value wins, then the smaller column name
    worst = F.min_by(
        F.when(bad, F.concat_ws(" ", "column", "label")),
        F.when(bad, F.struct(-F.col("metric_value"), F.col("column"), F.col("check"), F.col("rule"))),
    )
    return checks.groupBy(*by).agg(
        half_up(F.coalesce(F.try_divide(F.sum(F.when(graded, weight)), n) * 100, F.lit(100.0)), 1).alias("score"),
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(F.col("status") == "warn").alias("n_warn"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
        F.coalesce(worst, F.lit("")).alias("driver"),
    )


def worst_check(checks: DataFrame, by: list[str]) -> DataFrame:
    """The non-passing check with the largest metric value per group; ties by column, check, rule."""
    order = F.struct(-F.col("metric_value"), F.col("column"), F.col("check"), F.col("rule"))
    row = F.struct("check", "column", "rule", "label", "metric_value")
    return (
        checks.where(F.col("status").isin("warn", "fail"))
        .groupBy(*by)
        .agg(F.min_by(row, order).alias("w"))
        .select(*by, "w.*")
    )


def results_score(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean metric (percent complete) of stored rows, info rows excluded."""
    counted = F.col("status") != "info"
    return results.groupBy(*by).agg(
        half_up(F.try_divide(F.sum(F.when(counted, F.col("metric_value"))), F.count_if(counted)), 1).alias("score"),
        F.count_if(counted).alias("n_checks"),
    )


def profile_rows(checks: DataFrame, as_of_ms: int) -> DataFrame:
    """Completeness rows as catalog column profiles with a test status (warn counts as failed)."""
    return checks.where(F.col("check") == "completeness").select(
        "asset", F.col("column").alias("name"), F.lit(as_of_ms).cast("long").alias("ts_ms"),
        F.col("metric_value").alias("null_proportion"),
        F.col("hits").cast("long").alias("null_count"),
        F.col("total").alias("values_count"),
        F.when(F.col("status") == "pass", "Success").otherwise("Failed").alias("test_status"),
    )


def result_rows(checks: DataFrame, run_id: str, run_ts) -> DataFrame:
    """Checks in the 11-column layout of the results table (percent complete as metric)."""
    limits = F.create_map(
        *[x for r, (w, f) in RULE_LIMITS.items() for x in (F.lit(r), F.array(F.lit(w), F.lit(f)))]
    )
    bounds = F.element_at(limits, F.col("rule"))
    kind = F.col("check")
    return checks.select(
        F.lit(run_id).alias("run_id"), F.lit(run_ts).cast("timestamp").alias("run_timestamp"),
        F.col("asset").alias("table_name"),
        F.when(kind == "validity", F.col("rule")).otherwise(kind).alias("check_name"),
        F.col("column").alias("column_name"),
        half_up((F.lit(1.0) - F.col("metric_value")) * 100, 2).alias("metric_value"),
        F.col("label").alias("metric_label"), "status",
        F.when(kind == "completeness", WARN_NULL * 100).when(kind == "uniqueness", 1.0).otherwise(bounds[0]).alias("threshold_warn"),
        F.when(kind == "completeness", FAIL_NULL * 100).when(kind == "uniqueness", 10.0).otherwise(bounds[1]).alias("threshold_fail"),
        F.lit("spark").alias("engine"),
    )
