"""Counter roll-ups and service KPIs over (ts, dimensions, counter, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import half_up

DIMS = ["area", "spectrum", "carrier", "cell"]


def counter_windows(df: DataFrame, by: list[str], width: str = "15 minutes") -> DataFrame:
    """Sum, average, maximum and minimum per tumbling window. Also runs on a
    watermarked stream."""
    return (
        df.groupBy(F.window("ts", width).alias("w"), *by)
        .agg(
            F.sum("value").alias("total"), F.avg("value").alias("mean"),
            F.max("value").alias("highest"), F.min("value").alias("lowest"),
        )
        .select(F.col("w.start").alias("window_start"), *by, "total", "mean", "highest", "lowest")
    )


def summed(counters: list[str], counter: str = "counter", value: str = "value") -> Column:
    """Sum of the listed counters."""
    return F.sum(F.when(F.col(counter).isin(counters), F.col(value)))


def ratio_pct(good, bad, digits: int = 2) -> Column:
    good, bad = F.coalesce(good, F.lit(0)), F.coalesce(bad, F.lit(0))
    return half_up(F.try_divide(F.lit(100.0) * good, good + bad), digits)


FAILS = ["FAIL_RADIO", "FAIL_CORE", "FAIL_AUTH"]


def hierarchy_rollup(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Totals and success rate at every level of the hierarchy, upper keys null.

    The leaf level is aggregated first and the roll-up runs over that small
    result, so the raw rows are not copied per level. Rates are sum over sum.
    """
    dims = dims or DIMS
    leaf = df.groupBy(*dims).agg(
        F.sum("value").alias("total"), summed(["SUCC"]).alias("succ"), summed(FAILS).alias("fail")
    )
    return (
        leaf.rollup(*dims)
        .agg(
            F.sum("total").alias("total"), F.sum("succ").alias("succ"), F.sum("fail").alias("fail"),
            F.grouping_id().cast("long").alias("level_bits"),
        )
        .withColumn("success_pct", ratio_pct(F.col("succ"), F.col("fail")))
    )


def measurement_sum(df: DataFrame, measures: dict[str, list[str]], by: list[str]) -> DataFrame:
    """Each measurement is the sum of its counters; all in one aggregate."""
    return df.groupBy(*by).agg(
        *[F.coalesce(summed(counters), F.lit(0)).alias(name) for name, counters in measures.items()]
    )


def busy_hour(df: DataFrame, by: list[str], width: str = "1 hour") -> DataFrame:
    """Largest window total of the day and when it was; the earlier window wins a tie."""
    hourly = df.groupBy(F.window("ts", width).alias("w"), *by).agg(F.sum("value").alias("total"))
    order = F.struct(-F.col("total"), F.col("w.start"))
    return (
        hourly.groupBy(F.to_date("w.start").alias("day"), *by)
        .agg(F.min_by(F.struct("total", F.col("w.start").alias("busy_at")), order).alias("b"))
        .select("day", *by, F.col("b.busy_at").alias("busy_at"), F.col("b.total").alias("busy_total"))
    )


def success_rate(df: DataFrame, by: list[str]) -> DataFrame:
    return (
        df.groupBy(*by)
        .agg(summed(["SUCC"]).alias("succ"), summed(FAILS).alias("fail"))
        .withColumn("success_pct", ratio_pct(F.col("succ"), F.col("fail")))
    )


def sla_status(daily: DataFrame, by: list[str], value: str, target: float, critical: float) -> DataFrame:
    """Daily value against the target, with yesterday's value and the 7-day average.

    The average goes by calendar days, so a missing day does not stretch it.
    """
    w = Window.partitionBy(*by).orderBy("day")
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    week = Window.partitionBy(*by).orderBy("_n").rangeBetween(-6, 0)
    v = F.col(value)
    mean = F.try_divide(F.sum(v.cast("decimal(20,6)")).over(week).cast("double"), F.count(v).over(week))
    return (
        daily.withColumn("_n", number)
        .withColumns({"vs_yesterday": half_up(v - F.lag(v).over(w), 2), "avg_7d": half_up(mean, 2)})
        .withColumn("status", F.when(v >= target, "OK").when(v >= critical, "WARNING").otherwise("CRITICAL"))
        .drop("_n")
    )


def cause_breakdown(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of every cause among the rejections, per group."""
    causes = df.where(F.col("counter").isin(FAILS)).groupBy(*by, "counter").agg(F.sum("value").alias("rejections"))
    whole = F.sum("rejections").over(Window.partitionBy(*by))
    return causes.withColumn("share_pct", half_up(F.try_divide(F.lit(100.0) * F.col("rejections"), whole), 2))


def zscore(daily: DataFrame, by: list[str], value: str, days: int = 7, limit: float = 1.5) -> DataFrame:
    """Deviation from the mean of the preceding days in standard deviations; flagged
    beyond the limit. Days without history have none."""
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    past = Window.partitionBy(*by).orderBy("_n").rangeBetween(-days, -1)
    v = F.col(value).cast("double")
    z = F.try_divide(v - F.avg(v).over(past), F.stddev_samp(v).over(past))
    return (
        daily.withColumn("_n", number)
        .withColumn("zscore", half_up(z, 4))
        .withColumn("anomaly", F.abs(F.col("zscore")) > limit)
        .drop("_n")
    )


def saturation(daily: DataFrame, by: list[str], value: str, cap: float = 95.0) -> DataFrame:
    """Linear trend per group and days until the cap, null if the trend does not rise."""
    x = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date")).cast("double")
    y = F.col(value).cast("double")
    fit = daily.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.max_by(y, x).alias("latest"), F.count(y).alias("days")
    )
    left = F.ceil(F.try_divide(F.lit(cap) - F.col("latest"), F.col("slope")))
    return fit.select(
        *by, half_up("slope", 6).alias("slope"), "latest", "days",
        F.when(F.col("latest") >= cap, F.lit(0)).when(half_up("slope", 6) > 0, left).cast("long").alias("days_left"),
    )


def headroom(df: DataFrame, used: str, total: str, alert_pct: float = 25.0) -> DataFrame:
    """Used and spare share of a capacity; alert under the spare limit."""
    used_pct = half_up(F.try_divide(F.lit(100.0) * F.col(used), F.col(total).cast("double")), 2)
    return df.withColumn("used_pct", used_pct).withColumns(
        {
            "spare_pct": half_up(F.lit(100.0) - F.col("used_pct"), 2),
            "alert": (F.lit(100.0) - F.col("used_pct")) < alert_pct,
        }
    )
