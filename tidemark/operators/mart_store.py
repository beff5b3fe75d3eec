"""The daily mart as a stored table that is refreshed day by day.

A refresh reads the facts of its days only. What the windows need of the past, the running total and the last
seven values of each series, is stored with every day and carried on, so no earlier day is read
again. Late facts of an old day replace that day and move the windows of the days after it, whose
own measures are taken from the store and not from the facts.

Every refresh writes its days to a folder of its own and then a manifest that says for each day which
version holds it. Readers resolve the newest complete manifest: they see all days before a refresh or all
days after it, and a failed or repeated write leaves nothing that a reader could meet.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import as_ts
from tidemark.operators.orders import GRAIN, as_doubles, mart_windows, rank_sum
from tidemark.session import settle

SERIES = ["region", "category"]
#: Values that the longest window or lag looks back.
BACK = 7
MANIFEST = T.StructType([T.StructField("report_date", T.DateType()), T.StructField("version", T.LongType())])


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first. One whose manifest was not written to its end is none."""
    place, fs = _folder(spark, f"{path}/manifest")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("v")) for n in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """report_date and the version that holds it, one row a day."""
    known = versions(spark, path)
    if version is None and not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{known[-1] if version is None else version}")


def _resolved(spark: SparkSession, path: str, kind: str, held: DataFrame) -> DataFrame | None:
    """Stored rows of the days and versions of a manifest; None if it names none."""
    used = sorted(r[0] for r in held.select("version").distinct().collect())  # a row a refresh still in use
    if not used:
        return None
    return spark.read.parquet(*[f"{path}/{kind}/v{v}" for v in used]).join(held, ["report_date", "version"]).drop("version")


def read_mart(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, version: int | None = None) -> DataFrame:
    """The mart of the newest or a given version, all days or those in [since, until]."""
    held = manifest(spark, path, version)
    for limit, keep in ((since, lambda c, d: c >= d), (until, lambda c, d: c <= d)):
        if limit is not None:
            held = held.where(keep(F.col("report_date"), F.to_date(F.lit(limit))))
    found = _resolved(spark, path, "mart", held)
    if found is None:
        raise FileNotFoundError(f"{path} holds no day of this range")
    return as_doubles(found)


def advance(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Daily rows with the mart's windows, begun from the state of each series, and ``held``, the state after each row.

    The state is a series' ``total`` and its ``last`` values, oldest first. Its values stand before the
    rows as if they were rows, so windows and lags run over them; the total is added.
    """
    series = rows.withColumns({"total": F.lit(None).cast("decimal(38,6)"), "seed": F.lit(False)})
    if state is not None:
        values = state.select(*SERIES, "total", F.posexplode("last").alias("nth", "net_revenue"))
        before = values.withColumns({"report_date": F.date_add(F.lit("0001-01-01").cast("date"), F.col("nth")), "seed": F.lit(True)}).drop("nth")
        series = before.unionByName(series, allowMissingColumns=True)
    order = Window.partitionBy(*SERIES).orderBy("report_date", "channel")
    carried = F.coalesce(F.max("total").over(Window.partitionBy(*SERIES)), F.lit(0).cast("decimal(38,6)"))
    own = F.sum(F.when(~F.col("seed"), F.col("net_revenue"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.collect_list("net_revenue").over(order.rowsBetween(1 - BACK, 0))
    windowed = mart_windows(series).withColumn("cumulative_revenue", (carried + own).cast("decimal(38,6)"))
    held = F.struct(F.col("cumulative_revenue").alias("total"), last.alias("last"))
    return windowed.withColumn("held", held).where(~F.col("seed")).drop("seed", "total")


def day_states(advanced: DataFrame, state: DataFrame | None, days: list[date]) -> DataFrame:
    """The state of every series after each of ``days``: its own, or the one before where the day has no row of it."""
    ends = advanced.groupBy("report_date", *SERIES).agg(F.max_by("held", "channel").alias("held"))
    known = ends.select(*SERIES)
    if state is not None:
        known = known.unionByName(state.select(*SERIES))
    listed = F.explode(F.array(*[F.lit(d) for d in days])).alias("report_date")  # a series' own days, not pairs of rows
    grid = known.distinct().select(*SERIES, listed).join(ends, ["report_date", *SERIES], "left")
    filled = F.last("held", ignorenulls=True).over(Window.partitionBy(*SERIES).orderBy("report_date"))
    out = grid.withColumn("held", filled)
    if state is not None:
        old = state.select(*SERIES, F.struct("total", "last").alias("old"))
        out = out.join(old, SERIES, "left").withColumn("held", F.coalesce("held", "old"))
    return out.where(F.col("held").isNotNull()).select("report_date", *SERIES, "held.*")


def refresh(path: str, base: DataFrame, days: Iterable[str], as_of) -> int:
    """Replace ``days`` of the mart at ``path`` by the daily rows of ``base`` and return the version that holds them.

    ``base`` is :func:`orders.daily_base` of facts of those days. A day without rows is removed. Days after the first one
    keep their measures and ranks and get new windows. Rows with a null key have no series; they count in the
    ranks of their day and are left out, as in the mart. If nothing differs from what is stored, no version is written.
    """
    spark = base.sparkSession
    wanted = sorted({date.fromisoformat(str(d)) for d in days})
    if not wanted:
        raise ValueError("name the days that are replaced")
    held = settle(manifest(spark, path), "mart-manifest")
    measures = [c for c in base.columns if c not in GRAIN]
    listed = base.where(F.col("report_date").isin(wanted)) if len(wanted) < 1000 else base.join(
        spark.createDataFrame([(d,) for d in wanted], "report_date date"), "report_date"
    )
    facts = settle(listed.select(*GRAIN, *measures), "mart-days")
    # rows with a null key take part in the ranks of their day only
    regions = rank_sum(facts, ["report_date"], ["region"], "net_revenue", "region_revenue_rank")
    categories = rank_sum(facts, ["report_date", "region"], ["category"], "net_revenue", "category_revenue_rank")
    ranked = facts.dropna(subset=GRAIN).join(regions, ["report_date", "region"]).join(categories, ["report_date", "region", "category"])
    fresh = settle(ranked.select(*GRAIN, *measures, "region_revenue_rank", "category_revenue_rank"), "mart-fresh")

    is_wanted = F.col("report_date").isin(wanted) if len(wanted) < 1000 else F.col("report_date").between(wanted[0], wanted[-1])
    old = _resolved(spark, path, "mart", held.where(is_wanted))
    if old is not None:
        old = old.select(*fresh.columns)
        if fresh.exceptAll(old).isEmpty() and old.exceptAll(fresh).isEmpty():
            return versions(spark, path)[-1]
    elif fresh.isEmpty():
        return (versions(spark, path) or [-1])[-1]

    later = _resolved(spark, path, "mart", held.where((F.col("report_date") > wanted[0]) & ~is_wanted))
    rows = fresh if later is None else fresh.unionByName(later.select(*fresh.columns))
    earlier = held.where(F.col("report_date") < wanted[0]).orderBy(F.desc("report_date")).limit(1)
    state = _resolved(spark, path, "state", earlier)

    version = (versions(spark, path) or [-1])[-1] + 1
    advanced = settle(advance(rows, state), "mart-advanced")
    written = sorted(r[0] for r in advanced.select("report_date").distinct().collect())  # days, not rows
    mark = F.lit(version).cast("long").alias("version")
    mart = advanced.drop("held").withColumn("computed_at", as_ts(as_of)).select("*", mark)
    # days in order, so that readers of a few days skip the other row groups
    mart.repartitionByRange("report_date").sortWithinPartitions("report_date").write.mode("overwrite").parquet(f"{path}/mart/v{version}")
    if written:
        states = day_states(advanced, None if state is None else state.drop("report_date"), written).select("*", mark)
        states.repartitionByRange("report_date").sortWithinPartitions("report_date").write.mode("overwrite").parquet(f"{path}/state/v{version}")
    kept = held.where((F.col("report_date") < wanted[0]))
    now = spark.createDataFrame([(d, version) for d in written], MANIFEST)
    # the last write, and the only one that readers look for; another writer of this version fails here
    kept.unionByName(now).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/v{version}")
    return version


def remove_unused(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete folders that none of the newest ``keep`` manifests names, and older manifests; returns what went."""
    known = versions(spark, path)
    kept = known[-max(keep, 1) :]
    used = {r[0] for v in kept for r in manifest(spark, path, v).select("version").distinct().collect()}
    gone = []
    for kind, live in (("manifest", set(kept)), ("mart", used), ("state", used)):
        place, fs = _folder(spark, f"{path}/{kind}")
        for status in fs.listStatus(place) if fs.exists(place) else []:
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:]) not in live and int(name[1:]) <= known[-1]:
                fs.delete(status.getPath(), True)
                gone.append(f"{kind}/{name}")
    return gone
