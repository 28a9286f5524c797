"""Counts by axis, quota checks, pivots, slices, balance tables, min-max selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def axis_counts(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Frequency table of each axis in one pass: ``axis, value, n``; nulls are counted as null."""
    x = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])).alias("e"))
    return x.select("e.*").groupBy("axis", "value").agg(F.count("*").alias("n"))


def quota_check(actual: DataFrame, targets: DataFrame, total: Column | int) -> DataFrame:
    """``actual``: ``category, n``; ``targets``: ``category, target_share``. Expected counts (share times total, rounded half to even) beside actual ones,
    categories of either side, and their difference."""
    x = actual.join(targets, "category", "full").select("category", F.coalesce("n", F.lit(0)).alias("actual"), F.bround(F.coalesce("target_share", F.lit(0.0)) * total).cast("bigint").alias("expected"))
    return x.withColumn("difference", F.col("actual") - F.col("expected"))


def slice_means(rows: DataFrame, axes: list[str], metric: str) -> DataFrame:
    """Count and mean of a metric by each value of each axis; missing values are ``unknown``."""
    x = rows.select(metric, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("value")) for a in axes])).alias("e"))
    return x.groupBy("e.axis", "e.value").agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))


def position_balance(rows: DataFrame, group: str, count: str, position: str) -> DataFrame:
    """Counts of each position from 1 to ``count`` within a group, zeros included, with the tolerance max(2, ceil(5 % of the group))."""
    n = rows.groupBy(group, count, position).agg(F.count("*").alias("n"))
    cells = rows.groupBy(group, count).agg(F.count("*").alias("total")).withColumn(position, F.explode(F.sequence(F.lit(1), F.col(count))))
    x = cells.join(n, [group, count, position], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(group, count)
    return x.withColumn("spread", F.max("n").over(w) - F.min("n").over(w)).withColumn("tolerance", F.greatest(F.lit(2), F.ceil(0.05 * F.col("total")).cast("int")))


def min_max(x: Column | str, over: Window | None = None) -> Column:
    """Scaled to [0, 1] over the window (the whole table by default); a constant column is 0.5."""
    c = F.col(x) if isinstance(x, str) else x
    w = over or Window.partitionBy()
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, F.lit(0.5)).otherwise((c - low) / (high - low))


def scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_scaled``: the extremes come from an aggregation, so that no window gathers the table."""
    ends = rows.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("low", F.min), ("high", F.max))])
    x = rows.crossJoin(F.broadcast(ends))
    for c in columns:
        low, high = F.col(f"low_{c}"), F.col(f"high_{c}")
        x = x.withColumn(f"{c}_scaled", F.when(high == low, F.lit(0.5)).otherwise((F.col(c) - low) / (high - low)))
    return x.drop(*ends.columns)


def majority(votes: DataFrame, key: str, reviewer: str, vote: str, required: int) -> DataFrame:
    """Strict majority of the last vote of each reviewer; ties and too few reviewers stay unresolved (null)."""
    n = votes.groupBy(key, vote).agg(F.count("*").alias("n"))
    x = n.groupBy(key).agg(F.sum("n").alias("votes"), F.max("n").alias("most"), F.max_by(vote, F.struct("n", vote)).alias("top"))
    r = votes.groupBy(key).agg(F.countDistinct(reviewer).alias("reviewers"))
    return x.join(r, key).select(key, "reviewers", "votes", F.when((F.col("reviewers") >= required) & (F.col("most") * 2 > F.col("votes")), F.col("top")).alias("decision"))


def stratified(rows: DataFrame, strata: list[str], key: str, share: float, salt: int) -> DataFrame:
    """Marks ``dev`` rows: of each stratum of four or more, max(1, round(share * n)) in the order of a salted hash. Only the rows below the cut are ranked by each task."""
    n = rows.groupBy(*strata).agg(F.count("*").alias("size"))
    take = F.when(F.col("size") >= 4, F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("size")).cast("int"))).otherwise(F.lit(0))
    h = F.sha2(F.concat_ws("|", F.lit(str(salt)), F.col(key).cast("string")), 256)
    same = [F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")) for s in strata]
    x = rows.alias("a").join(n.alias("b"), same).select("a.*", "b.size").withColumn("h", h)
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("h", key))
    return x.withColumn("split", F.when(rank <= take, F.lit("dev")).otherwise(F.lit("train"))).drop("h", "size")
