"""Window schedules, contexts and prediction losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstream.operators.grid import div


def schedule(df: DataFrame, total: str, window: int = 16, stride: int = 2) -> DataFrame:
    """A row per scored window of a stream of ``total`` frames.

    The windows first expand from frame 0 up to the full length, then slide; each
    targets its last tubelet. The first tubelet has no past and is never a target.
    """
    t, half = F.col(total), window // 2
    grown = df.withColumn("_e", F.explode(F.sequence(F.lit(3), F.lit(window - 1), F.lit(2)))).filter(F.col("_e") < F.least(F.lit(window), t))
    expanding = grown.select(
        *df.columns, F.lit(0).alias("start"), (F.col("_e") + 1).alias("length"), div(F.col("_e"), 2).alias("target"), F.lit("expanding").alias("mode")
    )
    slid = df.filter(t - window >= 2).withColumn("_s", F.explode(F.sequence(F.lit(2), t - window, F.lit(stride))))
    sliding = slid.select(
        *df.columns, F.col("_s").alias("start"), F.lit(window).alias("length"), (div(F.col("_s"), 2) + half - 1).alias("target"), F.lit("sliding").alias("mode")
    ).filter(F.col("target") < div(t + 1, 2))
    return expanding.unionByName(sliding)


def skip_targets(windows: DataFrame, skipped: DataFrame, keys: list[str]) -> DataFrame:
    """Windows whose target is not in the skip set (keys, target)."""
    return windows.join(skipped, [*keys, "target"], "left_anti")


def ring(frames: DataFrame, keys: list[str], window: int = 16, least: int = 4) -> DataFrame:
    """Per frame the first frame still in a ring of ``window`` frames, the frames held, and whether there are enough to score."""
    by = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-(window - 1), 0)
    out = frames.withColumn("oldest", F.min("frame_idx").over(by)).withColumn("held", F.count(F.lit(1)).over(by))
    return out.withColumn("keep_all", F.col("held") < least)


def context_losses(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The surrogate prediction loss of each cell of each tubelet: |its mean - the mean of its past|.

    ``cells`` has the keys, patch, tubelet, total and n, integer sums and counts of
    micro-units. The past is the ``reach`` tubelets before; without one the loss is
    null.
    """
    past = Window.partitionBy(*keys, "patch").orderBy("tubelet").rangeBetween(-reach, -1)
    out = cells.withColumn("_s", F.sum("total").over(past)).withColumn("_n", F.sum("n").over(past))
    gap = F.abs(F.col("total") / F.col("n") - F.col("_s") / F.col("_n"))
    return out.withColumn("loss", F.rint(gap).cast("bigint")).drop("_s", "_n")


def surround_losses(cells: DataFrame, keys: list[str]) -> DataFrame:
    """As ``context_losses``, but the context is everything else of the patch, the future included."""
    whole = Window.partitionBy(*keys, "patch")
    s, n = F.sum("total").over(whole) - F.col("total"), F.sum("n").over(whole) - F.col("n")
    out = cells.withColumn("_s", s).withColumn("_n", n)
    gap = F.when(F.col("_n") > 0, F.abs(F.col("total") / F.col("n") - F.col("_s") / F.col("_n")))
    return out.withColumn("loss", F.rint(gap).cast("bigint")).drop("_s", "_n")


def l1(predicted: Column, target: Column) -> Column:
    """Mean absolute error of two vectors."""
    gaps = F.zip_with(predicted, target, lambda p, t: F.abs(p - t))
    return F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.size(gaps)


def carry_over(history: DataFrame, latest: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A running mask or score: new cells overwrite the history, the rest stay."""
    new = latest.select(*keys, F.col(value).alias("_new"))
    both = history.join(new, keys, "full_outer")
    return both.withColumn(value, F.coalesce("_new", value)).drop("_new")


def overlap_average(scores: DataFrame, grid: DataFrame, keys: list[str], value: str = "loss") -> DataFrame:
    """Sum / max(count, 1) of overlapping windows' integer scores on a full grid; cells without a score get 0."""
    agg = scores.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    full = grid.join(agg, keys, "left")
    n = F.coalesce("_n", F.lit(0))
    return full.select(*keys, n.alias("windows"), (F.coalesce("_s", F.lit(0)) / F.greatest(F.lit(1), n)).alias(value))
