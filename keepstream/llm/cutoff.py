"""A score cutoff per source that keeps a target share of its values.

Equal scores of a source are counted first, which takes repeated values out of
the way, then the (source, score, count) rows are range-sorted, each partition
sums by itself, and the prefix sums of the partitions tell which partition holds
the target rank. The exact row is read from that partition only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstream.operators.ranged import GROUP, LOCAL, PID, offsets, ranged_sums
from keepstream.session import durable


def latest_windows(df: DataFrame, key: Sequence[str], latest: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per key, the latest; partial aggregation takes repeats of a hot key out before the shuffle."""
    return df.groupBy(*key).agg(F.max(F.struct(*latest, *payload)).alias("_s")).select(*key, "_s.*")


def target_rank(ratio: Column, total: Column) -> Column:
    """ceil(ratio * total), 0 to total, in decimals: the ratio as it is written, to 15 places, at any total."""
    usable = F.when(ratio.isNotNull() & ~F.isnan(ratio), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))
    return F.ceil(usable.cast("decimal(17,15)") * total.cast("decimal(19,0)")).cast("bigint")


def share_cutoffs(values: DataFrame, targets: DataFrame, source: str, score: str, ratio: str) -> DataFrame:
    """(source, ratio, cutoff, kept, total) for each row of the small table ``targets``.

    The cutoff is the score at rank ceil(ratio * total) from the top, so that the
    values at or above it are at least the target share; ties at the cutoff are all
    kept and counted. Null and NaN scores do not count, minus zero is zero. A ratio
    of 0 or less, null or NaN, or a source without values, gives a null cutoff and
    keeps nothing; a ratio above 1 keeps all. Targets with a null source are left
    out; each ratio that a source has in the table gives a row.
    """
    clean = values.select(F.col(source), (F.col(score).cast("double") + F.lit(0.0)).alias(score))
    counted = clean.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(source, score).agg(F.count(F.lit(1)).alias("cnt"))
    ranged = ranged_sums(counted, [source], [F.col(score).desc()], "cnt", "scores")
    off = durable(offsets(ranged, "cnt"), "offsets")  # at most partitions + sources rows
    want = targets.select(source, F.col(ratio).cast("double").alias(ratio)).filter(F.col(source).isNotNull()).distinct()
    want = want.withColumn(GROUP, F.xxhash64(F.lit(1), F.lit(False), F.col(source)))
    totals = off.groupBy(GROUP).agg(F.sum("_sum").alias("total"))
    want = want.join(totals, GROUP, "left").fillna(0, ["total"]).withColumn("_rank", target_rank(F.col(ratio), F.col("total")))
    target = off.join(F.broadcast(want.select(GROUP, "_rank").distinct()), GROUP)
    target = target.filter("_offset < _rank AND _offset + _sum >= _rank").select(GROUP, PID, "_offset", "_rank")
    # one partition per target; both broadcasts have a row per row of the small targets table
    row = ranged.join(F.broadcast(target), [GROUP, PID]).withColumn("kept", F.col("_offset") + F.col(LOCAL))
    row = row.filter("kept >= _rank AND kept - cnt < _rank").select(GROUP, "_rank", F.col(score).alias("cutoff"), "kept")
    return want.join(row, [GROUP, "_rank"], "left").fillna(0, ["kept"]).select(source, ratio, "cutoff", "kept", "total")


def loss_cutoffs(windows: DataFrame, targets: DataFrame) -> DataFrame:
    """Cutoffs over all patch losses of each collection, every pair of target frames of a video once.

    A window scored twice counts with its latest scoring. A null array has no
    values, a short one those it has.
    """
    once = latest_windows(
        windows, ["video_path", "target_frames"], ["scored_at", "window_no"], ["collection", "patch_loss_16x16"]
    )
    values = once.select("collection", F.explode("patch_loss_16x16").alias("loss"))
    return share_cutoffs(values, targets, "collection", "loss", "keep_ratio")
