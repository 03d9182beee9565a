"""Position ids of multimodal sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepstream.operators.grid import div
from keepstream.operators.ranged import running_sum
from keepstream.session import durable


def vision_positions(grids: DataFrame, t: str = "t", h: str = "h", w: str = "w", start: str = "start") -> DataFrame:
    """A row per token of a grid, time first, then height, then width, from the start on."""
    size = F.col(t) * F.col(h) * F.col(w)
    rows = grids.filter(size > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), size.cast("bigint") - 1)))
    i, area = F.col("i"), F.col(h) * F.col(w)
    return (
        rows.withColumn("pos_t", div(i, area) + F.col(start))
        .withColumn("pos_h", div(i % area, F.col(w)) + F.col(start))
        .withColumn("pos_w", (i % F.col(w)) + F.col(start))
    )


def compact_positions(tokens: DataFrame, width: int) -> DataFrame:
    """Positions of kept tokens: the tubelet as time, height and width from 0 again."""
    return tokens.withColumn("pos_t", F.col("tubelet")).withColumn("pos_h", div(F.col("idx"), width)).withColumn("pos_w", F.col("idx") % width)


def runs(seq: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Maximal runs of equal modality: keys, run, kind, first, length."""
    by = Window.partitionBy(*keys).orderBy("pos")
    new = (~F.col(kind).eqNullSafe(F.lag(kind).over(by)) | (F.row_number().over(by) == 1)).cast("int")
    numbered = seq.withColumn("run", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "run", kind).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("length"))


def rope_runs(run_rows: DataFrame, keys: list[str], advance: str = "advance") -> DataFrame:
    """Adds start: where each run's positions begin, the sum of the advances before it."""
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return run_rows.withColumn("start", F.coalesce(F.sum(advance).over(before), F.lit(0)))


def rope_index(seq: DataFrame, keys: list[str], grids: DataFrame, merge: int = 2) -> DataFrame:
    """Positions along t, h and w of each token, and the sequence's delta.

    Text advances by its length and counts alike on all axes; a vision run advances
    by max(h, w) // merge and counts its merged grid. ``grids`` has keys, run, h, w
    (before merging) of the vision runs.
    """
    r = runs(seq, keys).join(grids, [*keys, "run"], "left")
    vision = F.col("kind") == "video"
    r = r.withColumn("advance", F.when(vision, div(F.greatest("h", "w"), merge)).otherwise(F.col("length")))
    placed = rope_runs(r, keys)
    by = Window.partitionBy(*keys).orderBy("pos")
    new = (~F.col("kind").eqNullSafe(F.lag("kind").over(by)) | (F.row_number().over(by) == 1)).cast("int")
    tokens = seq.withColumn("run", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    j = F.col("pos") - F.col("first")
    width, area = div(F.col("w"), merge), div(F.col("h"), merge) * div(F.col("w"), merge)
    out = tokens.join(placed.drop("kind", "length"), [*keys, "run"])
    out = (
        out.withColumn("pos_t", F.col("start") + F.when(vision, div(j, area)).otherwise(j))
        .withColumn("pos_h", F.col("start") + F.when(vision, div(j % area, width)).otherwise(j))
        .withColumn("pos_w", F.col("start") + F.when(vision, j % width).otherwise(j))
    )
    whole = Window.partitionBy(*keys)
    delta = F.max(F.greatest("pos_t", "pos_h", "pos_w")).over(whole) + 1 - F.count(F.lit(1)).over(whole)
    return out.withColumn("delta", delta).select(*seq.columns, "pos_t", "pos_h", "pos_w", "delta")


def incremental(seq: DataFrame, keys: list[str], delta: str | None = None) -> DataFrame:
    """Positions from the running count of valid tokens, plus the delta; invalid tokens get 1."""
    count = F.sum(F.col("valid").cast("int")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    at = F.when(F.col("valid"), count - 1 + (F.col(delta) if delta else F.lit(0))).otherwise(1)
    return seq.withColumn("position", at)


def expand_beams(samples: DataFrame, beams: int) -> DataFrame:
    """Each sample ``beams`` times, beside each other: beam from 0."""
    return samples.withColumn("beam", F.explode(F.sequence(F.lit(0), F.lit(beams - 1))))


def videos_of_samples(videos: DataFrame, samples: DataFrame, batch: list[str]) -> DataFrame:
    """Which sample each video of a batch belongs to, from the samples' cumulative token counts.

    ``videos`` has batch, video_no and tokens in order, ``samples`` batch, sample_no
    and tokens. A video belongs to the sample whose tokens cover its last one; videos
    that end before the first token or after the last have none. Both sides are put in
    one order of token positions, in which the samples that end before a video are
    counted: their number is the place of its sample. No pairs are formed, and all
    sums run over ranges.
    """
    v = running_sum(videos, batch, [F.col("video_no")], "tokens", "_at", "videos").filter("_at > 0")
    s = running_sum(samples.withColumn("_one", F.lit(1)), batch, [F.col("sample_no")], ["tokens", "_one"], ["_at", "_place"], "samples")
    s = durable(s.select(*batch, "sample_no", "_at", (F.col("_place") - 1).alias("_place")), "places")
    ends = s.select(*batch, "_at", F.lit(1).alias("_ends"))
    both = v.withColumn("_ends", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    # at the same position a video comes before the end of a sample, which covers it
    placed = running_sum(both, batch, [F.col("_at"), F.col("_ends"), F.col("video_no")], "_ends", "_place", "order").filter("_ends = 0")
    return placed.join(s.select(*batch, "sample_no", "_place"), [*batch, "_place"]).drop("_at", "_ends", "_place")
