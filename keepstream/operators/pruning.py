"""Token sequences: keep masks, pruning, padding and placeholder filling.

A sequence is rows of (keys, pos, kind, valid, ...); kind is ``video`` for
placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def video_ordinals(seq: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ordinal: the number of each valid video token among those of its sequence, from 0; else null."""
    is_video = (F.col("kind") == "video") & F.col("valid")
    running = F.sum(is_video.cast("int")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return seq.withColumn("ordinal", F.when(is_video, running - 1))


def keep_sequence(seq: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The valid text tokens, and the valid video tokens whose ordinal is in ``kept`` (keys, ordinal).

    Repeated keep ids count once. See ``check_keep`` for ids out of range.
    """
    marked = kept.select(*keys, "ordinal").distinct().withColumn("_keep", F.lit(True))
    numbered = video_ordinals(seq, keys).filter("valid")
    joined = numbered.join(marked, [*keys, "ordinal"], "left")
    return joined.filter((F.col("kind") != "video") | F.col("_keep")).select(*seq.columns)


def check_keep(seq: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Keep ids that no video token of their sequence has."""
    numbered = video_ordinals(seq, keys).filter(F.col("ordinal").isNotNull())
    return kept.select(*keys, "ordinal").distinct().join(numbered, [*keys, "ordinal"], "left_anti")


def renumber(seq: DataFrame, keys: list[str], out: str = "new_pos") -> DataFrame:
    return seq.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)


def pad_right(seq: DataFrame, batch: list[str], keys: list[str], values: dict[str, object]) -> DataFrame:
    """Sequences numbered anew and filled up to the longest of their batch with the pad ``values``.

    Padding multiplies rows, so it belongs at the edge of a pipeline. Result: batch,
    keys, new_pos, the value columns, and padded.
    """
    numbered = renumber(seq, [*batch, *keys]).select(*batch, *keys, "new_pos", *values)
    sizes = numbered.groupBy(*batch, *keys).agg((F.max("new_pos") + 1).alias("_len"))
    longest = sizes.withColumn("_max", F.max("_len").over(Window.partitionBy(*batch)))
    gaps = longest.filter("_len < _max").select(*batch, *keys, F.explode(F.expr("sequence(_len, _max - 1)")).alias("new_pos"))
    kinds = dict(numbered.dtypes)
    filled = gaps.select(*batch, *keys, "new_pos", *[F.lit(v).cast(kinds[c]).alias(c) for c, v in values.items()], F.lit(True).alias("padded"))
    return numbered.withColumn("padded", F.lit(False)).unionByName(filled)


def batch_offsets(counts: DataFrame, batch: list[str], order: str, n: str) -> DataFrame:
    """Adds offset: the visual tokens of all earlier samples of the batch."""
    before = Window.partitionBy(*batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0)))


def flat_visual(kept: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """The index of each kept token in the batch's flat list of visual tokens."""
    return kept.join(offsets.select(*keys, "offset"), keys).withColumn("flat_index", F.col("offset") + F.col("ordinal")).drop("offset")


def for_all(kept: DataFrame, samples: DataFrame) -> DataFrame:
    """One keep list for every sample of a batch: each sample takes the list as an array and explodes it.

    The list is a single row, a parameter of the operator.
    """
    listed = kept.select(F.array_sort(F.collect_set("ordinal")).alias("_all")).withColumn("_one", F.lit(1))
    one = samples.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").drop("_one")
    return one.withColumn("ordinal", F.explode("_all")).drop("_all")


def mask_to_frames(frames: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Each frame with its tubelet's mask; both frames of a tubelet share it."""
    return frames.withColumn("tubelet", F.floor(F.col("frame_idx") / 2).cast("bigint")).join(masks, [*keys, "tubelet"])


def append_compact(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The compact memory after an append: rows of both, numbered by tubelet and patch within the stream."""
    both = old.unionByName(new)
    return both.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy("tubelet", "idx")) - 1)


def non_empty(df: DataFrame, message: str = "nothing to generate from") -> DataFrame:
    """``df`` itself, or an error if it has no rows: assembling gives an empty result, generating must not."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def scatter(seq: DataFrame, embeds: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """The k-th placeholder of a sequence takes the k-th embedding's value; others keep null."""
    numbered = embeds.select(*keys, value, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).alias("ordinal"))
    return video_ordinals(seq, keys).join(numbered, [*keys, "ordinal"], "left")


def decode_step(step: str = "step") -> Column:
    """Whether a step sees visual inputs: only the first of a generation does."""
    return F.col(step) == 0
