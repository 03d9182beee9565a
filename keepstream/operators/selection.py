"""Tiers, adaptive thresholds and token selection.

Patch rows have the stream's keys, tubelet, idx (the patch's place in its
tubelet) and loss, an integer of micro-units, so that a threshold compares alike
in every engine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepstream.config import SelectionConfig
from keepstream.operators.grid import div
from keepstream.operators.history import rounded_column, thresholds
from keepstream.operators.ranged import group_rank, with_group

DEFAULT = SelectionConfig()
#: Tubelets of a stream that one task works on.
CHUNK = 4096


def tiers(tubelet: Column, n: Column, cfg: SelectionConfig = DEFAULT, policy: str = "plugin") -> Column:
    """The tier of a tubelet: bootstrap, tail, recent or old.

    plugin: the tail has floor(frames / stride) tubelets and wins over the first
    tubelet. compact: the tail is rounded up, and the first tubelet comes first, if
    it is to be dropped at all.
    """
    recent = cfg.recent_frames // cfg.stride_frames
    if policy == "plugin":
        tail = cfg.tail_keep_frames // cfg.stride_frames
        return (
            F.when(tubelet >= n - tail, "tail").when(tubelet == 0, "bootstrap").when(tubelet >= n - recent, "recent").otherwise("old")
        )
    if policy != "compact":
        raise ValueError(f"unknown tier policy {policy}")
    tail = -(-cfg.tail_keep_frames // cfg.stride_frames)
    first = F.when((tubelet == 0) & F.lit(cfg.drop_bootstrap), "bootstrap")
    return first.when(tubelet >= n - tail, "tail").when(tubelet >= n - recent, "recent").otherwise("old")


def tier_ratio(tier: Column, cfg: SelectionConfig = DEFAULT) -> Column:
    return F.when(tier == "recent", cfg.recent_keep_ratio).otherwise(cfg.keep_ratio)


def adaptive_threshold(patches: DataFrame, keys: list[str], n: str, cfg: SelectionConfig = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """Adds threshold, mode and keep to scored patch rows with a ``tier`` of recent or old.

    The threshold is the (1 - ratio) percentile, linearly interpolated, of all scored
    losses of strictly earlier tubelets, once there are more than ``warmup_min`` of
    them; before, that of the tubelet's own. Losses equal to it are kept. The history
    counts losses as ``operators.history`` states.

    A stream is worked on in parts of ``chunk`` tubelets, each in one task in one pass
    over its tubelets; ``n`` holds its number of tubelets. What a part needs of those
    before it are their counts, a row per distinct loss, so a task's share depends on
    neither the stream's length nor its part of the table.
    """
    part = div(F.col("tubelet"), chunk)
    rows = patches.withColumn("_part", part).withColumn("_count", F.lit(None).cast("bigint"))
    long = patches.filter(F.col(n) > chunk)  # none, while all streams fit one part
    counted = long.groupBy(*keys, part.alias("_part"), rounded_column(F.col("loss")).alias("loss")).agg(F.count(F.lit(1)).alias("_c"), F.max(n).alias("_n"))
    by = Window.partitionBy(*keys, "loss").orderBy("_part")  # a row per part
    upto = counted.withColumn("_count", F.sum("_c").over(by)).withColumn("_next", F.coalesce(F.lead("_part").over(by), div(F.col("_n") - 1, chunk)))
    before = upto.filter(F.col("_next") > F.col("_part")).withColumn("_part", F.explode(F.sequence(F.col("_part") + 1, F.col("_next"))))
    types = {f.name: f.dataType for f in rows.schema}
    given = {*keys, "loss", "_part", "_count"}
    before = before.select(*[(F.col(c) if c in given else F.lit(None)).cast(types[c]).alias(c) for c in rows.columns])
    old, recent = (round(1.0 - r, 10) for r in (cfg.keep_ratio, cfg.recent_keep_ratio))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        prior = table.filter(pc.is_valid(table["_count"]))
        own = table.filter(pc.is_null(table["_count"]))
        own = own.take(pc.sort_indices(own, [("tubelet", "ascending")])).drop_columns(["_part", "_count"])
        tubelet, loss = (own[c].to_numpy() for c in ("tubelet", "loss"))
        starts = np.flatnonzero(np.r_[True, tubelet[1:] != tubelet[:-1]]) if len(tubelet) else np.zeros(0, np.int64)
        is_recent = pc.equal(own["tier"], "recent").to_numpy()
        order = np.argsort(prior["loss"].to_numpy(), kind="stable")
        values, counts = prior["loss"].to_numpy()[order], prior["_count"].to_numpy()[order]
        level, warm = thresholds(starts, loss, np.where(is_recent[starts], recent, old), values, counts, cfg.warmup_min)
        length = np.diff(np.r_[starts, len(loss)])
        level, warm = np.repeat(level, length), np.repeat(warm, length)
        names = np.array(["scored_local_quantile_old", "scored_local_quantile_recent", "scored_digest_old", "scored_digest_recent"], object)
        mode = names[2 * warm.astype(int) + is_recent]
        return own.append_column("threshold", pa.array(level)).append_column("mode", pa.array(mode, pa.string())).append_column("keep", pa.array(loss >= level))

    added = [T.StructField("threshold", T.DoubleType()), T.StructField("mode", T.StringType()), T.StructField("keep", T.BooleanType())]
    schema = T.StructType([*patches.schema.fields, *added])
    return rows.unionByName(before).groupBy(*keys, "_part").applyInArrow(run, schema)


def adaptive_prune(patches: DataFrame, keys: list[str], n: str, cfg: SelectionConfig = DEFAULT, policy: str = "plugin") -> DataFrame:
    """Patch rows with tier, mode, threshold and keep.

    ``n`` holds the stream's number of tubelets. Only scored tubelets enter the
    history: the tail is kept whole, the first tubelet dropped, and rows without a
    loss stay kept as unscored. The tier filter comes before the shuffle, so protected
    tubelets never travel.
    """
    tiered = patches.withColumn("tier", tiers(F.col("tubelet"), F.col(n), cfg, policy))
    scored = tiered.filter(F.col("tier").isin("recent", "old") & F.col("loss").isNotNull())
    rest = tiered.filter(~(F.col("tier").isin("recent", "old") & F.col("loss").isNotNull()))
    mode = (
        F.when(F.col("tier") == "bootstrap", "bootstrap_drop").when(F.col("tier") == "tail", "protected_tail_full_keep").otherwise("unscored_full_keep")
    )
    fixed = rest.withColumn("threshold", F.lit(None).cast("double")).withColumn("mode", mode).withColumn("keep", F.col("tier") != "bootstrap")
    return adaptive_threshold(scored, keys, n, cfg).unionByName(fixed)


def keep_stats(pruned: DataFrame, keys: list[str]) -> DataFrame:
    """Per stream: tokens before, kept and dropped, the ratio kept, tubelets scored (in part at least) and not, and the tubelets of each tier.

    The lists hold a stream's own tubelets, which its video bounds; they are made of
    one row per tubelet, not of its patches.
    """
    scored = F.col("mode").startswith("scored")
    each = pruned.groupBy(*keys, "tubelet", "tier").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("keep").alias("_k"), F.max(scored).alias("_s")
    )

    def listed(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("tubelet"))))

    kept, total = F.sum("_k"), F.sum("_n")
    tubelets, known = F.count_distinct("tubelet"), F.count_distinct(F.when(F.col("_s"), F.col("tubelet")))
    return each.groupBy(*keys).agg(
        total.alias("original_tokens"),
        kept.alias("kept_tokens"),
        (total - kept).alias("dropped_tokens"),
        (kept / total).alias("keep_ratio_actual"),
        known.alias("tubelets_scored"),
        (tubelets - known).alias("tubelets_unscored"),
        listed(F.col("_s")).alias("scored"),
        listed(F.col("tier") == "bootstrap").alias("dropped_bootstrap"),
        listed(F.col("tier") == "tail").alias("full_keep_tail"),
        listed(F.col("tier") == "recent").alias("recent"),
    )


def keep_masks(pruned: DataFrame, keys: list[str]) -> DataFrame:
    """Per tubelet: tier, mode and the mask of all its patches, in order; the mode is that of its scored patches, if any."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "keep")))
    mode = F.coalesce(F.max(F.when(F.col("mode").startswith("scored"), F.col("mode"))), F.max("mode"))
    return pruned.groupBy(*keys, "tubelet", "tier").agg(mode.alias("mode"), F.transform(cells, lambda c: c["keep"]).alias("mask"))


def budget(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1), (n * F.lit(ratio)).cast("int"))


def counted() -> Column:
    return F.count(F.lit(1)).alias("_n")


def top_share(patches: DataFrame, keys: list[str], ratio: float, flat: str = "flat") -> DataFrame:
    """The max(1, floor(n * ratio)) tokens of highest loss per stream; ties go to the lower id."""
    ranked = group_rank(with_group(patches, keys, [counted()]), keys, [F.col("loss").desc(), F.col(flat)], "_rank")
    return ranked.filter(F.col("_rank") <= budget(F.col("_n"), ratio)).drop("_n", "_rank")


def above_mean(patches: DataFrame, keys: list[str], ratio: float, flat: str = "flat") -> DataFrame:
    """Tokens of positive z-score, the highest ones if there are more than the budget.

    z > 0 is loss > mean whatever the deviation, so integers decide: loss * n > sum.
    """
    high = with_group(patches, keys, [counted(), F.sum("loss").alias("_s")]).filter(F.col("loss") * F.col("_n") > F.col("_s"))
    ranked = group_rank(high, keys, [F.col("loss").desc(), F.col(flat)], "_rank")
    return ranked.filter(F.col("_rank") <= budget(F.col("_n"), ratio)).drop("_n", "_s", "_rank")


def above_quantile(patches: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Tokens at or above the (1 - ratio) percentile of their whole map."""
    q = patches.groupBy(*keys).agg(F.percentile("loss", F.lit(round(1.0 - ratio, 10))).alias("threshold"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}"))
    return patches.alias("p").join(q.alias("q"), same).filter("p.loss >= q.threshold").select("p.*", "q.threshold")


def cell_of(x: Column, size: int, cells: int) -> Column:
    """The cell whose bounds [c * size // cells, (c + 1) * size // cells) hold x."""
    g = min(cells, size)
    return div((x + 1) * g - 1, size)


def cell_coverage(
    patches: DataFrame, keys: list[str], side: int, ratio: float, cells: int = 4, trim: bool = False, flat: str = "flat"
) -> DataFrame:
    """Top tokens with the best of each cell of each tubelet kept first.

    Without ``trim`` coverage may exceed the budget; with it the covered tokens are
    cut to the budget by loss.
    """
    # a cell of a tubelet has (side / cells)^2 tokens, so this window is small whatever the stream
    by_cell = Window.partitionBy(*keys, "tubelet", "_ci", "_cj").orderBy(F.col("loss").desc(), F.col(flat))
    rows = with_group(patches, keys, [counted()])
    rows = rows.withColumn("_ci", cell_of(div(F.col("idx"), side), side, cells)).withColumn("_cj", cell_of(F.col("idx") % side, side, cells))
    rows = rows.withColumn("covered", F.row_number().over(by_cell) == 1)
    ranked = group_rank(rows, keys, [F.col("covered").desc(), F.col("loss").desc(), F.col(flat)], "_rank")
    fits = F.col("_rank") <= budget(F.col("_n"), ratio)
    return ranked.filter(fits if trim else fits | F.col("covered")).drop("_ci", "_cj", "_n", "_rank")


def hashed_share(patches: DataFrame, keys: list[str], ratio: float, seed: int = 0, flat: str = "flat") -> DataFrame:
    """A random budget of tokens, ordered by a seeded hash of stream and id: the same on every run and cluster."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(flat).cast("string")))
    ranked = group_rank(with_group(patches, keys, [counted()]), keys, [h, F.col(flat)], "_rank")
    return ranked.filter(F.col("_rank") <= budget(F.col("_n"), ratio)).drop("_n", "_rank")


def even_share(streams: DataFrame, total: str, ratio: float) -> DataFrame:
    """Evenly spaced ids of a stream of ``total`` tokens: min(total - 1, rint(i * total / n)), each once."""
    n = budget(F.col(total), ratio)
    rows = streams.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.least(F.col(total) - 1, F.rint(F.col("_i") * F.col(total) / F.col("_n")).cast("bigint"))
    return rows.withColumn("flat", at).drop("_n", "_i").distinct()


METHODS = ("baseline", "random", "uniform", "scored")


def select_by(method: str, patches: DataFrame, keys: list[str], ratio: float, seed: int = 0) -> DataFrame:
    """Selection by name: all tokens, a random, an evenly spaced or the highest-scored share."""
    if method == "baseline":
        return patches
    if method == "random":
        return hashed_share(patches, keys, ratio, seed)
    if method == "uniform":
        counts = patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
        return group_rank(patches, keys, [F.col("flat")], "_o").withColumn("_o", F.col("_o") - 1).join(
            even_share(counts, "_total", ratio).withColumnRenamed("flat", "_o").drop("_total"), [*keys, "_o"], "left_semi"
        ).drop("_o")
    if method == "scored":
        return top_share(patches, keys, ratio)
    raise ValueError(f"unknown method {method}")
