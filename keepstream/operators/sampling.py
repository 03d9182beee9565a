"""Frame plans: clips, time grids, budgets and sizes, as rows without pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Round half to even, as an integer."""
    return F.rint(x).cast("bigint")


def clip(df: DataFrame, start: Column, end: Column, duration: Column, fps: float, budget: int = 0) -> DataFrame:
    """Adds clip_start, clip_end and n_frames: the part of the stream asked for, and its sampled frames.

    At least one frame; a budget above 0 is an upper limit. A null start or end is
    the stream's own.
    """
    s = F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0)))
    e = F.least(duration, F.coalesce(end, duration))
    n = F.greatest(F.lit(1), ((F.col("clip_end") - F.col("clip_start")) * F.lit(fps)).cast("int"))
    out = df.withColumn("clip_start", s).withColumn("clip_end", e)
    return out.withColumn("n_frames", F.least(F.lit(budget), n) if budget > 0 else n)


def time_grid(df: DataFrame, mode: str, fps: float) -> DataFrame:
    """A row per sampled frame of a clipped stream: frame_idx and time_s."""
    i, n = F.col("frame_idx"), F.col("n_frames")
    times = {
        "full": F.col("clip_start") + i / F.lit(float(fps)),
        "recent": F.col("clip_end") - (n - i) / F.lit(float(fps)),
        "uniform": F.col("clip_start") + (i + F.lit(0.5)) * (F.col("clip_end") - F.col("clip_start")) / n,
    }
    if mode not in times:
        raise ValueError(f"unknown time grid {mode}")
    rows = df.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)))
    return rows.withColumn("time_s", times[mode])


def source_index(time: Column, source_fps: Column, total: Column) -> Column:
    """The stored frame nearest to a time, half to even, within the stream."""
    return F.least(total - 1, F.greatest(F.lit(0), half_even(time * source_fps)))


def budget_plan(df: DataFrame, total: str, mode: str, budget: int) -> DataFrame:
    """Frames kept of a 1-per-step stream of ``total`` frames: grid_idx, ordinal and truncated.

    tail and first cut a slice, uniform takes floor(i * total / n), each once; full
    or a budget of 0 keep all.
    """
    t = F.col(total)
    whole = mode == "full" or budget <= 0
    n = t if whole else F.least(F.lit(budget), t)
    i = F.explode(F.sequence(F.lit(0), n - 1))
    rows = df.filter(t > 0).withColumn("_n", n).withColumn("_i", i)
    if whole:
        at = F.col("_i")
    elif mode == "tail":
        at = t - F.col("_n") + F.col("_i")
    elif mode == "first":
        at = F.col("_i")
    elif mode == "uniform":
        at = F.least(t - 1, (F.col("_i") * (t / F.col("_n"))).cast("int"))
    else:
        raise ValueError(f"unknown budget mode {mode}")
    # n <= total makes the floors of a uniform plan distinct, so no further deduplication is needed
    return rows.withColumn("grid_idx", at).withColumn("ordinal", F.col("_i")).withColumn("truncated", F.col("_n") < t).drop("_n", "_i")


def plan_metrics(frames: DataFrame, keys: list[str], duration: str, fps: float) -> DataFrame:
    """Per plan: frames, tubelets (1 at least), first time, end time (exclusive) and coverage."""
    agg = frames.groupBy(*keys, duration).agg(
        F.count(F.lit(1)).alias("frames"), F.min("time_s").alias("start_s"), (F.max("time_s") + F.lit(1.0 / fps)).alias("end_s")
    )
    cover = F.when(F.col(duration) > 0, F.col("frames") / (F.col(duration) * F.lit(float(fps)))).otherwise(1.0)
    return agg.withColumn("tubelets", F.greatest(F.lit(1), F.expr("(frames + 1) div 2"))).withColumn("coverage", cover)


def window_starts(df: DataFrame, total: str, window: int = 16, stride: int = 2) -> DataFrame:
    """A row per start of a fixed window that fits."""
    return df.filter(F.col(total) >= window).withColumn("start", F.explode(F.sequence(F.lit(0), F.col(total) - window, F.lit(stride))))


def linspace(df: DataFrame, total: Column, count: Column) -> DataFrame:
    """A row per evenly spaced index of [0, total): rint(i * (total - 1) / (count - 1))."""
    rows = df.withColumn("_t", total).withColumn("_n", count).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = (F.col("_t") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)
    return rows.withColumn("index", half_even(F.col("i") * step)).drop("_t", "_n")


def even_count(duration: Column, total: Column, fps: float, least: int = 4, most: int = 256) -> Column:
    """Frames of an even-count sample: clamped, floored to even, 2 at least, never more than there are."""
    n = F.greatest(F.lit(least), F.least((duration * F.lit(fps)).cast("int"), F.lit(most)))
    return F.greatest(F.lit(2), F.least(n - n % 2, total))


def processor_count(total: Column, source_fps: Column, fps: float | None = None, frames: int | None = None, least: int = 4, most: int = 768) -> Column:
    """Frames of a processor's sample: a fixed number, or by rate, clamped to the limits and the stream."""
    if fps is not None and frames is not None:
        raise ValueError("give a number of frames or a rate, not both")
    if frames is not None:
        return F.lit(frames)
    if fps is None:
        return F.least(F.greatest(total, F.lit(least)), F.lit(most))
    n = (total / F.coalesce(source_fps, F.lit(1.0)) * F.lit(float(fps))).cast("int")
    return F.least(F.greatest(n, F.lit(least)), F.lit(most), total)


def clamped_window(df: DataFrame, start: Column, source_fps: Column, total: Column, frames: int, fps: float = 1.0) -> DataFrame:
    """A window of a fixed number of frames from a start time; a short stream repeats its last frame."""
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return rows.withColumn("index", source_index(start + F.col("i") / F.lit(float(fps)), source_fps, total))


MAX_RATIO = 200


def by_factor(x: Column, factor: int, how: str) -> Column:
    """The nearest (half to even), upper or lower multiple of a factor."""
    q = x / F.lit(factor)
    return {"round": F.rint(q), "ceil": F.ceil(q), "floor": F.floor(q)}[how].cast("bigint") * factor


def guarded(ok: Column, message: str, value: Column) -> Column:
    """``value``, or an error naming the broken rule."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("bigint"))


def aspect_resize(h: Column, w: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """Height and width that keep the aspect ratio, divide by the factor and fit the pixel budget."""
    area = h * w
    hb, wb = (F.greatest(F.lit(factor), by_factor(x, factor, "round")) for x in (h, w))
    down, up = F.sqrt(area / F.lit(most)), F.sqrt(F.lit(least) / area)
    ok = (h > 0) & (w > 0) & (F.greatest(h, w) / F.least(h, w) <= MAX_RATIO)

    def side(x: Column, bar: Column) -> Column:
        less = F.greatest(F.lit(factor), by_factor(x / down, factor, "floor"))
        fit = F.when(hb * wb > most, less).when(hb * wb < least, by_factor(x * up, factor, "ceil")).otherwise(bar)
        return guarded(ok, "invalid image size or aspect ratio", fit)

    return side(h, hb), side(w, wb)


def aligned_sizes(h: Column, w: Column, fine: int = 512, coarse: int = 256, factor: int = 32) -> tuple[Column, Column, Column, Column]:
    """Fine and coarse sizes of ratio 2:1 whose grids align: fine_h, fine_w, coarse_h, coarse_w."""
    if fine != 2 * coarse:
        raise ValueError("the fine size must be twice the coarse size")
    fh, fw = aspect_resize(h, w, factor, fine * fine, fine * fine)
    return fh, fw, (fh / 2).cast("bigint"), (fw / 2).cast("bigint")


def video_resize(frames: Column, h: Column, w: Column, temporal: int = 2, factor: int = 32, least: int = 128 * 128, most: int = 16 * 16 * 8 * 6144) -> tuple[Column, Column]:
    """The size of a video's frames under a budget of pixels over all frames."""
    volume = frames * h * w
    hb, wb = by_factor(h, factor, "round"), by_factor(w, factor, "round")
    padded = F.ceil(frames / F.lit(temporal)) * temporal * hb * wb
    down, up = F.sqrt(volume / F.lit(most)), F.sqrt(F.lit(least) / volume)
    ok = (h >= factor) & (w >= factor) & (F.greatest(h, w) / F.least(h, w) <= MAX_RATIO)

    def side(x: Column, bar: Column) -> Column:
        less = F.greatest(F.lit(factor), (F.floor(x / down / F.lit(factor)) * factor).cast("bigint"))
        more = (F.ceil(x * up / F.lit(factor)) * factor).cast("bigint")
        return guarded(ok, "size below the factor or invalid aspect ratio", F.when(padded > most, less).when(padded < least, more).otherwise(bar))

    return side(h, hb), side(w, wb)


def ablate(frames: DataFrame, mode: str, key: list[str], seed: int = 0) -> DataFrame:
    """Visual ablation of sampled frames: blank values, a seeded shuffle of their order, or none left (text_only)."""
    if mode == "blank":
        return frames.withColumn("value", F.lit(0.0))
    if mode == "text_only":
        return frames.limit(0)
    if mode == "shuffle":
        order = Window.partitionBy(*key).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("frame_idx").cast("string"))))
        return frames.withColumn("frame_idx", F.row_number().over(order) - 1)
    return frames


def anchored_start(total: Column, anchor: Column, window: int, policy: str) -> Column:
    """First frame of a window that ends at the anchor (anchor_end) or begins the stream (first)."""
    if policy == "first":
        return F.lit(0)
    return F.greatest(F.lit(0), F.least(anchor, total) - window)
