"""Token grids: orders, coordinates, counts, maps between grids and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Floor division of non-negative integers."""
    return F.floor(a / b).cast("bigint")


def flat_id(t: Column, h: Column, w: Column, height: Column | int, width: Column | int) -> Column:
    return (t * height + h) * width + w


def from_flat(i: Column, height: int, width: int) -> tuple[Column, Column, Column]:
    return div(i, height * width), div(i % (height * width), width), i % width


def tubelet_range(tubelet: Column, height: int, width: int) -> Column:
    """The flat ids of a tubelet's tokens."""
    n = height * width
    return F.sequence(tubelet * n, tubelet * n + (n - 1))


def block_order(k: Column, width: Column | int, merge: int) -> tuple[Column, Column]:
    """Row and column of the k-th patch of a frame in merge-block order."""
    m2 = merge * merge
    block, inner = div(k, m2), k % m2
    per = div(F.lit(width) if isinstance(width, int) else width, merge)
    return div(block, per) * merge + div(inner, merge), (block % per) * merge + inner % merge


def patches(df: DataFrame, frames: str, height: str, width: str, merge: int = 2) -> DataFrame:
    """A row per patch of a video in token order: t, k, row, col, first_frame, last_frame.

    An odd number of frames is padded by repeating the last.
    """
    n = F.col(frames)
    steps = df.withColumn("t", F.explode(F.sequence(F.lit(0), div(n + 1, 2) - 1)))
    rows = steps.withColumn("k", F.explode(F.sequence(F.lit(0), F.col(height) * F.col(width) - 1)))
    r, c = block_order(F.col("k"), F.col(width), merge)
    first = F.col("t") * 2
    return rows.withColumn("row", r).withColumn("col", c).withColumn("first_frame", first).withColumn("last_frame", F.least(first + 1, n - 1))


def tubelet_times(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The mean time of each tubelet's frames; a single last frame is its own mean."""
    by = frames.groupBy(*keys, div(F.col("frame_idx"), 2).alias("tubelet"))
    return by.agg(F.min("time_s").alias("_a"), F.max("time_s").alias("_b"), F.count(F.lit(1)).alias("frames")).select(
        *keys, "tubelet", "frames", ((F.col("_a") + F.col("_b")) / 2).alias("timestamp_s")
    )


def placeholder(tubelets: DataFrame, keys: list[str], kept: str = "kept") -> DataFrame:
    """The text a video's placeholder expands to: per tubelet its time, a start, a pad per kept token, an end."""
    tenths = F.rint(F.col("timestamp_s") * 10).cast("bigint")
    stamp = F.concat(F.lit("<"), div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" seconds>"))
    part = F.concat(stamp, F.lit("<|vision_start|>"), F.repeat(F.lit("<|video_pad|>"), F.col(kept).cast("int")), F.lit("<|vision_end|>"))
    parts = tubelets.select(*keys, "tubelet", part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("tubelet", "part")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("text"))


def token_count(grids: Column, merge: int = 1) -> Column:
    """Tokens of all of a sample's videos: the sum of t * (h div m) * (w div m); null grids count nothing."""
    one = F.transform(grids, lambda g: g[0] * div(g[1], merge) * div(g[2], merge))
    return F.aggregate(F.coalesce(one, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def count_mismatch(df: DataFrame, expected: str, actual: Column, strict: bool = False) -> DataFrame:
    """Rows whose placeholder count differs from the tokens there are; ``strict`` raises on the first."""
    bad = df.withColumn("actual", actual).filter(~F.col(expected).eqNullSafe(F.col("actual")))
    return bad.withColumn("_", F.raise_error(F.lit("token counts differ"))) if strict else bad


def grids_align(coarse: tuple[Column, Column], fine: tuple[Column, Column], merge: int = 2) -> Column:
    """Whether a coarse grid equals a fine grid after merging."""
    return (coarse[0] == div(fine[0], merge)) & (coarse[1] == div(fine[1], merge))


def split_steps(df: DataFrame, grid: str) -> DataFrame:
    """A row of one time step (1, h, w) for each step of each grid."""
    g = df.select("*", F.posexplode(grid).alias("video_no", "_g"))
    return g.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_g")[0] - 1))).withColumn("grid", F.array(F.lit(1), F.col("_g")[1], F.col("_g")[2])).drop("_g")


def map_index(i: Column, source: tuple[int, int, int], target: tuple[Column | int, Column | int, Column | int]) -> Column:
    """The target token of a source token: floor scaling along each axis, clamped."""
    t, h, w = div(i, source[1] * source[2]), div(i % (source[1] * source[2]), source[2]), i % source[2]
    lit = [F.lit(x) if isinstance(x, int) else x for x in target]
    a, b, c = (F.least(div(x * n, s), n - 1) for x, n, s in zip((t, h, w), lit, source))
    return a * (lit[1] * lit[2]) + b * lit[2] + c


def pool(scores: DataFrame, keys: list[str], factors: tuple[int, int, int]) -> DataFrame:
    """Mean (sum and count) and maximum of integer scores over blocks of a divisible grid."""
    t, h, w = (div(F.col(c), f).alias(c) for c, f in zip(("t", "h", "w"), factors))
    agg = scores.groupBy(*keys, t, h, w).agg(F.sum("score").alias("total"), F.count("score").alias("cells"), F.max("score").alias("top"))
    return agg.withColumn("mean", F.col("total") / F.col("cells"))


def axis_weights(n_in: int, n_out: int) -> list[tuple[int, int, float]]:
    """(out, in, weight) of linear resampling along an axis with aligned centres."""
    out = []
    for o in range(n_out):
        x = min(max((o + 0.5) * n_in / n_out - 0.5, 0.0), n_in - 1.0)
        lo = int(x)
        hi, f = min(lo + 1, n_in - 1), x - lo
        out += [(o, lo, 1.0 - f)] + ([(o, hi, f)] if f > 0 else [])
    return out


def trilinear(scores: DataFrame, keys: list[str], source: tuple[int | str, int, int], target: tuple[int | Column, int, int]) -> DataFrame:
    """Scores resampled to a grid that doesn't divide: eight weighted neighbours, by tiny tables of the fixed axes.

    The streams may differ along t: ``source[0]`` then names the column of a stream's
    length and ``target[0]`` is the Column of its length afterwards. A cell without a
    score counts as 0; cells none of whose neighbours has one are left out.
    """
    spark, out = scores.sparkSession, scores
    for axis, n, m in zip(("t", "h", "w"), source, target):
        if isinstance(n, str):
            out = _along(out, axis, F.col(n), m)
            continue
        # bounded: at most two rows per cell of one axis
        table = F.broadcast(spark.createDataFrame(axis_weights(n, m), f"o_{axis} int, {axis} int, k_{axis} double"))
        out = out.join(table, axis)
    weight = F.col("k_t") * F.col("k_h") * F.col("k_w")
    return out.groupBy(*keys, F.col("o_t").alias("t"), F.col("o_h").alias("h"), F.col("o_w").alias("w")).agg(F.sum(F.col("score") * weight).alias("score"))


def _along(df: DataFrame, axis: str, n: Column, m: Column) -> DataFrame:
    """``axis_weights`` of lengths held by the rows: o and k of all cells that a row's cell reaches."""
    def place(i: Column) -> Column:
        return (i + 0.5) * m / n - 0.5

    at = F.col(axis)
    first, last = F.greatest(F.lit(0), F.floor(place(at - 1)).cast("int")), F.least(m.cast("int") - 1, F.ceil(place(at + 1)).cast("int"))
    out = df.withColumn(f"o_{axis}", F.explode(F.sequence(first, last)))
    x = F.least(F.greatest((F.col(f"o_{axis}") + 0.5) * n / m - 0.5, F.lit(0.0)), n - 1.0)
    return out.withColumn(f"k_{axis}", 1.0 - F.abs(x - at)).filter(F.col(f"k_{axis}") > 0)


def position_neighbours(df: DataFrame, height: str, width: str, side: int) -> DataFrame:
    """Bilinear lookup of a side x side position table: four neighbours and weights per patch."""
    rows = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.col(height) - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col(width) - 1)))
    y = F.col("r") * (F.lit(float(side - 1)) / F.greatest(F.lit(1), F.col(height) - 1))
    x = F.col("c") * (F.lit(float(side - 1)) / F.greatest(F.lit(1), F.col(width) - 1))
    y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    y1, x1 = F.least(y0 + 1, F.lit(side - 1)), F.least(x0 + 1, F.lit(side - 1))
    fy, fx = y - y0, x - x0
    near = [(y0, x0, (1 - fy) * (1 - fx)), (y0, x1, (1 - fy) * fx), (y1, x0, fy * (1 - fx)), (y1, x1, fy * fx)]
    cells = F.array(*[F.struct(F.lit(k).alias("n"), (a * side + b).alias("cell"), v.alias("weight")) for k, (a, b, v) in enumerate(near)])
    return rows.select("*", F.inline(cells))


def normalise(values: Column, mean: float, std: float) -> Column:
    """(x / 255 - mean) / std of an array of pixel values."""
    return F.transform(values, lambda v: (v / F.lit(255.0) - F.lit(mean)) / F.lit(std))
