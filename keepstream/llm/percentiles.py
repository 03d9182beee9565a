"""Percentiles of very large numeric columns by radix selection.

A double becomes a 64-bit integer of the same order. A pass counts, per group,
the values of the next 16 bits, and keeps only the digit that holds each target
rank; four passes give the exact value, and after p passes the value is known to
a relative error of about 2^(12 - 16 p). A histogram of the leading bits is also
a summary of a day or a file: summaries add up, and bound each percentile by the
digit's edges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstream.session import durable

DIGIT, PASSES = 16, 4


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles, -0.0 as 0.0."""
    b = (values + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_bits(u: np.ndarray) -> np.ndarray:
    return (u ^ ((u >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _to_bits(v: pa.Array) -> pa.Array:
    x = v.to_numpy(zero_copy_only=False)
    x = np.where(np.isfinite(x), x, np.nan)
    return pa.array(ordered_bits(np.ascontiguousarray(x)), mask=np.isnan(x))


def _from_bits(u: pa.Array) -> pa.Array:
    x = u.to_numpy(zero_copy_only=False)
    gone = np.asarray(u.is_null())
    if gone.any():
        x = np.where(gone, 0, np.nan_to_num(x)).astype(np.int64)
    return pa.array(from_bits(np.ascontiguousarray(x.astype(np.int64, copy=False))), mask=gone)


def bits(col: Column) -> Column:
    """Order-preserving integer of a DOUBLE; null for null, NaN and infinities."""
    return F.arrow_udf(_to_bits, "bigint")(col.cast("double"))


def value(col: Column) -> Column:
    return F.arrow_udf(_from_bits, "double")(col)


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, metric, u): one row per usable value, as an ordered integer."""
    wide = df.select(*keys, *[bits(F.col(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("u")) for c in columns])
    return wide.select(*keys, F.inline(pairs)).filter("u IS NOT NULL")


def safe(cols: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality of several columns of two aliased sides."""
    out = F.lit(True)
    for c in cols:
        out &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def radix_percentiles(values: DataFrame, groups: Sequence[str], quantiles: Sequence[float], passes: int = PASSES) -> DataFrame:
    """Per group and quantile the value at rank max(1, ceil(q * n)): (groups, n, q, rank, low, high).

    ``values`` has the groups and ``u``. ``low`` and ``high`` are the smallest and the
    largest integer the value may have; after four passes they are equal. Each pass
    counts digits under the prefixes that are still followed, at most 2^16 per
    group and quantile, with partial aggregation before the shuffle.
    """
    v = durable(values, "values")
    n = v.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("bigint")
    state = n.select("*", qs).withColumn("rank", rank).withColumn("left", F.col("rank")).withColumn("prefix", F.lit(0).cast("bigint"))
    for p in range(passes):
        shift = 64 - DIGIT * (p + 1)
        above = F.shiftright("u", shift + DIGIT) if p else F.lit(0).cast("bigint")
        # the first digit keeps its sign, so that negative values come first
        digit = F.shiftright("u", shift) if not p else F.shiftright("u", shift).bitwiseAND(F.lit(0xFFFF))
        coded = v.select(*groups, above.alias("prefix"), digit.alias("digit"))
        if p:
            followed = state.select(*groups, "prefix").distinct()
            kept = v.withColumn("prefix", above).alias("v").join(followed.alias("f"), safe([*groups, "prefix"], "v", "f"), "left_semi")
            if p == 1:  # later passes read only values under the leading digits that are followed
                kept = durable(kept.select(*groups, "u", "prefix"), "followed")
                v = kept.drop("prefix")
            coded = kept.select(*groups, "prefix", digit.alias("digit"))
        hist = coded.groupBy(*groups, "prefix", "digit").count()
        by = Window.partitionBy(*groups, "prefix").orderBy("digit")  # at most 2^16 rows
        hist = hist.withColumn("upto", F.sum("count").over(by))
        hit = (
            state.alias("s")
            .join(hist.alias("h"), safe([*groups, "prefix"], "s", "h"))
            .filter("h.upto >= s.left AND h.upto - h.count < s.left")
        )
        step = (F.shiftleft(F.col("s.prefix"), DIGIT) + F.col("h.digit")) if p else F.col("h.digit")
        state = durable(
            hit.select(
                *[F.col(f"s.{g}") for g in groups],
                "s.n",
                "s.q",
                "s.rank",
                (F.col("s.left") - F.col("h.upto") + F.col("h.count")).alias("left"),
                step.alias("prefix"),
            ),
            "digits",
        )
    rest = 64 - DIGIT * passes
    low = F.shiftleft("prefix", rest) if rest else F.col("prefix")
    high = low + F.lit((1 << rest) - 1)
    return state.select(*groups, "n", "q", "rank", low.alias("low"), high.alias("high"))


def summaries(values: DataFrame, groups: Sequence[str], width: int = 24) -> DataFrame:
    """Mergeable summary: counts of the leading ``width`` bits, (groups, digit, count).

    With 12 bits of sign and exponent, a value is known to a relative error of
    2^(12 - width). Summaries of days, files or partitions are merged by ``merged``.
    """
    return values.groupBy(*groups, F.shiftright("u", 64 - width).alias("digit")).agg(F.count(F.lit(1)).alias("count"))


def merged(summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    return summary.groupBy(*groups, "digit").agg(F.sum("count").alias("count"))


def summary_percentiles(summary: DataFrame, groups: Sequence[str], quantiles: Sequence[float], width: int = 24) -> DataFrame:
    """(groups, n, q, low, high) from a merged summary; the exact value lies between low and high.

    The window runs over a group's digits, not its rows.
    """
    by = Window.partitionBy(*groups).orderBy("digit")
    acc = summary.withColumn("upto", F.sum("count").over(by)).withColumn("n", F.sum("count").over(Window.partitionBy(*groups)))
    qs = acc.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("bigint")
    hit = qs.withColumn("rank", rank).filter("upto >= rank AND upto - count < rank")
    low = F.shiftleft("digit", 64 - width)
    return hit.select(*groups, "n", "q", low.alias("low"), (low + F.lit((1 << (64 - width)) - 1)).alias("high"))
