"""Global order without a single task: range partitions plus prefix sums.

A window over one hot group runs in one task. Here rows are range-partitioned
by (group, order), each partition sums by itself, and only one row per
partition and group travels to form the offsets: at most partitions + groups
rows, since a range holds neighbouring groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepstream.session import durable

PID, LOCAL, GROUP = "_pid", "_local", "_group"


def _sums(batches: Iterator[pa.RecordBatch], values: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Adds the running sums of ``values`` within the partition and group."""
    pid, last, carry = TaskContext.get().partitionId(), None, [0] * len(values)
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(GROUP).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        runs = np.diff(np.r_[starts, len(g)])
        sums = []
        for k, value in enumerate(values):
            total = np.cumsum(b.column(value).to_numpy(zero_copy_only=False).astype(np.int64))
            base = np.where(starts > 0, total[starts - 1], 0)
            if last is not None and g[0] == last:
                base[0] = -carry[k]
            local = total - np.repeat(base, runs)
            carry[k] = int(local[-1])
            sums.append(pa.array(local))
        last = g[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), pid, np.int32)), *sums], names=[*b.schema.names, PID, *names])


def ranged_sums(df: DataFrame, groups: Sequence[str], order: Sequence, value: str | Sequence[str], name: str = "ranged") -> DataFrame:
    """``df`` range-sorted by groups and order, with partition id and local sums, durable.

    ``value`` is a non-null integer column, or several; ``order`` should be total, or
    equal rows may come in any order among themselves.
    """
    values = [value] if isinstance(value, str) else list(value)
    names = [LOCAL, *[f"{LOCAL}_{k}" for k in range(1, len(values))]]
    keyed = df.withColumn(GROUP, F.xxhash64(F.lit(1), *[x for g in groups for x in (F.col(g).isNull(), F.col(g))]))
    by = [F.col(GROUP), *order]
    added = [T.StructField(PID, T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]]
    schema = T.StructType([*keyed.schema.fields, *added])
    return durable(keyed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(lambda it: _sums(it, values, names), schema), name)


def offsets(ranged: DataFrame, value: str | Sequence[str]) -> DataFrame:
    """Per group and partition the sum of all earlier partitions; a row each."""
    values = [value] if isinstance(value, str) else list(value)
    ends = ["", *[f"_{k}" for k in range(1, len(values))]]
    per = ranged.groupBy(GROUP, PID).agg(*[F.sum(v).alias(f"_sum{e}") for v, e in zip(values, ends)])
    before = Window.partitionBy(GROUP).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return per.select("*", *[F.coalesce(F.sum(f"_sum{e}").over(before), F.lit(0)).alias(f"_offset{e}") for e in ends])


def running_sum(
    df: DataFrame, groups: Sequence[str], order: Sequence, value: str | Sequence[str], out: str | Sequence[str], name: str = "running"
) -> DataFrame:
    """``df`` plus ``out``: the inclusive sum of ``value`` up to the row, in the group's order.

    Several values give several sums. Empty input gives an empty result. Nulls form a
    group of their own.
    """
    values, outs = ([x] if isinstance(x, str) else list(x) for x in (value, out))
    ends = ["", *[f"_{k}" for k in range(1, len(values))]]
    ranged = ranged_sums(df, groups, order, values, name)
    # at most partitions + groups rows, so the broadcast is bounded by the range partitioning
    off = F.broadcast(offsets(ranged, values).select(GROUP, PID, *[f"_offset{e}" for e in ends]))
    joined = ranged.join(off, [GROUP, PID])
    summed = [(F.col(f"{LOCAL}{e}") + F.col(f"_offset{e}")).alias(o) for e, o in zip(ends, outs)]
    return joined.select(*[F.col(c) for c in df.columns if c not in outs], *summed)


def group_rank(df: DataFrame, groups: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """``df`` plus ``out``: the row's number in its group's order, from 1.

    All rows are range-sorted, so no task gets a whole group because it is large.
    """
    return running_sum(df.withColumn("_one", F.lit(1)), groups, order, "_one", out, "rank").drop("_one")


def with_group(df: DataFrame, groups: Sequence[str], aggregates: Sequence) -> DataFrame:
    """``df`` plus aggregates of each row's group: partial sums and a join, not a window over the group."""
    agg = df.groupBy(*groups).agg(*aggregates)
    same = F.lit(True)
    for g in groups:
        same &= F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return df.alias("l").join(agg.alias("r"), same).select("l.*", *[F.col(f"r.{c}") for c in agg.columns[len(groups) :]])
