"""Joins, set operations and partitioning of runs and tasks."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstream.operators.ranged import running_sum
from keepstream.session import shared_dir


def last_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key, by aggregation rather than a sort of the group."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def compare_runs(base: DataFrame, other: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Two runs side by side on their common keys; of repeated keys the last row counts."""
    a = last_per_key(base, keys, order, columns).select(*keys, *[F.col(c).alias(f"base_{c}") for c in columns])
    b = last_per_key(other, keys, order, columns)
    return a.join(b, keys)


def numeric_order(key: Column) -> Column:
    """Sort key of an id: its number, 0 where it is none."""
    return F.when(key.rlike("^[0-9]+$"), key.try_cast("bigint")).otherwise(F.lit(0))


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    """a / b, or a fixed value where b is null or 0."""
    return F.when(b.isNull() | (b == 0) | a.isNull(), F.lit(float(otherwise))).otherwise(a / b)


def with_files(samples: DataFrame, files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples whose file exists, and those without."""
    listed = files.select(path).distinct()
    return samples.join(listed, path, "left_semi"), samples.join(listed, path, "left_anti")


def clip_join(frames: DataFrame, questions: DataFrame, key: str, time: str, at: str, reach: float) -> DataFrame:
    """Frames of the same stream within [max(0, t - reach), t] of each question.

    The range is cut into buckets of the reach, so the join is an equi-join on
    (stream, bucket) with at most two buckets per question.
    """
    low = F.greatest(F.lit(0.0), F.col(at) - F.lit(reach))
    q = questions.withColumn("_low", low)
    b = F.explode(F.sequence(F.floor(F.col("_low") / F.lit(reach)), F.floor(F.col(at) / F.lit(reach)))).alias("_bucket")
    q = q.select("*", b)
    f = frames.withColumn("_bucket", F.floor(F.col(time) / F.lit(reach)))
    joined = q.join(f, [key, "_bucket"])
    return joined.filter((F.col(time) >= F.col("_low")) & (F.col(time) <= F.col(at))).drop("_bucket", "_low")


def range_split(df: DataFrame, order: list[Column], shards: int, size: int) -> DataFrame:
    """Contiguous shards of floor(size / shards) rows, the remainder in the last.

    One shard or fewer is all rows; fewer rows than shards all go to the last.
    """
    if shards <= 1:
        return df.withColumn("shard", F.lit(0).cast("bigint"))
    numbered = running_sum(df.withColumn("_one", F.lit(1)), [], order, "_one", "_row", "split").drop("_one")
    chunk = size // shards
    at = F.lit(shards - 1) if not chunk else F.least(F.floor((F.col("_row") - 1) / F.lit(chunk)), F.lit(shards - 1))
    return numbered.withColumn("shard", at.cast("bigint")).drop("_row")


def greedy_order(counts: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Where a greedy longest-first assignment puts the items of each weight, heaviest first: a start, then a cycle.

    ``counts`` are (weight, number of items), descending. Items of one weight go to the
    least-loaded shard, the first among equals. Once the loads lie less than the weight
    apart, the shards take turns in the order of their loads; before, at most shards *
    (previous weight / weight) items even them out, as the loads never lie more than
    the previous weight apart.
    """
    loads = [0] * shards
    for w, n in counts:
        start: list[int] = []
        if w <= 0:  # such items change no load
            yield w, [], [loads.index(min(loads))] * shards
            continue
        while len(start) < n and max(loads) - min(loads) >= w:
            at = loads.index(min(loads))
            loads[at] += w
            start.append(at)
        cycle = sorted(range(shards), key=lambda i: (loads[i], i))
        rounds, rest = divmod(n - len(start), shards)
        for k, i in enumerate(cycle):
            loads[i] += w * (rounds + (k < rest))
        yield w, start, cycle


def lpt_shards(items: DataFrame, weight: str, order: list[str], shards: int, batch: int = 20_000) -> DataFrame:
    """Greedy longest-first assignment (ties by ``order``): ``items`` plus shard.

    Sequential as it is, it depends only on the number of items of each integer
    weight; an item's place among those of its weight then gives its shard. The
    driver passes over the distinct weights, ``batch`` of them at a time, and writes
    what becomes of each; items find theirs by a join, so nothing that grows with the
    weights is held or broadcast. A null weight counts as 0.
    """
    spark, shards = items.sparkSession, max(1, shards)
    w = F.coalesce(F.col(weight).cast("bigint"), F.lit(0))
    placed = running_sum(items.withColumn("_w", w).withColumn("_one", F.lit(1)), ["_w"], [F.col(c) for c in order], "_one", "_place", "lpt").drop("_one")
    counts = placed.groupBy("_w").count().orderBy(F.col("_w").desc())
    plan = greedy_order(((r["_w"], r["count"]) for r in counts.toLocalIterator()), shards)
    schema, path = "_w bigint, _start array<int>, _cycle array<int>", f"{shared_dir(spark)}/keepstream-plan-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    while rows := list(itertools.islice(plan, batch)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    j = F.col("_place") - 1
    head = F.size("_start")
    at = F.when(j < head, F.get("_start", j.cast("int"))).otherwise(F.get("_cycle", ((j - head) % shards).cast("int")))
    return placed.join(spark.read.schema(schema).parquet(path), "_w").withColumn("shard", at).drop("_w", "_place", "_start", "_cycle")


def cache_split(requests: DataFrame, cache: DataFrame, keys: list[str], at: str, size: str) -> tuple[DataFrame, DataFrame]:
    """Requests the score cache answers, with its values, and those it lacks.

    ``requests`` has one row per ``keys``, which asks for the entries 0 to ``size`` - 1 of
    column ``at``. There is no row per entry, so neither joins nor broadcasts grow with
    ``size``: entries the cache lacks come as runs, keys and ``first`` and ``end`` (exclusive).
    """
    hit = requests.join(cache, keys).filter(F.col(at).between(0, F.col(size) - 1))
    marks = hit.select(*keys, F.col(at).alias("end")).unionByName(requests.select(*keys, F.col(size).alias("end")))
    first = F.lag("end", 1, -1).over(Window.partitionBy(*keys).orderBy("end")) + 1
    return hit.drop(size), marks.select(*keys, first.alias("first"), "end").filter("first < end")


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that only one of two sets has: keys and side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def sample_ordinals(df: DataFrame, order: list[Column], keys: list[str], count: int) -> DataFrame:
    """Evenly spaced rows of each group, as linspace truncated to whole ordinals."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_o", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = (F.col("_n") - 1) / F.lit(float(max(1, count - 1)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (i * step).cast("bigint"))
    return rows.filter((F.col("_n") <= count) | F.array_contains(picks, F.col("_o").cast("bigint"))).drop("_o", "_n")
