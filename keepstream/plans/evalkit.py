"""Roll-ups of runs: accuracies, means, summaries.

Means of doubles are formed from integers of micro-units, so that they do not
depend on the order in which partitions are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstream.functions.prompts import BACKWARD, FORWARD, REALTIME
from keepstream.operators.ranged import running_sum, with_group

MICRO = 1e6
CATEGORIES = {"backward": BACKWARD, "realtime": REALTIME, "forward": FORWARD}


def micro(x: Column) -> Column:
    """A double in integer micro-units; null for null and NaN."""
    return F.when(~F.isnan(x.cast("double")), F.rint(x.cast("double") * F.lit(MICRO)).cast("bigint"))


def mean(x: Column) -> Column:
    """Mean of the values there are, 0 without any."""
    return F.coalesce(F.sum(micro(x)) / F.count(micro(x)) / F.lit(MICRO), F.lit(0.0))


def mean_nonzero(x: Column) -> Column:
    """Sum over the number of values that are not 0; 0 without any."""
    m = micro(x)
    return F.coalesce(F.sum(m), F.lit(0)) / F.greatest(F.lit(1), F.count_if(m != 0)) / F.lit(MICRO)


def mean_or_zero(x: Column) -> Column:
    """Mean with nulls as 0."""
    return F.sum(F.coalesce(micro(x), F.lit(0))) / F.count(F.lit(1)) / F.lit(MICRO)


def category(task: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tasks in CATEGORIES.items():
        out = F.when(task.isin(*tasks), name).otherwise(out)
    return out


def task_accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per task: n, hits and accuracy, 100 * mean of score."""
    return scored.groupBy(*by, "task").agg(F.count("score").alias("n"), F.sum("score").alias("hits")).withColumn("accuracy", F.lit(100.0) * F.col("hits") / F.col("n"))


def hierarchy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the mean of the unrounded task accuracies of each category, rounded to cents, and the overall third.

    A category without tasks has no average and adds 0 to the overall, which always
    divides by three.
    """
    nano = F.rint(F.col("accuracy") * 1e9).cast("bigint")
    t = task_accuracy(scored, by).withColumn("category", category(F.col("task"))).filter("category IS NOT NULL")
    c = t.groupBy(*by, "category").agg(F.rint(F.sum(nano) / F.count(nano) / F.lit(1e7)).cast("bigint").alias("cents"))
    wide = c.groupBy(*by).agg(*[F.max(F.when(F.col("category") == k, F.col("cents"))).alias(k) for k in CATEGORIES])
    total = sum((F.coalesce(F.col(k), F.lit(0)) for k in CATEGORIES), F.lit(0))
    return wide.select(*by, *[(F.col(k) / 100).alias(k) for k in CATEGORIES], (F.rint(total / F.lit(3.0)) / 100).alias("overall"))


def overall_and_groups(df: DataFrame, group: str, aggregates: list[Column]) -> DataFrame:
    """The aggregates per group and over all, in one pass; the overall row is labelled ``overall``."""
    name = F.when(F.grouping(group) == 1, "overall").otherwise(F.coalesce(F.col(group), F.lit("unknown")))
    return df.rollup(group).agg(name.alias("label"), *aggregates).drop(group).withColumnRenamed("label", group)


def running_accuracy(df: DataFrame, by: list[str], order: list[str], correct: Column, value: Column) -> DataFrame:
    """Running share of correct answers and mean value; errors count in the denominator.

    Sums run over ranges of the order, so a group that holds most rows is spread.
    """
    rows = df.withColumn("_one", F.lit(1)).withColumn("_hit", F.coalesce(correct, F.lit(0)).cast("bigint")).withColumn("_v", F.coalesce(micro(value), F.lit(0)))
    out = running_sum(rows, by, [F.col(o) for o in order], ["_one", "_hit", "_v"], ["seen", "_hits", "_sum"], "accuracy")
    return out.withColumn("accuracy", F.col("_hits") / F.col("seen")).withColumn("mean_value", F.col("_sum") / F.col("seen") / F.lit(MICRO)).drop("_one", "_hit", "_v", "_hits", "_sum")


def peak_stage(trace: DataFrame, by: list[str], value: str, order: list[str], columns: list[str]) -> DataFrame:
    """The first record that reaches the highest value."""
    latest_first = [-F.col(o).cast("bigint") for o in order]
    return trace.groupBy(*by).agg(F.max_by(F.struct(*columns, value), F.struct(F.col(value), *latest_first)).alias("s")).select(*by, "s.*")


def heat(df: DataFrame, by: list[str], value: str, out: str = "heat") -> DataFrame:
    """``df`` plus 0 to 255 between the group's least and greatest value, cut off; 0 if they are equal."""
    ends = with_group(df, by, [F.min(value).alias("_lo"), F.max(value).alias("_hi")])
    scaled = ((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255).cast("int")
    return ends.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(0)).drop("_lo", "_hi")


def rounded(x: Column, digits: int = 2) -> Column:
    """Half to even at a number of digits."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)
