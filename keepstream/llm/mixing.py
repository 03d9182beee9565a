"""Mixing sources to target weights by weighted fair queueing.

Every document copy gets a virtual finish time: the tokens of its source up to
and including it, in shuffled order, divided by the source's weight. Copies in
the global order of finish times give each source its share at every length; the
order is cut where the token budget ends. A source that has run out of allowed
copies leaves its part to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstream.operators.ranged import running_sum
from keepstream.session import durable


def fair_mix(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "n_tokens",
    budget: int | None = None,
    budget_share: float = 0.5,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """The drawn copies per document and the report of actual shares.

    ``docs`` has key, source and size; ``targets`` is the small table (source,
    target_weight, max_repeats): a document is used at most max_repeats times. The
    budget is ``budget``, or ``budget_share`` of all tokens of the sources named. The
    mix is the longest prefix of the queue within the budget. Documents without a
    target (null source included) and without tokens are not drawn; a weight or a
    repeat limit that is null or below 0 counts as 0. First result: (key, source,
    size, copies). Second: a row per target with weight, available, tokens, share
    and short (the share misses the target by more than 0.01). Rows with equal
    key, source and size are counted together.
    """
    want = targets.filter(F.col(source).isNotNull()).groupBy(source).agg(
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("target_weight").cast("double")), F.lit(0.0))).alias("weight"),
        F.greatest(F.lit(0), F.coalesce(F.max(F.col("max_repeats").cast("int")), F.lit(0))).alias("repeats"),
    )
    want = durable(want, "weights")
    # bounded: the small targets table
    named = docs.select(key, source, F.col(size).cast("bigint").alias(size)).join(F.broadcast(want), source)
    named = named.filter((F.col(size) > 0) & (F.col("weight") > 0) & (F.col("repeats") > 0))
    shuffled = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key), F.col(size)]
    queued = running_sum(named, [source], shuffled, size, "upto", "queue")
    totals = durable(queued.groupBy(source).agg(F.sum(size).alias("available")), "totals")  # a row per target
    if budget is None:
        budget = int((totals.agg(F.sum("available")).first()[0] or 0) * budget_share)
    copies = queued.join(F.broadcast(totals), source).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    finish = (F.col("copy") * F.col("available") + F.col("upto")) / F.col("weight")
    # a source alone cannot pass the budget, so later copies need no place in the order
    useful = copies.filter(F.col("copy") * F.col("available") + F.col("upto") <= F.lit(budget)).select(
        key, source, size, finish.alias("finish"), "copy"
    )
    order = [F.col("finish"), F.col(source), F.xxhash64(F.lit(seed), F.col(key)), F.col(key), F.col("copy")]
    placed = running_sum(useful, [], order, size, "position", "order")
    drawn = placed.filter(F.col("position") <= F.lit(budget)).groupBy(key, source, size).agg(F.count(F.lit(1)).alias("copies"))
    drawn = durable(drawn, "drawn")
    got = drawn.groupBy(source).agg(F.sum(F.col(size) * F.col("copies")).alias("tokens"))
    all_tokens = float(got.agg(F.sum("tokens")).first()[0] or 1)
    all_weight = float(want.agg(F.sum("weight")).first()[0] or 1)
    report = want.join(totals, source, "left").join(got, source, "left")
    share = F.coalesce(F.col("tokens") / F.lit(all_tokens), F.lit(0.0))
    weight = F.col("weight") / F.lit(all_weight)
    return drawn, report.select(
        source,
        weight.alias("target_share"),
        F.coalesce("available", F.lit(0)).alias("available"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        share.alias("share"),
        (share < weight - 0.01).alias("short"),
    )
