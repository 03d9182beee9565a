"""A sample whose category shares follow given targets: swap repair on signature counts.

A signature is the combination of a record's categories. Only counts per
signature are needed to decide: start from a random sample that satisfies the
floors, then exchange counts between the signatures as long as the deviation
from the targets falls. The rows are drawn at random afterwards, by a hash
threshold per signature found from a histogram of hash bins, so no signature is
ever sorted or gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstream.session import durable

#: Hash bins per signature when the drawing threshold is located.
BINS = 4096
#: Categories outside the targets share this label; targets are a small table, so signatures are few.
OTHER = "(other)"


def clean_category(col: Column) -> Column:
    """A category without surrounding white space and in upper case; blank is null."""
    c = F.upper(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def deviation(taken: np.ndarray, target: np.ndarray, size: int) -> float:
    """Sum of absolute differences of the shares from the targets."""
    return float(np.abs(taken - target * size).sum()) / max(1, size)


def random_counts(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind a random draw of ``n`` rows without replacement holds."""
    out = np.zeros_like(room)
    while n > 0 and room.sum() > out.sum():
        left = room - out
        if left.sum() < 1_000_000_000:
            return out + rng.multivariate_hypergeometric(left, min(n, int(left.sum())), method="marginals")
        add = np.minimum(rng.multinomial(n, left / left.sum()), left)  # beyond numpy's range: with replacement, the surplus drawn again
        out, n = out + add, n - int(add.sum())
    return out


def random_start(available: np.ndarray, member: np.ndarray, target: np.ndarray, floor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A random sample of signatures that holds the floors, where there are enough rows; then any rows at random.

    If the floors alone exceed ``size``, they are filled in turn by target.
    """
    taken = np.zeros_like(available)
    for c in np.argsort(-target, kind="stable"):
        lack = min(int(floor[c] - (member[:, c] * taken).sum()), size - int(taken.sum()))
        if lack > 0:
            taken = taken + random_counts(rng, np.where(member[:, c], available - taken, 0), lack)
    return taken + random_counts(rng, available - taken, size - int(taken.sum()))


def repair(
    available: np.ndarray, target: np.ndarray, floor: np.ndarray, size: int, seed: int = 7, member: np.ndarray | None = None
) -> np.ndarray:
    """Counts to take per signature: at most the available, with the floors of the categories where there are enough.

    ``member`` tells which categories (columns) a signature (row) has; without it each
    signature is a category. Starts from ``random_start`` and exchanges counts between
    two signatures, always the pair whose exchange lowers the deviation most per row,
    as many rows at a time as keep lowering it and no floor forbids, until none does.
    With one column of categories the end is a global minimum, since then only a
    category above its target and one below can be exchanged with gain.
    """
    available = np.asarray(available, np.int64)
    member = np.eye(len(available), dtype=bool) if member is None else np.asarray(member, bool)
    size = int(min(size, available.sum()))
    m = member.astype(np.int64)
    low = np.minimum(np.asarray(floor, np.int64), m.T @ available)
    target = np.asarray(target, float)
    taken = random_start(available, member, target, low, size, np.random.default_rng(seed))
    goal = target * size
    while True:
        have = m.T @ taken
        low_now = np.minimum(low, have)  # floors that cannot be met must at least not get worse
        gap = have - goal
        # what one row more or less of each category changes, and from it of each pair: out of i, into j, common categories aside
        less, more = np.abs(gap - 1) - np.abs(gap), np.abs(gap + 1) - np.abs(gap)
        common = (m * (less + more)) @ m.T
        change = (m @ less)[:, None] + (m @ more)[None, :] - common
        stuck = have <= low_now
        blocked = (m * stuck) @ (1 - m).T > 0  # i has a category at its floor that j lacks
        change[(taken <= 0)[:, None] | (taken >= available)[None, :] | blocked] = np.inf
        np.fill_diagonal(change, np.inf)
        i, j = np.unravel_index(int(change.argmin()), change.shape) if change.size else (0, 0)
        if not change.size or change[i, j] >= -1e-9:
            return taken
        out, into = member[i] & ~member[j], member[j] & ~member[i]
        most = int(min(taken[i], available[j] - taken[j], *((have - low_now)[out] if out.any() else [size])))
        # the deviation is convex in the number of rows, with its bends where a category meets its goal
        bends = {1, most} | {int(np.clip(f(x), 1, most)) for x in np.r_[gap[out], -gap[into]] if x > 0 for f in (np.floor, np.ceil)}
        n = min(sorted(bends), key=lambda k: float(np.abs(gap - k * out + k * into).sum()))
        taken = taken.copy()
        taken[i] -= n
        taken[j] += n


def draw(df: DataFrame, signature: str, key: Sequence[Column], counts: DataFrame, seed: int) -> DataFrame:
    """Exactly ``take`` random rows per signature (``counts``: signature, take).

    The cut is placed in a histogram of ``BINS`` hash bins per signature; only the
    rows of the one bin that holds it are ranked.
    """
    h = F.xxhash64(F.lit(seed), *key)
    keyed = df.withColumn("_h", h).withColumn("_bin", F.pmod(F.shiftright("_h", 20), F.lit(BINS)).cast("int"))
    bins = keyed.groupBy(signature, "_bin").count()
    order = Window.partitionBy(signature).orderBy("_bin")  # at most BINS rows a signature
    upto = bins.withColumn("_upto", F.sum("count").over(order)).withColumn("_before", F.col("_upto") - F.col("count"))
    # bounded: one row per signature of the small target table
    small = F.broadcast(counts.withColumnRenamed(signature, "_sig"))
    cuts = upto.join(small, F.col(signature) == F.col("_sig")).filter("_before < take AND _upto >= take")
    cuts = cuts.select(F.col(signature).alias("_sig"), F.col("_bin").alias("_cut"), (F.col("take") - F.col("_before")).alias("_need"))
    marked = keyed.join(F.broadcast(cuts), F.col(signature) == F.col("_sig"))
    sure = marked.filter("_bin < _cut")
    edge = marked.filter("_bin = _cut")
    ranked = edge.withColumn("_rank", F.row_number().over(Window.partitionBy("_sig").orderBy("_h", *key))).filter("_rank <= _need")
    extra = ["_h", "_bin", "_sig", "_cut", "_need"]
    return sure.drop(*extra).unionByName(ranked.drop("_rank", *extra))


def distinct_samples(df: DataFrame, key: str, categories: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """(key, _row, categories) of each distinct key, from its latest row; each row with a null key is a sample of its own, told by ``_row``."""
    cats = [clean_category(F.col(c)).alias(f"c{k}") for k, c in enumerate(categories)]
    names = [f"c{k}" for k in range(len(categories))]
    rows = df.select(F.col(key).alias("key"), *[F.col(c).alias(f"l{k}") for k, c in enumerate(latest)], *cats)
    order = [f"l{k}" for k in range(len(latest))]
    last = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*names), F.struct(*order, *names)).alias("s"))
    lone = rows.filter("key IS NULL").select("key", F.monotonically_increasing_id().alias("_row"), *names)
    return last.select("key", F.lit(-1).cast("bigint").alias("_row"), *[F.col(f"s.{n}").alias(n) for n in names]).unionByName(lone)


def proportional_sample(
    df: DataFrame,
    targets: DataFrame | dict[str, DataFrame],
    key: str = "id",
    category: str | Sequence[str] = "task",
    latest: Sequence[str] = ("added_at",),
    fraction: float = 0.1,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The sample (key, categories) and its report.

    ``targets`` is a small table (category, target_share, min_rows), or one such table
    for each of several category columns, which are balanced together: a signature is
    the combination of a row's categories. The sample has round(fraction * distinct
    keys) rows, ties of the rounding upwards; each row with a null key counts. A
    category outside the targets (null included) has target 0. The report has a row per
    target category and one for the others (per column, with several): available,
    target_share as given, goal_share (the shares scaled to 1), min_rows, taken, share,
    short_of_share and over_share (the share misses the goal by a row or more, from
    below or above) and short_of_floor. Stray case and blanks of the category are
    ignored; an empty table gives an empty sample and a report of shortfalls.
    """
    columns = [category] if isinstance(category, str) else list(category)
    tables = targets if isinstance(targets, dict) else {columns[0]: targets}
    wants = []
    for c in columns:
        t = tables[c].select(clean_category(F.col(c)).alias("t"), F.col("target_share").cast("double"), F.col("min_rows").cast("bigint"))
        t = t.groupBy("t").agg(F.coalesce(F.max("target_share"), F.lit(0.0)), F.coalesce(F.max("min_rows"), F.lit(0)))
        wants.append(t.filter("t IS NOT NULL").orderBy("t").collect())  # the small target table, which doesn't grow
    rows = distinct_samples(df, key, columns, latest)
    for k, want in enumerate(wants):
        rows = rows.withColumn(f"s{k}", F.when(F.col(f"c{k}").isin([r[0] for r in want]), F.col(f"c{k}")).otherwise(F.lit(OTHER)))
    labels = [f"s{k}" for k in range(len(columns))]
    rows = durable(rows.withColumn("signature", F.to_json(F.array(*labels))), "samples")
    # a row per combination of target categories
    have = rows.groupBy("signature", *labels).count().orderBy("signature").collect()
    kinds = [(k, n) for k, want in enumerate(wants) for n in [*(r[0] for r in want), OTHER]]
    member = np.array([[r[f"s{k}"] == n for k, n in kinds] for r in have], bool).reshape(len(have), len(kinds))
    available = np.array([r["count"] for r in have], np.int64)
    share = np.array([s for want in wants for s in [*(r[1] for r in want), 0.0]])
    total_share = np.array([sum(r[1] for r in wants[k]) or 1.0 for k, _ in kinds])
    floor = np.array([s for want in wants for s in [*(r[2] for r in want), 0]], np.int64)
    goal = share / total_share
    size = int(np.floor(available.sum() * fraction + 0.5))
    taken = repair(available, goal, floor, size, seed, member) if len(have) else np.zeros(0, np.int64)
    spark = df.sparkSession
    counts = spark.createDataFrame([(r["signature"], int(t)) for r, t in zip(have, taken)], "signature string, take bigint")
    sample = draw(rows, "signature", [F.col("key"), F.col("_row")], counts.filter("take > 0"), seed)
    n = max(1, int(taken.sum()))
    m = member.astype(np.int64)
    report = []
    for (k, name), a, s, g, low, t in zip(kinds, m.T @ available, share, goal, floor, m.T @ taken):
        lead = (columns[k],) if len(columns) > 1 else ()
        report.append((*lead, name, int(a), float(s), float(g), int(low), int(t), float(t / n), bool(t / n < g - 1 / n), bool(t / n > g + 1 / n), bool(t < low)))
    head = "column string, category string" if len(columns) > 1 else f"{columns[0]} string"
    return sample.select(F.col("key").alias(key), *[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]), spark.createDataFrame(
        report,
        f"{head}, available bigint, target_share double, goal_share double, min_rows bigint, taken bigint, share double, "
        "short_of_share boolean, over_share boolean, short_of_floor boolean",
    )
