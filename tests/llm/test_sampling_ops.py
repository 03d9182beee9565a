import itertools
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstream.llm import cutoff, mixing, percentiles, proportions

# ---- proportions


@pytest.mark.parametrize("seed", range(25))
def test_repair_is_as_good_as_any(seed):
    rng = random.Random(seed)
    k = rng.randrange(2, 5)
    available = np.array([rng.randrange(0, 8) for _ in range(k)])
    target = np.array([rng.random() for _ in range(k)])
    target /= target.sum()
    floor = np.array([rng.randrange(0, 3) for _ in range(k)])
    size = rng.randrange(0, int(available.sum()) + 2)
    got = proportions.repair(available, target, floor, size, seed)
    size = min(size, int(available.sum()))
    low = np.minimum(floor, available)
    assert got.sum() == size and (got <= available).all() and (got >= 0).all()
    if low.sum() <= size:
        assert (got >= low).all()
        every = [c for c in itertools.product(*[range(a, b + 1) for a, b in zip(low, available)]) if sum(c) == size]
        best = min(proportions.deviation(np.array(c), target, size) for c in every)
        assert proportions.deviation(got, target, size) == pytest.approx(best)


def sample_tables(spark, n=600):
    rng = random.Random(4)
    tasks = ["A", "a ", " A\t", "B", "b", "C", None, "Z", ""]
    rows = [(i, rng.choices(tasks, [40, 5, 5, 10, 2, 1, 3, 3, 1])[0], datetime(2031, 1, 1), "x", 1) for i in range(n)]
    rows += [(*r[:1], "C", datetime(2031, 1, 2), "x", 1) for r in rows[:6]] + rows[:50] + [(None, "A", None, "x", 1)]
    df = spark.createDataFrame(rows, "id int, task string, added_at timestamp, signature string, count int")
    targets = spark.createDataFrame([("A", 0.4, 5), ("B", 0.3, 5), ("C", 0.2, 30), ("MISSING", 0.1, 3)], "task string, target_share double, min_rows int")
    return df, targets


def test_sample_and_report(spark):
    df, targets = sample_tables(spark)
    sample, report = proportions.proportional_sample(df, targets, fraction=0.2)
    rows = sample.collect()
    ids = [r["id"] for r in rows]
    assert len(ids) == len(set(ids)) == 120
    by = {r["task"]: r for r in report.collect()}
    taken = {t: sum((r["task"] or "?") == t for r in rows) for t in ("A", "B", "C")}
    assert {t: by[t]["taken"] for t in taken} == taken
    assert by["MISSING"]["short_of_floor"] and by["MISSING"]["short_of_share"] and by["MISSING"]["available"] == 0
    assert by["C"]["taken"] == by["C"]["available"] and by["C"]["short_of_floor"]
    assert by["A"]["taken"] >= 48 and by["B"]["taken"] >= 36
    assert sorted(ids, key=str) == sorted((r["id"] for r in proportions.proportional_sample(df.repartition(5), targets, fraction=0.2)[0].collect()), key=str)


def test_rows_without_a_key_count_each(spark):
    df = spark.createDataFrame([(None, "A", None)] * 50 + [(i, "B", None) for i in range(50)], "id int, task string, added_at timestamp")
    targets = spark.createDataFrame([("A", 0.5, 0), ("B", 0.5, 0)], "task string, target_share double, min_rows int")
    sample, report = proportions.proportional_sample(df, targets, fraction=0.4)
    assert {r["task"]: r["available"] for r in report.collect()} == {"A": 50, "B": 50, proportions.OTHER: 0}
    assert [(r["id"] is None, r["task"]) for r in sample.collect()].count((True, "A")) == 20 and sample.count() == 40


def test_start_is_random_and_keeps_floors():
    available, floor = np.array([5000, 300, 40, 7]), np.array([10, 10, 30, 9])
    low = np.minimum(floor, available)
    starts = [proportions.random_start(available, np.eye(4, dtype=bool), np.array([0.4, 0.3, 0.2, 0.1]), low, 400, np.random.default_rng(s)) for s in range(200)]
    assert all(s.sum() == 400 and (s >= low).all() and (s <= available).all() for s in starts)
    assert len({tuple(s) for s in starts}) > 20 and starts[0].tolist() == proportions.random_start(available, np.eye(4, dtype=bool), np.array([0.4, 0.3, 0.2, 0.1]), low, 400, np.random.default_rng(0)).tolist()
    rest, room = np.array(starts).mean(0) - low, available - low
    assert abs(rest[0] / rest.sum() - room[0] / room.sum()) < 0.01  # above the floors each row is as likely as any other
    huge = proportions.random_counts(np.random.default_rng(1), np.array([3 * 10**9, 10**9]), 10**8)
    assert huge.sum() == 10**8 and abs(huge[0] / 10**8 - 0.75) < 0.01


@pytest.mark.parametrize("seed", range(12))
def test_several_columns_are_balanced_together(seed):
    rng = np.random.default_rng(seed)
    a, b = 4, 3
    member = np.array([[i == x for x in range(a)] + [j == y for y in range(b)] for i in range(a) for j in range(b)])
    available = rng.integers(200, 2000, a * b)
    target = np.r_[rng.dirichlet(np.ones(a) * 5), rng.dirichlet(np.ones(b) * 5)]
    floor = np.full(a + b, 20)
    got = proportions.repair(available, target, floor, 600, seed, member)
    have = member.T.astype(int) @ got
    assert got.sum() == 600 and (got >= 0).all() and (got <= available).all() and (have >= floor).all()
    feasible = np.maximum(target * 600, floor)
    assert np.abs(have - target * 600).sum() <= np.abs(feasible - target * 600).sum() * 2 + a + b


def test_sample_of_two_columns_and_a_category_above_its_target(spark):
    rows = [(i, "A" if i % 4 else "B", "x" if i % 3 else "y", datetime(2031, 1, 1)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, task string, kind string, added_at timestamp")
    t = spark.createDataFrame([("A", 0.5, 5), ("B", 0.5, 5)], "task string, target_share double, min_rows int")
    k = spark.createDataFrame([("X", 0.8, 5), ("Y", 0.2, 5)], "kind string, target_share double, min_rows int")
    sample, report = proportions.proportional_sample(df, {"task": t, "kind": k}, category=["task", "kind"], fraction=0.25)
    taken = {(r["column"], r["category"]): r["taken"] for r in report.collect()}
    assert taken["task", "A"] == taken["task", "B"] == 150 and taken["kind", "X"] == 240 and taken["kind", "Y"] == 60
    assert sample.count() == 300 == sample.select("id").distinct().count() and sample.columns == ["id", "task", "kind"]
    short = spark.createDataFrame([("A", 0.3, 5), ("B", 0.3, 5), ("GONE", 1.4, 5)], "task string, target_share double, min_rows int")
    by = {r["task"]: r for r in proportions.proportional_sample(df, short, fraction=0.1)[1].collect()}
    assert by["GONE"]["short_of_share"] and by["GONE"]["goal_share"] == pytest.approx(0.7) and by["A"]["over_share"] and by["B"]["over_share"]


def test_sample_of_nothing(spark):
    df, targets = sample_tables(spark)
    sample, report = proportions.proportional_sample(df.limit(0), targets)
    assert sample.collect() == [] and all(r["taken"] == 0 for r in report.collect())
    sample, report = proportions.proportional_sample(df, targets.limit(0), fraction=1.0)
    assert sample.count() == report.first()["available"] == report.first()["taken"]


def test_draw_takes_exactly(spark):
    df = spark.range(20000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("signature"), F.lit("c").alias("category"))
    counts = spark.createDataFrame([("hot", 5001), ("cold", 6667)], "signature string, take bigint")
    got = {r["signature"]: r["count"] for r in proportions.draw(df, "signature", [F.col("key")], counts, 3).groupBy("signature").count().collect()}
    assert got == {"hot": 5001, "cold": 6667}


# ---- percentiles

VALUES = [0.0, -0.0, 1.5, 1.5, 1.5, -3.25, 1e300, -1e300, 5e-324, 7.0, float("nan"), None, float("inf"), 2.0, -1e-9]


def test_bits_keep_the_order():
    x = np.array(sorted(v for v in VALUES if v is not None and math.isfinite(v)))
    u = percentiles.ordered_bits(x)
    assert (np.diff(u) >= 0).all() and (percentiles.from_bits(u) == x).all()


@pytest.mark.parametrize("seed", range(2))
def test_exact_and_merged_percentiles(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["m", "n", None]), rng.randrange(3), rng.choice(VALUES) if rng.random() < 0.3 else rng.lognormvariate(0, 3) * rng.choice([1, -1])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    qs = (0.0, 0.5, 0.9, 0.99, 1.0)
    values = percentiles.long_form(df, ["g", "day"], ["v"])
    exact = {(r["g"], r["q"]): (r["n"], percentiles.from_bits(np.array([r["low"], r["high"]]))) for r in percentiles.radix_percentiles(values, ["g"], qs).collect()}
    two = {(r["g"], r["q"]): (r["low"], r["high"]) for r in percentiles.radix_percentiles(values, ["g"], qs, passes=2).collect()}
    daily = percentiles.summaries(values, ["g", "day"])
    met = {(r["g"], r["q"]): (r["low"], r["high"]) for r in percentiles.summary_percentiles(percentiles.merged(daily, ["g"]), ["g"], qs).collect()}
    for g in ("m", "n", None):
        own = sorted(v for a, _, v in rows if a == g and v is not None and math.isfinite(v))
        for q in qs:
            want = own[max(1, math.ceil(q * len(own))) - 1]
            n, (lo, hi) = exact[g, q]
            assert n == len(own) and lo == hi == want
            for low, high in (two[g, q], met[g, q]):
                lo, hi = percentiles.from_bits(np.array([low, high]))
                assert lo <= want <= hi
                if abs(want) > 1e-300:
                    assert hi - lo <= abs(want) * 2.0**-11


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "g string, v double")
    values = percentiles.long_form(df, ["g"], ["v"])
    assert percentiles.radix_percentiles(values, ["g"], (0.5,)).collect() == []


# ---- cutoffs


@pytest.mark.parametrize("seed", range(3))
def test_cutoffs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choices(["hot", "b", "c", None, "ties"], [60, 5, 1, 3, 20])[0], rng.random()) for _ in range(4000)]
    rows = [(s, 1.0 if s == "ties" and rng.random() < 0.9 else rng.choice([None, float("nan")]) if rng.random() < 0.05 else round(v, 2)) for s, v in rows] + [("one", -0.0)]
    ratios = {"hot": 0.25, "b": 1.0, "c": 0.0, "ties": 0.3, "none": 0.5, "one": 0.01}
    df = spark.createDataFrame([(*r, 1) for r in rows], "source string, score double, cnt int").repartition(5)
    targets = spark.createDataFrame([*ratios.items(), (None, 0.5), ("hot", 0.25)], "source string, ratio double")
    got = {r["source"]: r for r in cutoff.share_cutoffs(df, targets, "source", "score", "ratio").collect()}
    assert set(got) == set(ratios)
    for s, ratio in ratios.items():
        own = sorted((v for a, v in rows if a == s and v is not None and v == v), reverse=True)
        k = min(len(own), math.ceil(ratio * len(own) - 1e-9))
        cut = own[k - 1] if k > 0 else None
        kept = sum(v >= cut for v in own) if cut is not None else 0
        assert (got[s]["cutoff"], got[s]["kept"], got[s]["total"]) == (cut, kept, len(own))


def test_ranks_of_large_totals_are_exact(spark):
    from decimal import ROUND_CEILING, Decimal

    ratios = [0.55, 0.1, 0.07, 0.3, 0.9, 0.999, 1 / 3, 1e-9, 1.5, 0.0, -1.0]
    totals = [42_000_000, 10**8, 10**8 + 1, 199_999_999, 3 * 10**12, 1, 0]
    df = spark.createDataFrame([(r, t) for r in ratios for t in totals], "r double, t bigint")
    for row in df.select("r", "t", cutoff.target_rank(F.col("r"), F.col("t")).alias("k")).collect():
        want = (Decimal(repr(min(1.0, max(0.0, row["r"])))).quantize(Decimal(1).scaleb(-15)) * row["t"]).to_integral_value(ROUND_CEILING)
        assert row["k"] == want
    odd = spark.createDataFrame([(None, 5), (float("nan"), 5)], "r double, t bigint")
    assert [r[0] for r in odd.select(cutoff.target_rank(F.col("r"), F.col("t"))).collect()] == [None, None]


def test_two_ratios_of_one_source(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(10)], "source string, score double")
    targets = spark.createDataFrame([("s", 0.2), ("s", 0.5), ("s", None), ("s", 0.2)], "source string, ratio double")
    got = {r["ratio"]: (r["cutoff"], r["kept"], r["total"]) for r in cutoff.share_cutoffs(df, targets, "source", "score", "ratio").collect()}
    assert got == {0.2: (8.0, 2, 10), 0.5: (5.0, 5, 10), None: (None, 0, 10)}


def test_windows_scored_twice(spark):
    t = [datetime(2031, 1, d) for d in (1, 2)]
    rows = [("v", [0, 1], t[0], 0, "c", [1.0, 2.0]), ("v", [0, 1], t[1], 0, "c", [5.0, 6.0, None]), ("v", [2, 3], t[0], 1, "c", None), ("w", None, t[0], 0, "c", [9.0])]
    df = spark.createDataFrame(rows, "video_path string, target_frames array<int>, scored_at timestamp, window_no int, collection string, patch_loss_16x16 array<double>")
    targets = spark.createDataFrame([("c", 0.5)], "collection string, keep_ratio double")
    assert [tuple(r) for r in cutoff.loss_cutoffs(df, targets).collect()] == [("c", 0.5, 6.0, 2, 3)]
    assert [tuple(r) for r in cutoff.loss_cutoffs(df.limit(0), targets).collect()] == [("c", 0.5, None, 0, 0)]


# ---- mixing


def mix(spark, docs, targets, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, weight double, copy int")
    t = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    drawn, report = mixing.fair_mix(d, t, **more)
    return {r["doc_id"]: r["copies"] for r in drawn.collect()}, {r["source"]: r for r in report.collect()}


def test_mix_follows_weights(spark):
    rng = random.Random(1)
    docs = [(i, rng.choices(["big", "mid", "small", None, "other"], [60, 20, 2, 3, 5])[0], rng.randrange(1, 60), 1.0, 1) for i in range(4000)]
    docs += [(9000, "big", None, 1.0, 1), (9001, "big", 0, 1.0, 1)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 1), ("gone", 0.0, 3), ("missing", 0.1, 2)]
    drawn, report = mix(spark, docs, targets, budget=20000)
    size = {d: n for d, _, n, _, _ in docs}
    source = {d: s for d, s, _, _, _ in docs}
    total = sum(size[d] * c for d, c in drawn.items())
    assert 20000 - 60 < total <= 20000
    limit = {"big": 1, "mid": 2, "small": 1}
    assert all(1 <= c <= limit[source[d]] for d, c in drawn.items())
    for s in report:
        assert report[s]["tokens"] == sum(size[d] * c for d, c in drawn.items() if source[d] == s)
    assert report["small"]["short"] and report["missing"]["short"] and report["missing"]["available"] == 0
    assert report["big"]["tokens"] / report["mid"]["tokens"] == pytest.approx(5 / 3, rel=0.03)
    own = [c for d, c in drawn.items() if source[d] == "small"]
    assert set(own) == {1} and len(own) == sum(s == "small" for s in source.values())


def test_mix_of_nothing(spark):
    drawn, report = mix(spark, [], [("a", 1.0, 2)])
    assert drawn == {} and report["a"]["tokens"] == 0
    assert mix(spark, [(1, "a", 5, 1.0, 1)], []) == ({}, {})
    assert mix(spark, [(1, "a", 5, 1.0, 1)], [("a", 1.0, 3)], budget=12)[0] == {1: 2}
