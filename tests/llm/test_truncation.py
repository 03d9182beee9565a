"""The near-copy stage against planted cuts and brute force, and what decides a record."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstream.llm import truncation
from tests.llm.test_texts import RECORDS, record_rows


def found(spark, texts, partitions=8):
    """The texts that the stage finds among all."""
    df = spark.createDataFrame(record_rows(texts), RECORDS).repartition(partitions)
    which, keys = truncation.band_keys(texts)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    marked = spark.createDataFrame([(hashes[texts[i]], [int(x) for x in k.view(np.int64)]) for i, k in zip(which, keys)], "h bigint, bands array<bigint>")
    got = {r["h"] for r in truncation.early_copies(marked, df.select(F.xxhash64("text").alias("h"), "text")).collect()}
    return {t for t, h in hashes.items() if h in got}


def changed(rng, words, added):
    """One word changed, some added: a near-copy that is longer."""
    out = list(words)
    out[rng.randrange(len(out))] = f"other{rng.randrange(10**6)}"
    return " ".join(out + [f"more{rng.randrange(10**6)}" for _ in range(added)])


@pytest.mark.parametrize("k", [0, 1, 2, 5])
@pytest.mark.parametrize("exact", [True, False])
def test_recall_of_planted_cuts(spark, k, exact):
    """Each group: an original, a copy cut within it, and longer near-copies. Without ``exact`` no copy continues the cut one word for word."""
    rng = random.Random(10 * k + exact)
    texts, cut, group = [], [], {}
    for _ in range(200):
        words = [f"word{rng.randrange(3000)}" for _ in range(120)]
        whole = " ".join(words)
        short = whole[: len(whole) - rng.randrange(2, 30)].rstrip()
        longer = [changed(rng, words, 3) for _ in range(k if exact else k + 1)]
        cut.append(short)
        group[short] = longer + ([whole] if exact else [])
        texts += [short, *group[short]]
    got = found(spark, texts)
    assert len(got & set(cut)) >= 0.9 * len(cut)
    for t in got & set(cut):
        assert any(truncation.ends_early(t, o) for o in group[t])


def test_a_bucket_of_many_near_copies_spreads(spark, monkeypatch):
    """One template for all: every cut copy is found though neighbours are few and ranges are many."""
    rng = random.Random(3)
    base = [f"word{i}" for i in range(50)]
    texts = []
    for i in range(400):
        words = list(base)
        words[30] = f"part{i}"
        whole = " ".join(words)
        texts.append(whole)
        if i % 2:
            texts.append(whole[: len(whole) - rng.randrange(3, 20)].rstrip())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(spark, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {t for t in texts if any(o != t and o.startswith(t) for o in texts)}
    assert want and want <= got


def test_pairs_stay_as_many_as_texts(monkeypatch):
    """A bucket of n texts is judged in a multiple of n pairs."""
    calls = []
    true = truncation.goes_on
    monkeypatch.setattr(truncation, "goes_on", lambda a, b: calls.append(1) or true(a, b))
    base = " ".join(f"word{i}" for i in range(40))
    texts = [f"{base} tail{i:05d}" for i in range(2000)]
    rows = sorted((1, truncation.Copy(i, t).key(0), i) for i, t in enumerate(texts))
    list(truncation.neighbours((b, k, truncation.Copy(i, texts[i])) for b, k, i in rows))
    assert len(calls) <= 2 * (truncation.NEAR + 1) * len(texts)


LEAD = "the man goes to the shop by the river at noon and after a talk with two friends of his he buys himself one more ladder"
MORE = " ".join(f"thing{i}" for i in range(40))


def test_texts_worded_alike_are_not_paired_with_each_other(monkeypatch):
    """Many texts that differ in case and marks alone, and texts that continue them: all are found in a multiple of n pairs."""
    calls = []
    true = truncation.goes_on
    monkeypatch.setattr(truncation, "goes_on", lambda a, b: calls.append(1) or true(a, b))
    base = [f"word{i}" for i in range(40)]
    alike = [" ".join(w.upper() if n >> k & 1 else w for k, w in enumerate(base)) for n in range(1000)] + [" ".join(base) + "."]
    longer = [" ".join(base) + f" and tail{i:04d}" for i in range(1000)]
    texts = alike + longer
    rows = sorted((1, truncation.Copy(i, t).key(0), i) for i, t in enumerate(texts))
    found = {c.h for c in truncation.neighbours((b, k, truncation.Copy(i, texts[i])) for b, k, i in rows)}
    assert found == set(range(1000)) and len(calls) <= 2 * (truncation.NEAR + 2) * len(texts)


@pytest.mark.parametrize(
    "short,long,want",
    [
        (f"{LEAD} for the", f"{LEAD} for the van.", True),
        (f"{LEAD[:-3]}", f"{LEAD}.", True),
        (f"{LEAD.replace('shop', 'inn')} {MORE} and gard", f"{LEAD} {MORE} and garden.", True),
        (f"{LEAD}.", f"{LEAD}. It rains.", False),
        (LEAD, f"{LEAD}. It rains.", False),
        (f"{LEAD} of 5.", f"{LEAD} of 5.25 m", True),
        (f"{LEAD} blue", f"{LEAD} red and wide", False),
    ],
)
def test_alignment_of_ends(short, long, want):
    assert truncation.ends_early(short, long) is want
    assert truncation.ends_early(long, short) is False


def records(spark, rows):
    day = lambda d: datetime(2031, 1, d)
    return spark.createDataFrame([(i, w, day(d), t, o, q, 1, "x") for i, w, d, t, o, q in rows], RECORDS)


def test_records_without_an_id_stay_apart(spark):
    rows = [(None, "a", 1, "It is so. And the man mov", None, None), (None, "a", 2, "It is so.", None, None), (None, "b", 1, None, None, None), (1, "b", 1, "It is so. And th", None, None), (1, "b", 2, "It is so.", None, None)]
    got = sorted((r["id"] or 0, r["source"], r["cut"]) for r in truncation.cut_records(records(spark, rows)).collect())
    assert got == [(0, "a", False), (0, "a", True), (0, "b", False), (1, "b", False)]


def test_short_phrases_are_whole_and_near_copies_settle_closed_ends(spark):
    long = " ".join(f"word{i}" for i in range(30))
    rows = [
        (1, "a", 1, "red cup on the left table", None, None),
        (2, "a", 1, f'{long} "of 5"', None, None),
        (3, "a", 1, f'{long} "of 5" metres.', None, None),
        (4, "a", 1, "A red cup stands on the table.", None, None),
    ]
    got = {r["id"]: (r["cut"], r["stage"]) for r in truncation.cut_records(records(spark, rows)).collect()}
    assert got[1] == (False, "terminality")
    assert got[2] == (True, "near_copy")
    assert got[3][0] is False


def test_clauses_are_told_from_phrases(spark):
    texts = ["The man walks because the dog is near the table."] * 30 + ["the dog near the table", "the man near the table", "near the dog the table"] * 30 + ["because"]
    table = truncation.terminality(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert table.whole("the man near the table") and not table.whole("because the man near the table") and not table.whole("the man near the")
    assert not table.whole("the man near the tab")


def brute_force(texts):
    """Of texts in one bucket those with which another is similar and goes on, pair by pair."""
    copies = [truncation.Copy(i, t) for i, t in enumerate(texts)]
    return {a.text for a in copies if any(a.text != b.text and truncation.goes_on(a, b) and truncation.similar(a, b) for b in copies)}


def scattered(rng, pairs=300):
    """One template; each cut text goes on in one other alone, whose early words differ, so that it lies far off in the bucket's order."""
    base, texts, cut = [f"word{i}" for i in range(60)], [], []
    for i in range(pairs):
        a, b = list(base), list(base)
        a[1], b[1] = f"aa{rng.randrange(10**9)}", f"zz{rng.randrange(10**9)}"
        cut.append(" ".join([*a, f"own{i:04d}"[:6]] if i % 3 else [*a, f"{i}."]))
        texts += [cut[-1], " ".join([*b, f"own{i:04d}x and more" if i % 3 else f"{i}.25 metres"])]
    return texts, cut


def same_bucket(spark, texts, partitions):
    h = {t: i for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t) for t, i in h.items()], "h bigint, text string").repartition(partitions)
    marked = df.select("h", F.expr("array(7L)").alias("bands"))
    return {texts[r["h"]] for r in truncation.early_copies(marked, df).collect()}


def test_partners_far_off_in_the_order_of_a_bucket_are_found(spark, monkeypatch):
    """All texts share one bucket; far more than the neighbours lie between a cut text and the one that goes on."""
    texts, cut = scattered(random.Random(11))
    want = brute_force(texts)
    assert want == set(cut)
    assert same_bucket(spark, texts, 5) == want
    monkeypatch.setattr(truncation, "BLOCK", 2000)
    monkeypatch.setattr(truncation, "PASSING", 3000)
    assert same_bucket(spark, texts, 5) == want


def test_every_end_is_met_as_pair_by_pair(spark):
    """Odd ends: marks for words, decimals, few words besides what a cut leaves, dotted capitals, words of one bucket in many orders."""
    rng = random.Random(12)
    lead = [" ".join(f"w{x}" if rng.random() < 0.04 else f"word{x}" for x in range(40)) for _ in range(60)]
    ends = ["", " -", " - so", " 3.", " 3.14 m", " No.", " No.7", " word", " wordy it", " wordy.", " words of", " of", " of it", ' "of', ' "office" b', " İ.", " İ.x", " 是", " 是的", " a…", " a b", " (truncated)", " x." , " x.) y", ' x.)"y']
    texts = sorted({f"{a}{rng.choice(ends)}" for a in lead for _ in range(6)} | {"so it [...] [...] [...] [...]", "so it is now and so it [...] [...]", "one two [cut] [cut] [cut] [cut]"})
    want = brute_force(texts)
    assert len(want) > 30 and same_bucket(spark, texts, 3) == want
