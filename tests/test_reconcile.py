import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from keepstream.operators import reconcile as R

SCHEMA = "row_no bigint, sample_id string, score double, response string, written_at timestamp, key string, state int, side string"
START = datetime(2031, 1, 1)


def row(i, sid, score, resp, minute=0):
    return (i, sid, score, resp, START + timedelta(minutes=minute), "clash", 1, "z")


def brute(a, b):
    def states(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (r[4], r[0])):
            sid = r[1]
            if sid is not None:
                sid = sid.strip(" \t")
                while len(sid) > 1 and sid[0] == "0" and sid[1].isdigit():
                    sid = sid[1:]
            score = None if r[2] is None or r[2] != r[2] else r[2]
            out[sid] = (score, r[3])
        return out

    x, y = states(a), states(b)
    out = [(k, "only_a") for k in x.keys() - y.keys()] + [(k, "only_b") for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        out += [(k, f) for f, p, q in zip(("score", "response"), x[k], y[k]) if p != q]
    return sorted(out, key=str)


def found(spark, a, b, **more):
    dfs = (spark.createDataFrame(r, SCHEMA) for r in (a, b))
    return sorted(((r[0], r[1]) for r in R.ledger_differences(*dfs, **more).collect()), key=str)


def test_dirty_rows(spark):
    a = [row(1, "1", 1.0, "A"), row(2, " 02\t", float("nan"), None), row(3, "3", 0.0, "x"), row(4, "3", 1.0, "old", -5), row(5, None, 1.0, "n"), row(6, "5_1", -0.0, "é"), row(6, "5_1", -0.0, "é"), row(9, "0", 1.0, "z"), row(7, "", 1.0, "q")]
    b = [row(1, "01", 1.0, "A "), row(2, "2", None, ""), row(3, "3", 0.0, "x"), row(5, None, 2.0, "n"), row(6, "5_1", 0.0, "é"), row(8, "8", None, None), row(9, "00", 1.0, "z")]
    assert found(spark, a, b) == brute(a, b)


def test_ties_go_to_the_highest_row_number(spark):
    a = [row(1, "1", 1.0, "A"), row(2, "1", 0.0, "A")]
    b = [row(5, "1", 0.0, "A"), row(4, "1", 1.0, "A")]
    assert found(spark, a, b) == []


@pytest.mark.parametrize("a,b", [([], []), ([row(1, "1", 1.0, "A")], []), ([], [row(1, "1", None, None)])])
def test_empty_copies(spark, a, b):
    assert found(spark, a, b) == brute(a, b)


@pytest.mark.parametrize("share,bound", [(0.02, 16), (0.3, 2), (1.0, 2)])
def test_many_differences_double_the_bound(spark, share, bound):
    rng = random.Random(5)
    a = [row(i, str(i), float(rng.random() < 0.5), rng.choice("ABCD")) for i in range(1500)]
    b = [row(i, r[1], r[2], r[3] + "!" if rng.random() < share else r[3]) for i, r in enumerate(a)]
    b = [r for r in b if rng.random() > share / 4] + [row(9, f"n{i}", 0.0, "new") for i in range(int(40 * share))]
    assert found(spark, a, b, bucket_rows=24, bound=bound) == brute(a, b)


def test_hot_key_and_long_text(spark):
    a = [row(i, "7", 1.0, "t" * 200_000 if i == 799 else "t") for i in range(800)] + [row(i, str(i + 10), 1.0, "A") for i in range(50)]
    b = [row(1, "7", 1.0, "t" * 200_000 + "u")] + [row(i, str(i + 10), 1.0, "A") for i in range(50)]
    assert found(spark, a, b) == [("7", "response")]


def test_field_arithmetic():
    rng, p = random.Random(1), int(R.P)
    a, b = ([rng.randrange(p) for _ in range(500)] for _ in range(2))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert [int(v) for v in R.mulmod(x, y)] == [i * j % p for i, j in zip(a, b)]
    assert [int(v) for v in R.submod(x, y)] == [(i - j) % p for i, j in zip(a, b)]
    assert all(int(v) * i % p == 1 for v, i in zip(R.invmod(x), a))


@pytest.mark.parametrize("na,nb,d,solved", [(2, 3, 8, True), (8, 8, 16, True), (9, 9, 16, False), (0, 0, 4, True), (3, 0, 8, True), (5, 4, 8, False)])
def test_interpolation(na, nb, d, solved):
    rng = random.Random(na * 31 + nb)
    draw = lambda n: [rng.randrange(int(R.P) - R.SPARE) for _ in range(n)]
    common = draw(20)
    a, b = (np.array(common + draw(n), np.uint64) for n in (na, nb))
    z = R.points(d + R.VERIFY)
    ea, eb = (R.evaluations(np.zeros(len(s), int), 1, s, z) for s in (a, b))
    p, q, ok = R.interpolate(ea, eb, len(a) - len(b), d)
    assert bool(ok[0]) == solved
    if solved:
        for poly, s in ((p, a), (q, b)):
            roots = np.flatnonzero(R.horner(np.repeat(poly, len(s), 0), s) == 0)
            assert roots.tolist() == list(range(20, len(s)))
