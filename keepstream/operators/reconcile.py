"""Differences between two copies of a dataset by set reconciliation.

Each copy's states are hashed into the field GF(2^61 - 1) and spread over small
buckets by key. A bucket's characteristic polynomial, evaluated at a few fixed
points, is its sketch. From the ratio of two sketches the rational function of
the differing hashes is interpolated, checked at further points, and, where the
check fails, tried again with twice the degree bound. Each copy finds its own
differing rows as the roots among its hashes; only those are fetched and
compared field by field, so nothing is reported that does not differ.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepstream.session import durable

P = np.uint64(2**61 - 1)
#: Field elements kept free for sample points, so that no point is a root.
SPARE = 1 << 16
#: Points beyond the degree bound that verify an interpolation.
VERIFY = 2


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 of uint64 arrays below the modulus."""
    u = np.uint64
    ah, al, bh, bl = a >> u(32), a & u(0xFFFFFFFF), b >> u(32), b & u(0xFFFFFFFF)
    mid, lo = ah * bl + al * bh, al * bl
    s = ah * bh * u(8) + (mid >> u(29)) + ((mid & u(0x1FFFFFFF)) << u(32)) + (lo & P) + (lo >> u(61))
    s = (s & P) + (s >> u(61))
    return np.where(s >= P, s - P, s)


def submod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + P - b)


def invmod(a: np.ndarray) -> np.ndarray:
    """a^(p-2): the bits of p - 2 are ones except the second lowest."""
    out, e = np.ones_like(a), int(P) - 2
    base = a.copy()
    while e:
        if e & 1:
            out = mulmod(out, base)
        base = mulmod(base, base)
        e >>= 1
    return out


def points(n: int) -> np.ndarray:
    if n > SPARE:
        raise ValueError(f"a bucket needs {n} sample points, more than the {SPARE} kept free: use more buckets")
    return P - np.uint64(1) - np.arange(n, dtype=np.uint64)


def elements(h: np.ndarray) -> np.ndarray:
    """Field elements of 64-bit hashes, never one of the sample points."""
    x = h.astype(np.int64).view(np.uint64) & P
    return np.where(x >= P - np.uint64(SPARE), x - np.uint64(SPARE), x)


def evaluations(seg: np.ndarray, n_seg: int, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Product over each segment's elements of (z - x), one column per point; seg ascends."""
    acc = np.ones((n_seg, len(z)), np.uint64)
    start = np.searchsorted(seg, np.arange(n_seg))
    rank = np.arange(len(seg)) - start[seg]
    for r in range(int(rank.max(initial=-1)) + 1):
        at = np.flatnonzero(rank == r)
        s = seg[at]
        acc[s] = mulmod(acc[s], submod(np.broadcast_to(z, (len(at), len(z))), x[at, None]))
    return acc


def horner(coefs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of monic polynomials; coefs[:, k] belongs to x^k, the leading one left out."""
    v = np.ones_like(x)
    for k in range(coefs.shape[1] - 1, -1, -1):
        v = mulmod(v, x) + coefs[:, k].reshape(-1, *[1] * (x.ndim - 1))
        v = np.where(v >= P, v - P, v)
    return v


def eliminate(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Jordan over a stack of augmented systems; free unknowns are zero.

    Returns the solutions and which systems are consistent.
    """
    n, rows, cols = m.shape[0], m.shape[1], m.shape[2] - 1
    used, pivot, ar = np.zeros((n, rows), bool), np.full((n, cols), -1), np.arange(n)
    for c in range(cols):
        cand = ~used & (m[:, :, c] != 0)
        has, row = cand.any(1), cand.argmax(1)
        lead = np.where(has[:, None], m[ar, row], 0)
        lead = mulmod(lead, invmod(np.where(has, lead[:, c], np.uint64(1)))[:, None])
        factor = np.where(has[:, None], m[:, :, c], 0)
        factor[ar, row] = 0
        m = submod(m, mulmod(factor[:, :, None], lead[:, None, :]))
        m[ar[has], row[has]] = lead[has]
        used[ar[has], row[has]] = True
        pivot[has, c] = row[has]
    sol = np.where(pivot >= 0, m[ar[:, None], np.maximum(pivot, 0), -1], 0).astype(np.uint64)
    return sol, ~((m[:, :, -1] != 0) & ~used).any(1)


def interpolate(ea: np.ndarray, eb: np.ndarray, delta: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numerators, denominators and verdicts of one stack of sketches with the same size difference."""
    n = ea.shape[0]
    ma = (d + delta) // 2
    mb = ma - delta
    if ma < 0 or mb < 0:
        return np.zeros((n, 0), np.uint64), np.zeros((n, 0), np.uint64), np.zeros(n, bool)
    z = points(d + VERIFY)
    f = mulmod(ea, invmod(eb))
    power = [np.ones_like(z)]
    for _ in range(max(ma, mb)):
        power.append(mulmod(power[-1], z))
    eq = ma + mb
    p, q = np.empty((n, ma), np.uint64), np.empty((n, mb), np.uint64)
    good = np.zeros(n, bool)
    step = max(1, (1 << 18) // max(1, (eq + 1) * (eq + 1)))
    for lo in range(0, n, step):
        fs = f[lo : lo + step]
        m = np.empty((len(fs), eq, eq + 1), np.uint64)
        for k in range(ma):
            m[:, :, k] = power[k][:eq]
        for k in range(mb):
            m[:, :, ma + k] = submod(np.zeros_like(fs[:, :eq]), mulmod(fs[:, :eq], power[k][:eq][None, :]))
        m[:, :, eq] = submod(mulmod(fs[:, :eq], power[mb][:eq][None, :]), np.broadcast_to(power[ma][:eq], (len(fs), eq)))
        sol, ok = eliminate(m)
        p[lo : lo + step], q[lo : lo + step] = sol[:, :ma], sol[:, ma:]
        zz = np.broadcast_to(z, fs.shape)
        ok &= (horner(sol[:, :ma], zz) == mulmod(fs, horner(sol[:, ma:], zz))).all(1)
        good[lo : lo + step] = ok
    return p, q, good


SKETCH = "bucket bigint, n bigint, evals binary"
SOLVED = "bucket bigint, ok boolean, differs boolean, num binary, den binary"


def _sketches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket of a partition sorted by bucket."""
    z, carry = points(d + VERIFY), None

    def out(buckets: np.ndarray, n: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets), pa.array(n), pa.array([r.tobytes() for r in e], pa.binary())], names=["bucket", "n", "evals"]
        )

    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column("bucket").to_numpy()
        ids, seg, n = np.unique(bucket, return_inverse=True, return_counts=True)
        e = evaluations(seg, len(ids), elements(b.column("h").to_numpy()), z)
        if carry is not None:
            if carry[0] == ids[0]:
                n[0] += carry[1]
                e[0] = mulmod(e[0], carry[2])
            else:
                yield out(np.array([carry[0]]), np.array([carry[1]]), carry[2][None])
        if len(ids) > 1:
            yield out(ids[:-1], n[:-1], e[:-1])
        carry = (ids[-1], n[-1], e[-1])
    if carry is not None:
        yield out(np.array([carry[0]]), np.array([carry[1]]), carry[2][None])


def _solve(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    k = d + VERIFY
    for b in batches:
        if not b.num_rows:
            continue
        na, nb = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
        one = np.ones(k, np.uint64).tobytes()
        ea, eb = (np.frombuffer(b"".join(x or one for x in b.column(c).to_pylist()), np.uint64).reshape(-1, k) for c in ("ea", "eb"))
        same = (na == nb) & (ea == eb).all(1)
        ok, num, den = same.copy(), [b""] * len(na), [b""] * len(na)
        for delta in np.unique((na - nb)[~same]):
            at = np.flatnonzero(~same & (na - nb == delta))
            p, q, good = interpolate(ea[at], eb[at], int(delta), d)
            ok[at] = good
            for i, j in zip(at, range(len(at))):
                num[i], den[i] = p[j].tobytes(), q[j].tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column("bucket"), pa.array(ok), pa.array(~same), pa.array(num, pa.binary()), pa.array(den, pa.binary())],
            names=["bucket", "ok", "differs", "num", "den"],
        )


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose element is a root of their copy's polynomial."""
    for b in batches:
        if not b.num_rows:
            continue
        x = elements(b.column("h").to_numpy())
        coefs = b.column("coefs").to_pylist()
        width = np.array([len(c) // 8 for c in coefs])
        hit = np.zeros(len(x), bool)
        for w in np.unique(width):
            if w:
                at = np.flatnonzero(width == w)
                hit[at] = horner(np.frombuffer(b"".join(coefs[i] for i in at), np.uint64).reshape(-1, w), x[at]) == 0
        yield b.select(["key"]).filter(pa.array(hit))


def latest_state(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per key: the fields of the row that is last in order; equal rows are told apart by their fields.

    ``rows`` has key, ord and state. Partial aggregation comes before the shuffle, so
    a key that holds most rows costs one row per partition. A null key is a key like
    any other.
    """
    last = rows.groupBy("key").agg(F.max(F.struct("ord", "state")).alias("s"))
    return last.select("key", *[F.col(f"s.state.{f}").alias(f) for f in fields])


def differing_keys(a: DataFrame, b: DataFrame, fields: Sequence[str], bucket_rows: int = 32, bound: int = 16) -> DataFrame:
    """Keys whose states differ between ``a`` and ``b`` (``key`` plus ``fields``, one row per key).

    ``bucket_rows`` is the mean size of a bucket and ``bound`` the first degree
    bound. A bucket of n and m rows is settled at the latest by a bound of n + m.
    """

    def hashed(df: DataFrame) -> DataFrame:
        flags = [x for f in fields for x in (F.col(f).isNull(), F.col(f))]
        return df.select("key", F.xxhash64(F.lit(7), F.col("key").isNull(), "key", *flags).alias("h"))

    rows = durable(hashed(a).withColumn("side", F.lit("a")).unionByName(hashed(b).withColumn("side", F.lit("b"))), "hashes")
    n = rows.count()
    buckets = max(1, -(-n // (2 * bucket_rows)))
    # h is not the bucket's source: both copies' states of a key must meet in one bucket
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(11), F.col("key").isNull(), "key"), F.lit(buckets)))
    todo, solved = None, []
    while True:
        own = rows if todo is None else rows.join(todo, "bucket", "left_semi")

        def sketch(side: str, own: DataFrame = own, d: int = bound) -> DataFrame:
            narrow = own.filter(F.col("side") == side).select("bucket", "h")
            return narrow.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _sketches(it, d), SKETCH)

        both = (
            sketch("a")
            .select("bucket", F.col("n").alias("na"), F.col("evals").alias("ea"))
            .join(sketch("b").select("bucket", F.col("n").alias("nb"), F.col("evals").alias("eb")), "bucket", "full_outer")
            .fillna(0, ["na", "nb"])
        )
        result = durable(both.mapInArrow(lambda it, d=bound: _solve(it, d), SOLVED), "solved")
        solved.append(result.filter("ok AND differs"))
        todo = result.filter(~F.col("ok")).select("bucket")
        if todo.isEmpty():
            break
        bound *= 2
    polys = solved[0]
    for s in solved[1:]:
        polys = polys.unionByName(s)
    coefs = F.when(F.col("side") == "a", F.col("num")).otherwise(F.col("den")).alias("coefs")
    tried = rows.join(polys, "bucket").select("key", "h", coefs)
    return tried.mapInArrow(_roots, T.StructType([rows.schema["key"]])).distinct()


def reconcile(
    a: DataFrame,
    b: DataFrame,
    key: str,
    fields: Mapping[str, Column],
    order: Sequence[str],
    key_expr: Column | None = None,
    bucket_rows: int = 32,
    bound: int = 16,
) -> DataFrame:
    """Every difference of two copies: ``key`` and ``diff``.

    ``fields`` names the compared fields and gives them in a common type; ``order``
    says which of several rows of a key is its state (the greatest). ``diff`` is
    ``only_a`` or ``only_b`` for a key that one copy lacks, else the name of each
    field that differs, a row each; null equals only null. A null key is compared
    like any other, repeated rows count once, further columns are not read, and an
    empty copy makes every key of the other one ``only_``.
    """
    k = F.col(key) if key_expr is None else key_expr
    names = list(fields)

    def rows(df: DataFrame) -> DataFrame:
        """Only what is compared, so that no other column can clash."""
        state = F.struct(*[c.alias(f) for f, c in fields.items()])
        return df.select(k.alias("key"), F.struct(*[F.col(c) for c in order]).alias("ord"), state.alias("state"))

    ra, rb = rows(a), rows(b)
    keys = durable(differing_keys(latest_state(ra, names), latest_state(rb, names), names, bucket_rows, bound), "keys")

    def fetch(own: DataFrame, side: str) -> DataFrame:
        wanted = own.join(keys.select(F.col("key").alias("wanted")), F.col("key").eqNullSafe(F.col("wanted")), "left_semi")
        return latest_state(wanted, names).select(F.col("key").alias(f"key_{side}"), F.struct(*names).alias(side))

    both = fetch(ra, "a").join(fetch(rb, "b"), F.col("key_a").eqNullSafe(F.col("key_b")), "full_outer")
    diffs = F.when(F.col("b").isNull(), F.array(F.lit("only_a"))).when(F.col("a").isNull(), F.array(F.lit("only_b")))
    changed = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])
    found = both.select(F.coalesce("key_a", "key_b").alias(key), diffs.otherwise(F.array_compact(changed)).alias("diff"))
    return found.select(key, F.explode("diff").alias("diff"))


def clean_id(col: Column) -> Column:
    """An id without surrounding blanks and tabs and without leading zeros; a lone zero stays."""
    return F.regexp_replace(F.regexp_replace(col, r"^[ \t]+|[ \t]+$", ""), r"^0+(?=[0-9])", "")


def number(col: str) -> Column:
    """A numeric column as DOUBLE, NaN and minus zero made null and zero."""
    v = F.col(col).cast("double")
    return F.when(~F.isnan(v), v + F.lit(0.0))


def ledger_differences(a: DataFrame, b: DataFrame, bucket_rows: int = 32, bound: int = 16) -> DataFrame:
    """Differences of score and response of two ledgers by ``sample_id``: (sample_id, diff)."""
    fields = {"score": number("score"), "response": F.col("response")}
    return reconcile(a, b, "sample_id", fields, ["written_at", "row_no"], clean_id(F.col("sample_id")), bucket_rows, bound)
