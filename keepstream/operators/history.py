"""Thresholds over a stream's history: percentiles of all losses before each tubelet.

The history counts losses at ``BITS`` leading bits: those below 2^22 micro-units in
absolute value (4.19) exactly, larger ones to a relative error of 2^-21. So it has at
most 2^22 slots for losses below 4.19 and 2^21 for every doubling above, however long
the stream, and a batch, a part of a stream and a running stream come to the same
thresholds.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 22
#: Counters summed up as one when a rank is looked for.
BLOCK = 1024
#: Losses of a tubelet, and losses in all, below which a sorted list is the faster history. The thresholds are the same.
FEW, SORTED = 16, 50_000


def rounded(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Integers cut to their leading bits, towards zero; order is kept."""
    size = np.abs(values)
    if not len(size) or size.max() < 1 << bits:
        return values
    # bits of a 64-bit integer, from two halves that a double holds exactly
    length = np.where(size >> 32, np.frexp((size >> 32).astype(float))[1] + 32, np.frexp((size & 0xFFFFFFFF).astype(float))[1])
    drop = np.maximum(0, length - bits)
    return np.sign(values) * ((size >> drop) << drop)


def rounded_column(loss: Column, bits: int = BITS) -> Column:
    """As ``rounded``, of a BIGINT column."""
    size = F.abs(loss)
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - bits)
    cut = F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)
    return F.when(size < (1 << bits), loss).otherwise(F.signum(loss).cast("bigint") * cut)


def merged(values: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A history (sorted distinct values and their counts) with more losses."""
    both, where = np.unique(np.r_[values, rounded(more)], return_inverse=True)
    return both, np.bincount(where, np.r_[counts, np.ones(len(more), np.int64)], len(both)).astype(np.int64)


def interpolated(a: float, b: float, part: float) -> float:
    return float(a) + (float(b) - float(a)) * part


def percentile(values: np.ndarray, q: float) -> float:
    """Linear interpolation between the neighbouring ranks of sorted values."""
    at = q * (len(values) - 1)
    lo = int(np.floor(at))
    return interpolated(values[lo], values[min(lo + 1, len(values) - 1)], at - lo)


class Counts:
    """Counts of values of a known range of values, with ranks found by blocks."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, 0
        self.counts = np.zeros(-(-max(1, len(values)) // BLOCK) * BLOCK, np.int64)
        self.blocks = np.zeros(len(self.counts) // BLOCK, np.int64)

    def add(self, at: np.ndarray, counts: np.ndarray | int = 1) -> None:
        np.add.at(self.counts, at, counts)
        np.add.at(self.blocks, at // BLOCK, counts)
        self.n += int(counts.sum()) if isinstance(counts, np.ndarray) else counts * len(at)

    def ranked(self, rank: int) -> int:
        """The value of a rank, from 0."""
        ends = np.cumsum(self.blocks)
        b = int(np.searchsorted(ends, rank, "right"))
        within = np.cumsum(self.counts[b * BLOCK : (b + 1) * BLOCK])
        return int(self.values[b * BLOCK + int(np.searchsorted(within, rank - (ends[b - 1] if b else 0), "right"))])

    def percentile(self, q: float) -> float:
        at = q * (self.n - 1)
        lo = int(np.floor(at))
        a = self.ranked(lo)
        return float(a) if at == lo else interpolated(a, self.ranked(lo + 1), at - lo)


def _one_by_one(starts: np.ndarray, losses: np.ndarray, q: np.ndarray, before: np.ndarray, warmup: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``thresholds``, by insertion into a sorted list: less work where a tubelet has hardly any losses."""
    held, out, warm = before.tolist(), [], []
    for b, e, part in zip(starts.tolist(), [*starts[1:].tolist(), len(losses)], q.tolist()):
        own = losses[b:e].tolist()
        warm.append(len(held) > warmup)
        source = held if warm[-1] else sorted(own)
        at = part * (len(source) - 1)
        lo = int(at)
        out.append(interpolated(source[lo], source[min(lo + 1, len(source) - 1)], at - lo))
        for x in own:
            insort(held, x)
    return np.array(out), np.array(warm, bool)


def thresholds(
    starts: np.ndarray, losses: np.ndarray, q: np.ndarray, values: np.ndarray, counts: np.ndarray, warmup: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per tubelet its threshold and whether the history gave it.

    ``losses`` are sorted by tubelet, each of which begins at one of ``starts`` and asks
    for the percentile ``q``; ``values`` and ``counts`` are the history before them. With
    more than ``warmup`` losses in the history it decides, else the tubelet's own do. A
    tubelet's losses are counted after its threshold is known.
    """
    small = rounded(losses)
    if len(losses) < FEW * max(1, len(starts)) and len(losses) + counts.sum() < SORTED:
        return _one_by_one(starts, small, q, np.repeat(values, counts), warmup)
    every = np.union1d(values, small)
    history = Counts(every)
    history.add(np.searchsorted(every, values), counts)
    at = np.searchsorted(every, small)
    out, warm = np.zeros(len(starts)), np.zeros(len(starts), bool)
    for k, (b, e) in enumerate(zip(starts, np.r_[starts[1:], len(losses)])):
        warm[k] = history.n > warmup
        out[k] = history.percentile(q[k]) if warm[k] else percentile(np.sort(small[b:e]), q[k])
        history.add(at[b:e])
    return out, warm
