"""The boundary to a scoring model, and a deterministic stand-in.

A scorer gets the frames of a window and gives one loss per patch of its last
tubelet. No weights are part of this package: the stand-in predicts each patch of
the last tubelet as the mean of the window's earlier tubelets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """Called in a Python worker, which keeps the object for all its batches."""

    def __call__(self, frames: np.ndarray) -> np.ndarray:
        """Losses (patches,) of the last tubelet of frames (n, patches)."""


class ContextMean:
    """|mean of the last tubelet - mean of all frames before it|; without a past all losses are infinite."""

    def __call__(self, frames: np.ndarray) -> np.ndarray:
        n = 2 if len(frames) % 2 == 0 else 1
        past, last = frames[:-n], frames[-n:]
        return np.full(frames.shape[1], np.inf) if not len(past) else np.abs(last.mean(0) - past.mean(0))


def score_windows(frames: DataFrame, windows: DataFrame, keys: list[str], scorer: Scorer) -> DataFrame:
    """(keys, target, losses) of each window: ``frames`` has keys, frame_idx and value, ``windows`` keys, start, length, target.

    The range join of windows and frames is an equi-join: each window is exploded to
    its at most ``window_frames`` frame numbers. Tiers are to be filtered from
    ``windows`` before, since nothing is pushed through a scorer.
    """
    wanted = windows.withColumn("frame_idx", F.explode(F.expr("sequence(start, start + length - 1)")))
    clips = wanted.join(frames, [*keys, "frame_idx"]).groupBy(*keys, "target").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "value"))).alias("clip"))
    clips = clips.select(*keys, "target", F.transform("clip", lambda c: c["value"]).alias("clip"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([scorer(np.asarray(c, float)).tolist() for c in b.to_pylist()], pa.list_(pa.float64()))

    return clips.withColumn("losses", F.arrow_udf(run, "array<double>")("clip")).drop("clip")
