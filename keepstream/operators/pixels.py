"""Pixel operators: resizing of decoded frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from keepstream.operators.grid import axis_weights


def weights(n_in: int, n_out: int) -> np.ndarray:
    """The matrix of linear resampling along one axis."""
    m = np.zeros((n_out, n_in))
    for o, i, w in axis_weights(n_in, n_out):
        m[o, i] += w
    return m


def resize(pixels: Column, source: tuple[int, int], target: tuple[int, int]) -> Column:
    """Row-major pixel values resized bilinearly with aligned centres, clamped to 0..255 and rounded half to even.

    A null array, or one of another length than the source size, gives null.
    """
    rows, cols = weights(source[0], target[0]), weights(source[1], target[1]).T
    n = source[0] * source[1]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = []
            for v in b.to_pylist():
                if v is None or len(v) != n or any(x is None for x in v):
                    out.append(None)
                else:
                    y = rows @ np.asarray(v, float).reshape(source) @ cols
                    out.append(np.rint(np.clip(y, 0, 255)).astype(np.int16).ravel().tolist())
            yield pa.array(out, pa.list_(pa.int16()))

    return F.arrow_udf(run, "array<smallint>")(pixels)
