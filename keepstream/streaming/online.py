"""Online pruning: the adaptive threshold as a keyed, stateful stream.

Rows of one stream must come in order of their tubelets across batches; within a
batch any order will do. The state of a stream is the histogram of its scored losses,
whose slots ``operators.history`` bounds whatever the stream's length (losses below
4.19 exactly, larger ones to a relative error of 2^-21), and the rows of the last
tubelets, whose tier is not known until more arrive or the stream is closed. The
histogram is rewritten once a batch, not once a tubelet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstream.config import SelectionConfig
from keepstream.operators.history import merged, thresholds

OUT = "stream string, tubelet bigint, idx int, loss bigint, tier string, mode string, threshold double, keep boolean"
STATE = "losses binary, counts binary, pending binary, tubelets bigint"
#: Stands for a null loss between batches, where all values are 64-bit integers.
MISSING = int(np.iinfo(np.int64).min)


OLD, RECENT, TAIL, BOOTSTRAP = range(4)
TIERS = np.array(["old", "recent", "tail", "bootstrap"], object)
#: By tier: of rows that are not scored, then of scored ones without and with a history.
MODES = np.array(
    ["unscored_full_keep", "unscored_full_keep", "protected_tail_full_keep", "bootstrap_drop", "scored_local_quantile_old", "scored_local_quantile_recent", "scored_digest_old", "scored_digest_recent"],
    object,
)


def decide(rows: pd.DataFrame, tiers: np.ndarray, values: np.ndarray, counts: np.ndarray, cfg: SelectionConfig) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows sorted by tubelet, with tier, mode, threshold and keep, and the losses that enter the history."""
    losses = rows["loss"].to_numpy(np.int64)
    scored = (tiers <= RECENT) & (losses != MISSING)
    mode, keep, level = tiers.copy(), tiers != BOOTSTRAP, np.full(len(rows), np.nan)
    own, tubelet, recent = losses[scored], rows["tubelet"].to_numpy()[scored], tiers[scored] == RECENT
    if len(own):
        starts = np.flatnonzero(np.r_[True, tubelet[1:] != tubelet[:-1]])
        q = np.where(recent[starts], round(1.0 - cfg.recent_keep_ratio, 10), round(1.0 - cfg.keep_ratio, 10))
        found, warm = thresholds(starts, own, q, values, counts, cfg.warmup_min)
        size = np.diff(np.r_[starts, len(own)])
        level[scored] = np.repeat(found, size)
        mode[scored] = 4 + 2 * np.repeat(warm, size) + recent
        keep[scored] = own >= level[scored]
    return rows.assign(tier=TIERS[tiers], mode=MODES[mode], threshold=level, keep=keep), own


def _tiers(tubelet: np.ndarray, n: int, cfg: SelectionConfig) -> np.ndarray:
    tail, recent = cfg.tail_keep_frames // cfg.stride_frames, cfg.recent_frames // cfg.stride_frames
    return np.where(tubelet >= n - tail, TAIL, np.where(tubelet == 0, BOOTSTRAP, np.where(tubelet >= n - recent, RECENT, OLD)))


def online_prune(patches: DataFrame, cfg: SelectionConfig = SelectionConfig()) -> DataFrame:
    """Pruned rows of a streaming DataFrame (stream, tubelet, idx, loss, n_tubelets).

    A tubelet is decided as soon as its tier is sure: when ``recent_frames`` of later
    ones have come, or when the stream's length is known from a row's
    ``n_tubelets``. Rows with a null ``n_tubelets`` belong to a stream that goes on,
    rows without a loss stay kept as unscored, outside the tail and the first tubelet.
    A row whose tubelet was decided before comes too late and is dropped, as a row
    behind a watermark would be.
    """
    horizon = cfg.recent_frames // cfg.stride_frames

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            values, counts, pending, decided = state.get
            values, counts = np.frombuffer(values, np.int64), np.frombuffer(counts, np.int64)
            held = np.frombuffer(pending, np.int64).reshape(-1, 3)
        else:
            values, counts, held, decided = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64), 0
        new = pd.concat([pd.DataFrame(held, columns=["tubelet", "idx", "loss"]), *batches], ignore_index=True)
        new = new[new["tubelet"] >= decided]
        n = new["n_tubelets"].max() if "n_tubelets" in new else np.nan
        closed = not np.isnan(n)
        top = int(n) if closed else int(new["tubelet"].max()) + 1 if len(new) else 0
        sure = top if closed else top - horizon
        rest, ready = new[new["tubelet"] >= sure], new[new["tubelet"] < sure].sort_values(["tubelet", "idx"], ignore_index=True)
        if len(ready):
            tubelet = ready["tubelet"].to_numpy(np.int64)
            done, own = decide(ready, _tiers(tubelet, top if closed else top + 1, cfg), values, counts, cfg)
            values, counts = merged(values, counts, own)
            decided = int(tubelet[-1]) + 1
        state.update((values.tobytes(), counts.tobytes(), rest[["tubelet", "idx", "loss"]].to_numpy(np.int64).tobytes(), decided))
        if len(ready):
            done = done.assign(stream=key[0])
            yield done[["stream", "tubelet", "idx", "loss", "tier", "mode", "threshold", "keep"]].astype({"tubelet": "int64", "idx": "int32", "loss": "int64"})

    narrow = patches.select("stream", "tubelet", "idx", F.coalesce("loss", F.lit(MISSING)).alias("loss"), "n_tubelets")
    out = narrow.groupBy("stream").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
    return out.withColumn("loss", F.nullif("loss", F.lit(MISSING)))


def event_windows(events: DataFrame, time: str, late: str, length: str, group: str, value: str) -> DataFrame:
    """Tumbling event-time counts and sums per group; rows later than ``late`` are left out by the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    by = timed.groupBy(F.window(time, length).alias("w"), group)
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", group, "n", "total")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, into Parquet, and reads the result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
