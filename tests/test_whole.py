"""Small tables on which a cut of the input would show."""

from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstream.config import SelectionConfig
from keepstream.operators import grid
from keepstream.plans import eval_queries, io_queries, selection_queries
from tests.conftest import same_as_sql
from tests.test_operators import interpreted


def write_windows(spark, folder, rows):
    schema = "video_path string, target_frames array<int>, scored_at timestamp, window_no long, total_frames int, patch_loss_16x16 array<double>"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/loss_windows.parquet")


def test_vision_positions_of_long_grids(spark, tmp_path):
    rows = [([[3, 4, 6], [40, 4, 4]],), ([[40, 4, 4], [17, 2, 2]],), (None,)]
    spark.createDataFrame(rows, "video_grid_thw array<array<bigint>>").write.parquet(f"{tmp_path}/run_records.parquet")
    got = Counter(tuple(r) for r in eval_queries.vision_positions(spark, str(tmp_path)).collect())
    want = Counter()
    for t, h, w in ((3, 2, 3), (40, 2, 2), (17, 1, 1)):
        cells = [(a, b, c) for a in range(t) for b in range(h) for c in range(w)]
        want.update((t, h, w, i, a + 10, b + 10, c + 10) for i, (a, b, c) in enumerate(cells))
    assert got == want


def weights(n, m):
    out = np.zeros((m, n))
    for o, i, k in grid.axis_weights(n, m):
        out[o, i] += k
    return out


@pytest.mark.parametrize("n,m", [(1, 1), (2, 5), (8, 6), (9, 7), (121, 91), (130, 98), (40, 6)])
def test_trilinear_of_a_length_held_by_rows(spark, n, m):
    scores = np.random.default_rng(n).integers(1, 1000, (n, 2, 2))
    rows = [("s", n, t, h, w, int(v)) for (t, h, w), v in np.ndenumerate(scores)]
    df = spark.createDataFrame(rows, "stream string, n long, t int, h int, w int, score long")
    got = {(r["t"], r["h"], r["w"]): r["score"] for r in grid.trilinear(df, ["stream"], ("n", 2, 2), (F.lit(m), 3, 1)).collect()}
    want = np.einsum("at,bh,cw,thw->abc", weights(n, m), weights(2, 3), weights(2, 1), scores)
    assert len(got) == want.size and all(abs(got[k] - v) < 1e-6 for k, v in np.ndenumerate(want))


def test_trilinear_scores_of_whole_streams(spark, tmp_path):
    rng, sizes = np.random.default_rng(5), {"a": 3, "b": 21, "c": 8}
    losses = {k: rng.integers(1, 2_000_000, (n, 16, 16)) for k, n in sizes.items()}
    at = datetime(2026, 1, 1)
    rows = [(k, [2 * t, 2 * t + 1], at, t, 2 * n, [float(v) / 1e6 for v in losses[k][t].ravel()]) for k, n in sizes.items() for t in range(n)]
    write_windows(spark, tmp_path, rows)
    got = {(r["stream"], r["t"], r["h"], r["w"]): r["score"] for r in selection_queries.trilinear_scores(spark, str(tmp_path)).collect()}
    size = 0
    for k, n in sizes.items():
        want = np.einsum("at,bh,cw,thw->abc", weights(n, -(-n * 6 // 8)), weights(16, 10), weights(16, 14), losses[k])
        size += want.size
        assert all(abs(got[k, *i] - v) < 0.501 for i, v in np.ndenumerate(want))
    assert len(got) == size


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    """A folder with two streams of 24 tubelets, some of whose losses are null or NaN, arrays short, empty or null; and the known losses."""
    folder, rng, rows, known = str(tmp_path_factory.mktemp("gaps")), np.random.default_rng(9), [], {"a": [], "b": []}
    for s, t in ((s, t) for s in known for t in range(24)):
        losses = [int(v) / 1e6 for v in rng.integers(1, 2_000_000, 256)]
        if s == "a":
            if t % 4 == 1:
                losses[3], losses[200] = None, float("nan")
            losses = {0: None, 5: losses[:7], 12: None, 18: [], 23: None}.get(t, losses)
        known[s] += [(t, i, round(v * 1e6)) for i, v in enumerate(losses or []) if v is not None and v == v]
        rows.append((s, [2 * t, 2 * t + 1], datetime(2026, 1, 1), t, 48, losses))
    write_windows(spark, folder, rows)
    return folder, known


def test_patches_without_a_loss_stay_in_the_masks(spark, gaps):
    folder, known = gaps
    masks = {(r["stream"], r["tubelet"]): r for r in selection_queries.keep_masks(spark, folder).collect()}
    assert len(masks) == 48
    for s in known:
        want = interpreted(known[s], 24, SelectionConfig())
        for t in range(24):
            assert masks[s, t]["mask"] == "".join("1" if want.get((t, i), t > 0) else "0" for i in range(256))
    modes = {t: masks["a", t]["mode"] for t in (0, 5, 12, 18, 23)}
    assert modes == {0: "bootstrap_drop", 5: masks["b", 5]["mode"], 12: "unscored_full_keep", 18: "unscored_full_keep", 23: "protected_tail_full_keep"}


def test_patches_without_a_loss_count_as_tokens(spark, gaps):
    folder, known = gaps
    stats = {r["stream"]: r for r in selection_queries.keep_stats(spark, folder).collect()}
    for s in known:
        want = interpreted(known[s], 24, SelectionConfig())
        kept = sum(want.get((t, i), t > 0) for t in range(24) for i in range(256))
        assert stats[s]["original_tokens"] == 24 * 256 and stats[s]["kept_tokens"] == kept
        assert stats[s]["tubelets_scored"] + stats[s]["tubelets_unscored"] == 24
    assert stats["a"]["tubelets_unscored"] - stats["b"]["tubelets_unscored"] == 2
    total = sum(r["kept_tokens"] for r in stats.values())
    assert eval_queries.compact_memory(spark, folder).count() == total
    frames = eval_queries.mask_to_frames(spark, folder)
    assert frames.count() == 96 and frames.agg(F.sum("kept")).first()[0] == 2 * total
    scored = selection_queries.patches(spark, folder)
    assert scored.count() == sum(map(len, known.values())) and scored.filter("loss IS NULL").isEmpty()


def test_stream_keeps_patches_without_a_loss(spark, gaps):
    batch = selection_queries.adaptive_prune_patches(spark, gaps[0]).groupBy("stream", "tier", "mode").agg(F.sum("cells").alias("cells"), F.sum("kept").alias("kept"))
    got = Counter(tuple(r) for r in io_queries.stream_prune(spark, gaps[0]).collect())
    assert got == Counter(tuple(r) for r in batch.collect()) and sum(r[3] for r in got) == 48 * 256


def write_cache(spark, folder, videos, windows):
    spark.createDataFrame(videos, "video string, num_frames int").coalesce(1).write.parquet(f"{folder}/runs")
    spark.createDataFrame(windows, "video_path string, target_frames array<int>, scored_at timestamp").coalesce(1).write.parquet(f"{folder}/losses")
    for have, name in (("runs", "run_records"), ("losses", "loss_windows")):
        next(folder.glob(f"{have}/part-*.parquet")).rename(folder / f"{name}.parquet")


def test_cache_hits_of_odd_rows_equal_sql(spark, tmp_path):
    at = datetime(2026, 1, 1)
    videos = [("a", 9), ("a", 4), ("b", 1), ("c", 0), ("c", None), (None, 7), ("d", 6), ("e", 20)]
    frames = {"a": ([0, 1], [0, 1], [8, 9], [10, 11], [], None, [None, 3], [-1, 0], [-4, -3]), "b": ([2, 3],), "c": ([0, 1],), None: ([0, 1],), "e": ([6, 7], [7, 8], [18, 19])}
    write_cache(spark, tmp_path, videos, [(v, f, at) for v, each in frames.items() for f in each])
    same_as_sql(spark, tmp_path, eval_queries.cache_hits, eval_queries.oracle_sql()["cache_hits"])


def test_cache_hits_make_no_row_per_requested_tubelet(spark, tmp_path):
    at = datetime(2026, 1, 1)
    write_cache(spark, tmp_path, [("a", 2_000_000_000), ("b", 2**31 - 1)], [("a", [0, 1], at), ("a", [1_999_999_998, 1_999_999_999], at), ("a", [2_000_000_000, 2_000_000_001], at)])
    df = eval_queries.cache_hits(spark, str(tmp_path))
    assert "Generate" not in df._jdf.queryExecution().toString()
    got = {r["video_path"]: (r["requested"], r["hits"], r["misses"]) for r in df.collect()}
    assert got == {"a": (10**9, 2, 10**9 - 2), "b": (2**30, 0, 2**30)}
