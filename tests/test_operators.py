import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstream.config import SelectionConfig
from keepstream.operators import grid, history, pixels, positions, pruning, ranged, relational, sampling, scoring, selection, windows
from keepstream.streaming import online


def test_running_sum_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i, rng.randrange(5), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v int, cnt string").repartition(7)
    got = {r["i"]: r["run"] for r in ranged.running_sum(df, ["g"], [F.col("i")], "v", "run").collect()}
    acc: dict = {}
    for g, i, v, _ in rows:
        acc[g] = acc.get(g, 0) + v
        assert got[i] == acc[g]


def test_several_sums_and_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(40), i, rng.randrange(9)) for i in range(1200)]
    df = spark.createDataFrame(rows, "g string, v int, i int, w int").repartition(5)
    got = {r["i"]: (r["a"], r["b"]) for r in ranged.running_sum(df, ["g"], [F.col("i")], ["v", "w"], ["a", "b"]).collect()}
    acc: dict = {}
    for g, v, i, w in rows:
        x, y = acc.get(g, (0, 0))
        acc[g] = (x + v, y + w)
        assert got[i] == acc[g]
    order = [F.col("v").desc(), F.col("i")]
    ranked = {r["i"]: r["r"] for r in ranged.group_rank(df, ["g"], order, "r").collect()}
    for g in ("hot", "a", None):
        own = sorted(((-v, i) for a, v, i, _ in rows if a == g))
        assert [ranked[i] for _, i in own] == list(range(1, len(own) + 1))
    top = {r["i"] for r in selection.top_share(df.withColumnRenamed("v", "loss"), ["g"], 0.1, "i").collect()}
    hot = sorted((-v, i) for a, v, i, _ in rows if a == "hot")
    assert {i for _, i in hot[: len(hot) // 10]} <= top and len(top) > 90


def test_running_sum_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert ranged.running_sum(df, ["g"], [F.col("v")], "v", "run").collect() == []


@pytest.mark.parametrize(
    "frames,scored",
    [(2, []), (4, []), (5, []), (8, [1]), (16, [1, 2, 3, 4, 5]), (17, [1, 2, 3, 4, 5, 6]), (20, list(range(1, 8))), (40, list(range(1, 18)))],
)
def test_schedules(spark, frames, scored):
    df = spark.createDataFrame([(frames,)], "t int")
    n = (frames + 1) // 2
    skip = spark.createDataFrame([(frames, int(k)) for k in range(max(0, n - 2), n)], "t int, target bigint")
    got = windows.skip_targets(windows.schedule(df, "t"), skip, ["t"]).orderBy("target").collect()
    assert [r["target"] for r in got] == scored
    assert all(r["length"] == (2 * r["target"] + 2 if r["mode"] == "expanding" else 16) for r in got)


@pytest.mark.parametrize("policy,n,want", [("plugin", 1, ["tail"]), ("compact", 1, ["bootstrap"]), ("plugin", 2, ["tail", "tail"]), ("compact", 2, ["bootstrap", "tail"]), ("plugin", 4, ["bootstrap", "recent", "tail", "tail"])])
def test_tiers_of_short_streams(spark, policy, n, want):
    df = spark.range(n).select(selection.tiers(F.col("id"), F.lit(n), policy=policy).alias("t"))
    assert [r["t"] for r in df.collect()] == want


def test_compact_tail_is_rounded_up(spark):
    cfg = SelectionConfig(tail_keep_frames=3, drop_bootstrap=False)
    tiers = lambda p: [r["t"] for r in spark.range(20).select(selection.tiers(F.col("id"), F.lit(20), cfg, p).alias("t")).collect()]
    assert tiers("plugin").count("tail") == 1 and tiers("compact").count("tail") == 2
    assert tiers("compact")[0] == "old"


def interpreted(rows, n, cfg):
    """The threshold rule, one tubelet after the other."""
    out, history = {}, []
    by: dict = {}
    for t, i, v in rows:
        by.setdefault(t, []).append((i, v))
    for t in sorted(by):
        tail = t >= n - cfg.tail_keep_frames // 2
        recent = t >= n - cfg.recent_frames // 2
        if tail or t == 0:
            out.update({(t, i): tail for i, _ in by[t]})
            continue
        ratio = cfg.recent_keep_ratio if recent else cfg.keep_ratio
        losses = [v for _, v in by[t]]
        source = history if len(history) > cfg.warmup_min else losses
        thr = float(np.quantile(source, round(1 - ratio, 10)))
        out.update({(t, i): v >= thr for i, v in by[t]})
        history += losses
    return out


@pytest.fixture(scope="module")
def patch_rows():
    rng = random.Random(9)
    return [(t, i, rng.randrange(50)) for t in range(30) for i in range(12) if rng.random() > 0.05]


def test_adaptive_threshold(spark, patch_rows):
    df = spark.createDataFrame([("s", *r, 30) for r in patch_rows], "stream string, tubelet bigint, idx int, loss bigint, n int")
    got = {(r["tubelet"], r["idx"]): r["keep"] for r in selection.adaptive_prune(df, ["stream"], "n").collect()}
    assert got == interpreted(patch_rows, 30, SelectionConfig())
    stats = selection.keep_stats(selection.adaptive_prune(df, ["stream"], "n"), ["stream"]).first()
    assert stats["kept_tokens"] + stats["dropped_tokens"] == stats["original_tokens"] == len(patch_rows)


def test_unscored_rows_stay(spark):
    df = spark.createDataFrame([("s", 5, 0, None, 30), ("s", 5, 1, 3, 30)], "stream string, tubelet bigint, idx int, loss bigint, n int")
    got = {r["idx"]: (r["mode"], r["keep"]) for r in selection.adaptive_prune(df, ["stream"], "n").collect()}
    assert got[0] == ("unscored_full_keep", True)


def test_stream_equals_batch(spark, patch_rows, tmp_path):
    schema = "stream string, tubelet bigint, idx int, loss bigint, n_tubelets double"
    for k, (lo, hi) in enumerate([(0, 9), (9, 26), (26, 30)]):
        part = [(s, t, i, v, 30.0 if k == 2 else None) for s in ("a", "b") for t, i, v in patch_rows if lo <= t < hi]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = online.run_to_end(online.online_prune(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    want = interpreted(patch_rows, 30, SelectionConfig())
    for s in ("a", "b"):
        assert {(r["tubelet"], r["idx"]): r["keep"] for r in out.filter(F.col("stream") == s).collect()} == want


def test_history_percentiles():
    rng, values, counts, seen = random.Random(2), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for _ in range(20):
        new = [rng.randrange(-9, 30) for _ in range(rng.randrange(1, 9))]
        values, counts = history.merged(values, counts, np.array(new))
        seen += new
        h = history.Counts(values)
        h.add(np.arange(len(values)), counts)
        for q in (0.0, 0.5, 0.6, 0.9, 1.0):
            assert h.percentile(q) == pytest.approx(float(np.quantile(seen, q)))
            assert history.percentile(np.sort(seen), q) == pytest.approx(float(np.quantile(seen, q)))


def test_slots_of_a_history_are_bounded_and_alike_in_both_engines(spark):
    v = np.array([0, 1, -1, (1 << 22) - 1, 1 << 22, (1 << 22) + 1, -(1 << 23) - 3, 10**12 + 7, (1 << 53) + 1, (1 << 62) + 12345, -(1 << 60) + 1], np.int64)
    cut = history.rounded(v)
    assert (cut[:4] == v[:4]).all() and (np.abs(cut) <= np.abs(v)).all() and (np.abs(v - cut) <= np.abs(v) * 2.0**-21).all()
    assert all(int(abs(x)) >> max(0, int(abs(x)).bit_length() - 22) << max(0, int(abs(x)).bit_length() - 22) == abs(int(x)) for x in cut)
    got = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i int, v bigint").select("i", history.rounded_column(F.col("v")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == cut.tolist()


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_thresholds_of_a_stream_in_parts(spark, patch_rows, chunk):
    """Parts of a stream come to the thresholds of the whole, with large and negative losses."""
    scale = [(t, i, v * 10**6 - 10**7) for t, i, v in patch_rows]
    rows = [("s", *r, 30, "recent" if r[0] > 20 else "old") for r in scale] + [("t", 4, 0, 5, 1, "old")]
    df = spark.createDataFrame(rows, "stream string, tubelet bigint, idx int, loss bigint, n int, tier string").repartition(5)
    cfg = SelectionConfig()
    got = {(r["tubelet"], r["idx"]): (r["keep"], r["mode"]) for r in selection.adaptive_threshold(df, ["stream"], "n", cfg, chunk).filter("stream = 's'").collect()}
    seen: list[int] = []
    for t in sorted({r[0] for r in scale}):
        own = [(i, v) for a, i, v in scale if a == t]
        base = seen if len(seen) > cfg.warmup_min else [v for _, v in own]
        q = 1 - (cfg.recent_keep_ratio if t > 20 else cfg.keep_ratio)
        level = history.percentile(np.sort(history.rounded(np.array(base))), round(q, 10))
        for i, v in own:
            assert got[t, i] == (v >= level, f"scored_{'digest' if len(seen) > cfg.warmup_min else 'local_quantile'}_{'recent' if t > 20 else 'old'}")
        seen += [v for _, v in own]
    assert len(got) == len(scale)


@pytest.mark.parametrize("seed", range(4))
def test_both_histories_give_the_same_thresholds(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 5, 80)
    starts, losses = np.r_[0, np.cumsum(size)[:-1]], rng.integers(-50, 50, size.sum())
    q, values, counts = rng.choice([0.6, 0.9], 80), np.array([-3, 7, 60]), np.array([2, 1, 3])
    listed = history.thresholds(starts, losses, q, values, counts, 20)
    monkeypatch.setattr(history, "FEW", 0)
    counted = history.thresholds(starts, losses, q, values, counts, 20)
    assert (listed[0] == counted[0]).all() and (listed[1] == counted[1]).all() and listed[1].any() and not listed[1].all()


def test_greedy_plan_in_several_batches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 1, 1, 2, 3, 50, 7000 + i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, weight int").repartition(3)
    got = {r["id"]: r["shard"] for r in relational.lpt_shards(df, "weight", ["id"], 4, batch=7).collect()}
    loads, want = [0] * 4, {}
    for i, w in sorted(rows, key=lambda r: (-(r[1] or 0), r[0])):
        at = loads.index(min(loads))
        loads[at] += w or 0
        want[i] = at
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_videos_of_samples(spark, seed):
    rng = random.Random(seed)
    videos = [(b, v, rng.randrange(0, 5)) for b in (1, 2, None) for v in range(30)]
    samples = [(b, s, rng.randrange(0, 12)) for b in (1, 2) for s in range(9)]
    v = spark.createDataFrame(videos, "batch int, video_no int, tokens int").repartition(4)
    s = spark.createDataFrame(samples, "batch int, sample_no int, tokens int").repartition(3)
    got = {(r["batch"], r["video_no"]): r["sample_no"] for r in positions.videos_of_samples(v, s, ["batch"]).collect()}
    want = {}
    for b in (1, 2):
        ends, at = [], 0
        for _, no, n in [x for x in samples if x[0] == b]:
            ends.append((at, at + n, no))
            at += n
        at = 0
        for _, no, n in [x for x in videos if x[0] == b]:
            at += n
            want |= {(b, no): k for lo, hi, k in ends if lo < at <= hi}
    assert got == want
    assert positions.videos_of_samples(v.limit(0), s, ["batch"]).collect() == [] == positions.videos_of_samples(v, s.limit(0), ["batch"]).collect()


def test_too_many_sample_points_are_an_error():
    from keepstream.operators import reconcile

    with pytest.raises(ValueError):
        reconcile.points(reconcile.SPARE + 1)


def test_selections_of_a_small_map(spark):
    rows = [("s", 0, i, i, [5, 1, 9, 9, 2, 7, 3, 8, 0, 4, 6, 9, 1, 1, 2, 3][i]) for i in range(16)]
    df = spark.createDataFrame(rows, "stream string, tubelet bigint, idx int, flat int, loss bigint")
    ids = lambda d: sorted(r["flat"] for r in d.collect())
    assert ids(selection.top_share(df, ["stream"], 0.2)) == [2, 3, 11]
    assert ids(selection.above_mean(df, ["stream"], 1.0)) == [i for i, r in enumerate(rows) if r[4] * 16 > sum(x[4] for x in rows)]
    covered = selection.cell_coverage(df, ["stream"], 4, 0.1, cells=2)
    assert len(ids(covered)) == 4
    assert len(ids(selection.cell_coverage(df, ["stream"], 4, 0.1, cells=2, trim=True))) == 1
    assert ids(selection.hashed_share(df, ["stream"], 0.5)) == ids(selection.hashed_share(df.repartition(3), ["stream"], 0.5))


def test_cells_tile_every_size(spark):
    for size in (3, 4, 5, 7, 16):
        got = [r["c"] for r in spark.range(size).select(selection.cell_of(F.col("id"), size, 4).alias("c")).orderBy("id").collect()]
        g = min(4, size)
        assert got == [next(c for c in range(g) if c * size // g <= x < (c + 1) * size // g) for x in range(size)]


def test_documented_frame_plans(spark):
    df = spark.createDataFrame([(10.0,)], "d double")
    times = lambda mode: [r["time_s"] for r in sampling.time_grid(sampling.clip(df, F.lit(0.0), F.col("d"), F.col("d"), 1.0, 4), mode, 1.0).orderBy("frame_idx").collect()]
    assert times("uniform") == [1.25, 3.75, 6.25, 8.75]
    assert times("recent") == [6.0, 7.0, 8.0, 9.0]
    assert sampling.clip(df, F.lit(0.0), F.lit(5.0), F.col("d"), 1.0).first()["n_frames"] == 5
    assert sampling.clip(df, F.lit(9.9), F.lit(10.0), F.col("d"), 1.0).first()["n_frames"] == 1
    with pytest.raises(ValueError):
        sampling.time_grid(df, "other", 1.0)


def test_sizes(spark):
    h, w = sampling.aspect_resize(F.col("h"), F.col("w"), 32, 512 * 512, 512 * 512)
    got = spark.createDataFrame([(720, 1280), (1000, 1000)], "h int, w int").select(h.alias("h"), w.alias("w")).collect()
    assert [tuple(r) for r in got] == [(384, 672), (512, 512)]
    with pytest.raises(Exception, match="aspect ratio"):
        spark.createDataFrame([(1, 1000)], "h int, w int").select(h.alias("h")).collect()


def test_block_order_is_a_permutation(spark):
    r, c = grid.block_order(F.col("id"), 6, 2)
    got = [tuple(x) for x in spark.range(24).select(r.alias("r"), c.alias("c")).collect()]
    assert got[:5] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2)] and sorted(got) == [(i, j) for i in range(4) for j in range(6)]


def test_bilinear_resize(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (4, 6)).astype(float)
    got = spark.createDataFrame([(img.ravel().tolist(),), (None,), ([1.0],)], "v array<double>").select(pixels.resize(F.col("v"), (4, 6), (8, 3)).alias("p")).collect()
    out = np.zeros((8, 3))
    for y in range(8):
        for x in range(3):
            sy, sx = min(max((y + 0.5) * 4 / 8 - 0.5, 0), 3), min(max((x + 0.5) * 6 / 3 - 0.5, 0), 5)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, 3), min(x0 + 1, 5)
            fy, fx = sy - y0, sx - x0
            out[y, x] = img[y0, x0] * (1 - fy) * (1 - fx) + img[y0, x1] * (1 - fy) * fx + img[y1, x0] * fy * (1 - fx) + img[y1, x1] * fy * fx
    assert got[0]["p"] == np.rint(out).astype(int).ravel().tolist() and got[1]["p"] is None and got[2]["p"] is None


def test_trilinear_keeps_constants(spark):
    rows = [("s", t, h, w, 7.0) for t in range(2) for h in range(4) for w in range(4)]
    df = spark.createDataFrame(rows, "stream string, t int, h int, w int, score double")
    got = grid.trilinear(df, ["stream"], (2, 4, 4), (3, 5, 2)).collect()
    assert len(got) == 30 and all(abs(r["score"] - 7) < 1e-9 for r in got)


def test_scorer_boundary(spark):
    frames = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(8)], "k string, frame_idx int, value array<double>")
    n = spark.createDataFrame([("a", 8)], "k string, t int")
    got = scoring.score_windows(frames, windows.schedule(n, "t"), ["k"], scoring.ContextMean()).orderBy("target").collect()
    assert [r["losses"] for r in got] == [[2.0, 0.0], [3.0, 0.0], [4.0, 0.0]]


def test_sequence_rules(spark):
    rows = [("a", 0, "text", True), ("a", 1, "video", True), ("a", 2, "video", False), ("a", 3, "video", True), ("b", 0, "text", False)]
    seq = spark.createDataFrame(rows, "k string, pos int, kind string, valid boolean")
    kept = spark.createDataFrame([("a", 1), ("a", 1), ("a", 9)], "k string, ordinal int")
    assert sorted((r["k"], r["pos"]) for r in pruning.keep_sequence(seq, kept, ["k"]).collect()) == [("a", 0), ("a", 3)]
    assert [tuple(r) for r in pruning.check_keep(seq, kept, ["k"]).collect()] == [("a", 9)]
    empty = seq.limit(0)
    assert pruning.keep_sequence(empty, kept, ["k"]).count() == 0
    with pytest.raises(ValueError):
        pruning.non_empty(empty)


def test_rope_of_text_is_its_position(spark):
    seq = spark.createDataFrame([("a", i, "text") for i in range(5)], "k string, pos int, kind string")
    none = spark.createDataFrame([], "k string, run bigint, h bigint, w bigint")
    got = positions.rope_index(seq, ["k"], none).orderBy("pos").collect()
    assert [(r["pos_t"], r["pos_h"], r["pos_w"], r["delta"]) for r in got] == [(i, i, i, 0) for i in range(5)]


@pytest.mark.parametrize("shards,n", [(1, 5), (3, 40), (4, 3), (7, 400)])
def test_lpt(spark, shards, n):
    rng = random.Random(n)
    items = [(i, rng.choice([0, 1, 1, 1, 2, 3, 5, 9])) for i in range(n)]
    heap, want = [(0, s) for s in range(shards)], {}
    for i, w in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        want[i] = s
        heapq.heappush(heap, (load + w, s))
    df = spark.createDataFrame(items, "id int, weight int")
    assert {r["id"]: r["shard"] for r in relational.lpt_shards(df, "weight", ["id"], shards).collect()} == want


@pytest.mark.parametrize("n,shards", [(10, 3), (2, 5), (0, 2), (7, 1), (9, 3)])
def test_range_split(spark, n, shards):
    df = spark.range(n)
    got = {r["id"]: r["shard"] for r in relational.range_split(df, [F.col("id")], shards, n).collect()}
    chunk = n // max(1, shards)
    assert got == {i: 0 if shards <= 1 else shards - 1 if not chunk else min(i // chunk, shards - 1) for i in range(n)}


def test_clip_join_at_the_edges(spark):
    f = spark.createDataFrame([("u", t, float(t)) for t in range(0, 50, 5)], "k string, f int, s double")
    ask = spark.createDataFrame([("u", 1, 20.0), ("u", 2, 3.0), ("v", 3, 20.0)], "k string, q int, at double")
    got = sorted((r["q"], r["f"]) for r in relational.clip_join(f, ask, "k", "s", "at", 10.0).collect())
    assert got == [(1, 10), (1, 15), (1, 20), (2, 0)]


def test_config_rules():
    assert SelectionConfig().grid == 16
    for bad in ({"fine_size": 500}, {"keep_ratio": 0.0}, {"score_mode": "x"}):
        with pytest.raises(ValueError):
            SelectionConfig(**bad)
