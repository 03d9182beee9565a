"""Queries of sampling, grids, windows and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepstream.config import SelectionConfig
from keepstream.operators import grid, sampling, selection, windows
from keepstream.operators.ranged import group_rank
from keepstream.plans.registry import Registry, table

q = Registry()
CFG = SelectionConfig()
BUDGET = 16

# ---- frame plans, on the clips of stream_answers


def clips(spark, folder) -> DataFrame:
    a = table(spark, folder, "stream_answers").select("answer_id", "video_start", "video_end").filter("video_end IS NOT NULL").distinct()
    a = a.withColumn("source_fps", F.lit(24.0) + F.col("answer_id") % 7)
    return a.withColumn("total", F.floor(F.col("video_end") * F.col("source_fps")) + 1)


_CLIPS = """clips AS (
  SELECT *, CAST(floor(video_end * source_fps) AS BIGINT) + 1 AS total
  FROM (SELECT DISTINCT answer_id, video_start, video_end, 24.0::DOUBLE + answer_id % 7 AS source_fps FROM stream_answers WHERE video_end IS NOT NULL) c)"""
_GRID = f"""WITH {_CLIPS},
clipped AS (
  SELECT *, greatest(0.0::DOUBLE, coalesce(video_start, 0.0::DOUBLE)) AS s, least(video_end, video_end) AS e FROM clips),
counted AS (SELECT *, least({BUDGET}, greatest(1, CAST(trunc((e - s) * 1.0) AS INT))) AS n FROM clipped),
frames AS (SELECT *, unnest(range(n)) AS i FROM counted)"""
_TIMES = {
    "full": "s + i / 1.0::DOUBLE",
    "recent": "e - (n - i) / 1.0::DOUBLE",
    "uniform": "s + (i + 0.5::DOUBLE) * (e - s) / n",
}


def frame_plan(mode):
    def run(spark, folder):
        c = sampling.clip(clips(spark, folder), F.col("video_start"), F.col("video_end"), F.col("video_end"), 1.0, BUDGET)
        rows = sampling.time_grid(c, mode, 1.0)
        return rows.select("answer_id", "frame_idx", "time_s", sampling.source_index(F.col("time_s"), F.col("source_fps"), F.col("total")).alias("source_index"))

    return run


for _mode, _expr in _TIMES.items():
    q.add(
        f"frame_plan_{_mode}",
        frame_plan(_mode),
        f"""{_GRID} SELECT answer_id, i AS frame_idx, time_s, least(total - 1, greatest(0, CAST(round_even(time_s * source_fps, 0) AS BIGINT))) AS source_index
FROM (SELECT *, {_expr} AS time_s FROM frames)""",
    )


@q(
    f"""{_GRID}, timed AS (SELECT *, s + i / 1.0::DOUBLE AS time_s FROM frames)
SELECT answer_id, video_end AS duration_s, count(*) AS frames, min(time_s) AS start_s, max(time_s) + 1.0::DOUBLE AS end_s,
       greatest(1, (count(*) + 1) // 2) AS tubelets, CASE WHEN video_end > 0 THEN count(*) / (video_end * 1.0::DOUBLE) ELSE 1.0 END AS coverage
FROM timed GROUP BY answer_id, video_end"""
)
def frame_plan_metrics(spark, folder):
    c = sampling.clip(clips(spark, folder), F.col("video_start"), F.col("video_end"), F.col("video_end"), 1.0, BUDGET)
    rows = sampling.time_grid(c, "full", 1.0).withColumnRenamed("video_end", "duration_s")
    return sampling.plan_metrics(rows, ["answer_id"], "duration_s", 1.0)


def streams(spark, folder) -> DataFrame:
    """Distinct sampled lengths of run_records."""
    return table(spark, folder, "run_records").select("num_frames").filter("num_frames > 0").distinct()


_STREAMS = "streams AS (SELECT DISTINCT num_frames FROM run_records WHERE num_frames > 0)"


def budget_plan(mode):
    def run(spark, folder):
        return sampling.budget_plan(streams(spark, folder), "num_frames", mode, 24).select("num_frames", "ordinal", "grid_idx", "truncated")

    return run


for _mode, _expr in {
    "full": "i",
    "tail": "num_frames - n + i",
    "first": "i",
    "uniform": "least(num_frames - 1, CAST(trunc(i * (num_frames / n::DOUBLE)) AS INT))",
}.items():
    _n = "num_frames" if _mode == "full" else "least(24, num_frames)"
    q.add(
        f"budget_plan_{_mode}",
        budget_plan(_mode),
        f"""WITH {_STREAMS} SELECT num_frames, i AS ordinal, {_expr} AS grid_idx, n < num_frames AS truncated
FROM (SELECT num_frames, n, unnest(range(n)) AS i FROM (SELECT num_frames, {_n} AS n FROM streams))""",
    )


@q(f"WITH {_STREAMS} SELECT num_frames, unnest(range(0, num_frames - 15, 2)) AS start FROM streams WHERE num_frames >= 16")
def fixed_window_starts(spark, folder):
    return sampling.window_starts(streams(spark, folder), "num_frames").select("num_frames", "start")


@q(
    f"""WITH {_CLIPS}, counted AS (SELECT *, least(greatest(4, least(CAST(trunc(video_end * 0.1::DOUBLE) AS INT), 256)), 100000) AS n0 FROM clips),
evened AS (SELECT *, greatest(2, least(n0 - n0 % 2, total)) AS n FROM counted)
SELECT answer_id, i, CAST(round_even(i * ((total - 1) / greatest(1, n - 1)::DOUBLE), 0) AS BIGINT) AS index
FROM (SELECT *, unnest(range(n)) AS i FROM evened)"""
)
def even_count_frames(spark, folder):
    n = sampling.even_count(F.col("video_end"), F.col("total"), 0.1)
    return sampling.linspace(clips(spark, folder), F.col("total"), n).select("answer_id", "i", "index")


@q(
    f"""WITH {_CLIPS}, counted AS (SELECT *, least(greatest(CAST(trunc(total / source_fps * 0.05::DOUBLE) AS BIGINT), 4), 768, total) AS n FROM clips)
SELECT answer_id, i, CAST(round_even(i * ((total - 1) / greatest(1, n - 1)::DOUBLE), 0) AS BIGINT) AS index FROM (SELECT *, unnest(range(n)) AS i FROM counted)"""
)
def processor_frames(spark, folder):
    n = sampling.processor_count(F.col("total"), F.col("source_fps"), fps=0.05)
    return sampling.linspace(clips(spark, folder), F.col("total"), n).select("answer_id", "i", "index")


@q(
    f"""WITH {_CLIPS} SELECT answer_id, i, least(total - 1, greatest(0, CAST(round_even((video_start + 50 + i / 1.0::DOUBLE) * source_fps, 0) AS BIGINT))) AS index
FROM (SELECT *, unnest(range(16)) AS i FROM clips WHERE video_start IS NOT NULL)"""
)
def clamped_windows(spark, folder):
    c = clips(spark, folder).filter("video_start IS NOT NULL")
    return sampling.clamped_window(c, F.col("video_start") + 50, F.col("source_fps"), F.col("total"), 16).select("answer_id", "i", "index")


# ---- sizes, on made-up heights and widths of part


def sizes(spark, folder) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select("p_partkey", (F.lit(64) + F.col("p_partkey") * 7 % 2000).alias("h"), (F.lit(64) + F.col("p_partkey") * 13 % 1500).alias("w"))


_SIZES = "sizes AS (SELECT p_partkey, 64 + p_partkey * 7 % 2000 AS h, 64 + p_partkey * 13 % 1500 AS w FROM part)"


def _aspect_sql(least: int, most: int, factor: int = 32) -> str:
    side = "CASE WHEN hb * wb > {most} THEN greatest({f}, CAST(floor(({x} / sqrt((h * w) / {most}::DOUBLE)) / {f}::DOUBLE) AS BIGINT) * {f}) WHEN hb * wb < {least} THEN CAST(ceil(({x} * sqrt({least} / (h * w)::DOUBLE)) / {f}::DOUBLE) AS BIGINT) * {f} ELSE {bar} END"
    fh, fw = (side.format(most=most, least=least, f=factor, x=x, bar=b) for x, b in (("h", "hb"), ("w", "wb")))
    return f"""WITH {_SIZES}, bars AS (
  SELECT *, greatest({factor}, CAST(round_even(h / {factor}::DOUBLE, 0) AS BIGINT) * {factor}) AS hb, greatest({factor}, CAST(round_even(w / {factor}::DOUBLE, 0) AS BIGINT) * {factor}) AS wb FROM sizes)
SELECT p_partkey, {fh} AS new_h, {fw} AS new_w FROM bars"""


@q(_aspect_sql(256 * 256, 768 * 768))
def aspect_resize(spark, folder):
    h, w = sampling.aspect_resize(F.col("h"), F.col("w"), 32, 256 * 256, 768 * 768)
    return sizes(spark, folder).select("p_partkey", h.alias("new_h"), w.alias("new_w"))


@q(
    f"""SELECT p_partkey, new_h AS fine_h, new_w AS fine_w, new_h // 2 AS coarse_h, new_w // 2 AS coarse_w FROM ({_aspect_sql(512 * 512, 512 * 512)})"""
)
def aligned_sizes(spark, folder):
    names = ("fine_h", "fine_w", "coarse_h", "coarse_w")
    cols = sampling.aligned_sizes(F.col("h"), F.col("w"))
    return sizes(spark, folder).select("p_partkey", *[c.alias(n) for c, n in zip(cols, names)])


@q(
    f"""WITH {_SIZES}, bars AS (
  SELECT *, 8 + p_partkey % 200 AS n, CAST(round_even(h / 32.0::DOUBLE, 0) AS BIGINT) * 32 AS hb, CAST(round_even(w / 32.0::DOUBLE, 0) AS BIGINT) * 32 AS wb FROM sizes),
vols AS (SELECT *, CAST(ceil(n / 2.0::DOUBLE) AS BIGINT) * 2 * hb * wb AS padded, n * h * w AS vol FROM bars)
SELECT p_partkey,
  CASE WHEN padded > 12582912 THEN greatest(32, CAST(floor(h / sqrt(vol / 12582912::DOUBLE) / 32.0::DOUBLE) AS BIGINT) * 32) WHEN padded < 16384 THEN CAST(ceil(h * sqrt(16384 / vol::DOUBLE) / 32.0::DOUBLE) AS BIGINT) * 32 ELSE hb END AS new_h,
  CASE WHEN padded > 12582912 THEN greatest(32, CAST(floor(w / sqrt(vol / 12582912::DOUBLE) / 32.0::DOUBLE) AS BIGINT) * 32) WHEN padded < 16384 THEN CAST(ceil(w * sqrt(16384 / vol::DOUBLE) / 32.0::DOUBLE) AS BIGINT) * 32 ELSE wb END AS new_w
FROM vols"""
)
def video_resize(spark, folder):
    h, w = sampling.video_resize(F.lit(8) + F.col("p_partkey") % 200, F.col("h"), F.col("w"))
    return sizes(spark, folder).select("p_partkey", h.alias("new_h"), w.alias("new_w"))


# ---- grids


@q(
    """SELECT r_regionkey, t, k, br * 2 + (k % 4) // 2 AS row, bc * 2 + (k % 4) % 2 AS col, t * 2 AS first_frame, least(t * 2 + 1, n - 1) AS last_frame
FROM (SELECT *, (k // 4) // (w // 2) AS br, (k // 4) % (w // 2) AS bc FROM
  (SELECT *, unnest(range(h * w)) AS k FROM (SELECT r_regionkey, n, h, w, unnest(range((n + 1) // 2)) AS t FROM
    (SELECT r_regionkey, 5 + r_regionkey AS n, 8 + 2 * r_regionkey AS h, 12 - 2 * r_regionkey AS w FROM region))))"""
)
def patch_order(spark, folder):
    r = table(spark, folder, "region")
    g = r.select("r_regionkey", (F.col("r_regionkey") + 5).alias("n"), (F.col("r_regionkey") * 2 + 8).alias("h"), (F.lit(12) - F.col("r_regionkey") * 2).alias("w"))
    return grid.patches(g, "n", "h", "w").select("r_regionkey", "t", "k", "row", "col", "first_frame", "last_frame")


@q(
    f"""{_GRID}, timed AS (SELECT *, s + i / 1.0::DOUBLE AS time_s FROM frames)
SELECT answer_id, i // 2 AS tubelet, count(*) AS frames, (min(time_s) + max(time_s)) / 2 AS timestamp_s FROM timed GROUP BY answer_id, i // 2"""
)
def tubelet_timestamps(spark, folder):
    c = sampling.clip(clips(spark, folder), F.col("video_start"), F.col("video_end"), F.col("video_end"), 1.0, BUDGET)
    return grid.tubelet_times(sampling.time_grid(c, "full", 1.0), ["answer_id"])


@q(
    f"""{_GRID}, timed AS (SELECT *, s + i / 1.0::DOUBLE AS time_s FROM frames),
tubes AS (SELECT answer_id, i // 2 AS tubelet, CAST(round_even((min(time_s) + max(time_s)) / 2 * 10, 0) AS BIGINT) AS tenths FROM timed GROUP BY answer_id, i // 2)
SELECT answer_id, string_agg('<' || (tenths // 10) || '.' || (tenths % 10) || ' seconds><|vision_start|>' || repeat('<|video_pad|>', CAST((answer_id + tubelet) % 3 AS INT)) || '<|vision_end|>', '' ORDER BY tubelet) AS text
FROM tubes GROUP BY answer_id"""
)
def placeholder_text(spark, folder):
    t = tubelet_timestamps(spark, folder).withColumn("kept", (F.col("answer_id") + F.col("tubelet")) % 3)
    return grid.placeholder(t, ["answer_id"])


@q(
    """SELECT method, predictmem_runtime, count(*) AS records, sum(coalesce(list_sum([g[1] * g[2] * g[3] for g in video_grid_thw]), 0))::BIGINT AS raw_tokens,
       sum(coalesce(list_sum([g[1] * (g[2] // 2) * (g[3] // 2) for g in video_grid_thw]), 0))::BIGINT AS merged_tokens
FROM (SELECT DISTINCT record_id, method, predictmem_runtime, video_grid_thw FROM run_records) GROUP BY method, predictmem_runtime"""
)
def token_counts(spark, folder):
    r = table(spark, folder, "run_records").select("record_id", "method", "predictmem_runtime", "video_grid_thw").distinct()
    g = F.col("video_grid_thw")
    return r.groupBy("method", "predictmem_runtime").agg(
        F.count(F.lit(1)).alias("records"), F.sum(grid.token_count(g)).alias("raw_tokens"), F.sum(grid.token_count(g, 2)).alias("merged_tokens")
    )


@q(
    """SELECT DISTINCT record_id, expected_video_tokens, actual FROM (
  SELECT record_id, expected_video_tokens, coalesce(list_sum([g[1] * g[2] * g[3] for g in video_grid_thw]), 0)::BIGINT AS actual FROM run_records)
WHERE expected_video_tokens IS DISTINCT FROM actual"""
)
def token_count_check(spark, folder):
    r = table(spark, folder, "run_records")
    bad = grid.count_mismatch(r, "expected_video_tokens", grid.token_count(F.col("video_grid_thw")))
    return bad.select("record_id", "expected_video_tokens", "actual").distinct()


@q(
    """SELECT gh, gw, count(*) AS records, (gh = 16 AND gw = 16) AS aligned FROM (
  SELECT DISTINCT record_id, g[2] AS gh, g[3] AS gw FROM (SELECT record_id, unnest(video_grid_thw) AS g FROM run_records)) GROUP BY gh, gw"""
)
def grid_alignment(spark, folder):
    g = table(spark, folder, "run_records").select("record_id", F.explode("video_grid_thw").alias("g")).select("record_id", F.col("g")[1].alias("gh"), F.col("g")[2].alias("gw"))
    n = g.distinct().groupBy("gh", "gw").agg(F.count(F.lit(1)).alias("records"))
    same = grid.grids_align((F.col("gh"), F.col("gw")), (F.lit(32), F.lit(32)))
    return n.withColumn("aligned", same)


@q(
    """WITH grids AS (SELECT DISTINCT video_grid_thw FROM run_records WHERE video_grid_thw IS NOT NULL),
each AS (SELECT video_grid_thw, unnest(range(len(video_grid_thw))) AS video_no FROM grids)
SELECT video_no, g[1] AS t, g[2] AS h, g[3] AS w, unnest(range(g[1])) AS step FROM (SELECT video_no, video_grid_thw[video_no + 1] AS g FROM each)"""
)
def grid_steps(spark, folder):
    g = table(spark, folder, "run_records").select("video_grid_thw").filter("video_grid_thw IS NOT NULL").distinct()
    s = grid.split_steps(g.withColumn("whole", F.col("video_grid_thw")), "video_grid_thw")
    t = F.get("whole", F.col("video_no"))[0]
    return s.select("video_no", t.alias("t"), F.col("grid")[1].alias("h"), F.col("grid")[2].alias("w"), "step")


@q(
    """SELECT i AS source, least((i // 256) * 4 // 8, 3) * 126 + least(((i % 256) // 16) * 9 // 16, 8) * 14 + least((i % 16) * 14 // 16, 13) AS target,
       i // 256 AS t, (i % 256) // 16 AS h, i % 16 AS w FROM (SELECT unnest(range(2048)) AS i)"""
)
def grid_index_map(spark, folder):
    i = F.col("id")
    t, h, w = grid.from_flat(i, 16, 16)
    return spark.range(2048).select(i.alias("source"), grid.map_index(i, (8, 16, 16), (4, 9, 14)).alias("target"), t.alias("t"), h.alias("h"), w.alias("w"))


@q(
    """SELECT r_regionkey, r, c, n, cell, weight FROM (
  SELECT *, floor(y)::INT AS y0, floor(x)::INT AS x0, least(floor(y)::INT + 1, 15) AS y1, least(floor(x)::INT + 1, 15) AS x1 FROM (
    SELECT r_regionkey, r, c, r * (15.0::DOUBLE / greatest(1, h - 1)) AS y, c * (15.0::DOUBLE / greatest(1, w - 1)) AS x FROM (
      SELECT *, unnest(range(w)) AS c FROM (SELECT r_regionkey, 5 + r_regionkey AS h, 9 - r_regionkey AS w, unnest(range(5 + r_regionkey)) AS r FROM region)))) g,
LATERAL (VALUES (0, y0 * 16 + x0, (1 - (y - y0)) * (1 - (x - x0))), (1, y0 * 16 + x1, (1 - (y - y0)) * (x - x0)),
                (2, y1 * 16 + x0, (y - y0) * (1 - (x - x0))), (3, y1 * 16 + x1, (y - y0) * (x - x0))) v(n, cell, weight)"""
)
def position_neighbours(spark, folder):
    g = table(spark, folder, "region").select("r_regionkey", (F.col("r_regionkey") + 5).alias("h"), (F.lit(9) - F.col("r_regionkey")).alias("w"))
    return grid.position_neighbours(g, "h", "w", 16).select("r_regionkey", "r", "c", "n", "cell", "weight")


@q("""SELECT label, CAST(round_even(sum(round_even((v / 255.0::DOUBLE - 0.5::DOUBLE) / 0.25::DOUBLE * 1e9, 0)), 0) AS BIGINT) AS total_nano
FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label""")
def normalised_pixels(spark, folder):
    e = table(spark, folder, "embeddings").select("label", grid.normalise(F.col("embedding").cast("array<double>"), 0.5, 0.25).alias("v"))
    return e.select("label", F.explode("v").alias("v")).groupBy("label").agg(F.rint(F.sum(F.rint(F.col("v") * 1e9))).cast("bigint").alias("total_nano"))


# ---- losses of loss_windows as patches: stream, tubelet, idx, flat, loss


def patches(spark, folder, whole: bool = False) -> DataFrame:
    """The patches that have a loss; ``whole`` has all 256 of each window, with a null loss where there is none."""
    w = table(spark, folder, "loss_windows")
    last = w.groupBy("video_path", "target_frames").agg(F.max(F.struct("scored_at", "window_no", "patch_loss_16x16", "total_frames")).alias("s"))
    losses = F.col("s.patch_loss_16x16")
    if whole:
        known = F.coalesce(losses, F.array().cast("array<double>"))
        losses = F.concat(known, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), 256 - F.size(known))))
    rows = last.select(
        F.col("video_path").alias("stream"),
        grid.div(F.col("target_frames")[0], 2).alias("tubelet"),
        grid.div(F.col("s.total_frames") + 1, 2).alias("n_tubelets"),
        F.posexplode(losses).alias("idx", "raw"),
    )
    has = F.col("raw").isNotNull() & ~F.isnan("raw")
    rows = rows.withColumn("raw", F.when(has, F.col("raw"))) if whole else rows.filter(has)
    return rows.select("stream", "tubelet", "n_tubelets", "idx", (F.col("tubelet") * 256 + F.col("idx")).alias("flat"), F.rint(F.col("raw") * 1e6).cast("bigint").alias("loss"))


_PATCHES = """once AS (
  SELECT video_path AS stream, target_frames[1] // 2 AS tubelet, (total_frames + 1) // 2 AS n_tubelets, patch_loss_16x16 AS l,
         row_number() OVER (PARTITION BY video_path, target_frames ORDER BY scored_at DESC NULLS LAST, window_no DESC NULLS LAST) AS rn FROM loss_windows),
numbered AS (SELECT stream, tubelet, n_tubelets, l, unnest(range(1, len(l) + 1)) AS i FROM once WHERE rn = 1),
patches AS (
  SELECT stream, tubelet, n_tubelets, i - 1 AS idx, tubelet * 256 + i - 1 AS flat, CAST(round_even(l[i] * 1e6, 0) AS BIGINT) AS loss
  FROM numbered WHERE l[i] IS NOT NULL AND NOT isnan(l[i]))"""
#: As ``_PATCHES``, with all 256 cells of each window and a null loss where there is none.
_WHOLE = """once AS (
  SELECT video_path AS stream, target_frames[1] // 2 AS tubelet, (total_frames + 1) // 2 AS n_tubelets, patch_loss_16x16 AS l,
         row_number() OVER (PARTITION BY video_path, target_frames ORDER BY scored_at DESC NULLS LAST, window_no DESC NULLS LAST) AS rn FROM loss_windows),
numbered AS (SELECT stream, tubelet, n_tubelets, l, unnest(range(1, greatest(256, coalesce(len(l), 0)) + 1)) AS i FROM once WHERE rn = 1),
patches AS (
  SELECT stream, tubelet, n_tubelets, i - 1 AS idx, tubelet * 256 + i - 1 AS flat,
         CASE WHEN l[i] IS NOT NULL AND NOT isnan(l[i]) THEN CAST(round_even(l[i] * 1e6, 0) AS BIGINT) END AS loss FROM numbered)"""
_TIER = {
    "plugin": "CASE WHEN {t} >= {n} - 2 THEN 'tail' WHEN {t} = 0 THEN 'bootstrap' WHEN {t} >= {n} - 16 THEN 'recent' ELSE 'old' END",
    "compact": "CASE WHEN {t} = 0 THEN 'bootstrap' WHEN {t} >= {n} - 2 THEN 'tail' WHEN {t} >= {n} - 16 THEN 'recent' ELSE 'old' END",
}


def tier_policy(policy):
    def run(spark, folder):
        s = streams(spark, folder).withColumn("n", grid.div(F.col("num_frames") + 1, 2)).withColumn("tubelet", F.explode(F.expr("sequence(0, n - 1)")))
        return s.withColumn("tier", selection.tiers(F.col("tubelet"), F.col("n"), CFG, policy)).select("num_frames", "tubelet", "tier")

    return run


for _policy, _expr in _TIER.items():
    q.add(
        f"tier_policy_{_policy}",
        tier_policy(_policy),
        f"WITH {_STREAMS} SELECT num_frames, tubelet, {_expr.format(t='tubelet', n='n')} AS tier FROM (SELECT num_frames, (num_frames + 1) // 2 AS n, unnest(range((num_frames + 1) // 2)) AS tubelet FROM streams)",
    )


@q(
    f"""WITH {_STREAMS}, spec AS (
  SELECT num_frames, 0 AS start, e + 1 AS length, e // 2 AS target, 'expanding' AS mode FROM (SELECT num_frames, unnest(range(3, least(16, num_frames), 2)) AS e FROM streams)
  UNION ALL SELECT num_frames, s, 16, s // 2 + 7, 'sliding' FROM (SELECT num_frames, unnest(range(2, num_frames - 15, 2)) AS s FROM streams WHERE num_frames >= 18))
SELECT * FROM spec WHERE target < (num_frames + 1) // 2 - 2"""
)
def window_schedule(spark, folder):
    s = streams(spark, folder)
    w = windows.schedule(s, "num_frames", CFG.window_frames, CFG.stride_frames)
    n = grid.div(F.col("num_frames") + 1, 2)
    tail = s.select("num_frames", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), n - 2), n - 1)).alias("target"))
    return windows.skip_targets(w, tail, ["num_frames"]).select("num_frames", "start", "length", "target", "mode")


@q(
    f"""WITH {_STREAMS}, f AS (SELECT num_frames, unnest(range(num_frames)) AS frame_idx FROM streams)
SELECT num_frames, frame_idx, greatest(0, frame_idx - 15) AS oldest, least(16, frame_idx + 1) AS held, frame_idx + 1 < 4 AS keep_all FROM f"""
)
def frame_ring(spark, folder):
    f = streams(spark, folder).withColumn("frame_idx", F.explode(F.expr("sequence(0, num_frames - 1)")))
    return windows.ring(f, ["num_frames"]).select("num_frames", "frame_idx", "oldest", "held", "keep_all")


# ---- surrogate losses, on embeddings


def cells(spark, folder) -> DataFrame:
    """Sums and counts of micro-units per label, patch and tubelet."""
    e = table(spark, folder, "embeddings").select("label", "vec_id", "embedding").filter("label IS NOT NULL AND vec_id IS NOT NULL")
    # numbered before the explode, and by ranges: a label may hold any part of the rows
    e = group_rank(e, ["label"], [F.col("vec_id")], "frame").withColumn("frame", F.col("frame") - 1)
    v = e.select("label", grid.div(F.col("frame"), 2).alias("tubelet"), F.posexplode("embedding").alias("patch", "v"))
    micro = F.rint(F.col("v").cast("double") * 1e6).cast("bigint")
    return v.groupBy("label", "patch", "tubelet").agg(F.sum(micro).alias("total"), F.count(micro).alias("n"))


_CELLS = """framed AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 2 AS tubelet, embedding FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL),
vals AS (SELECT label, tubelet, i - 1 AS patch, CAST(round_even(CAST(embedding[i] AS DOUBLE) * 1e6, 0) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM framed)),
cells AS (SELECT label, patch, tubelet, CAST(sum(v) AS BIGINT) AS total, count(v) AS n FROM vals GROUP BY label, patch, tubelet)"""
_CONTEXT = f"""WITH {_CELLS}, ctx AS (
  SELECT *, CAST(sum(total) OVER w AS BIGINT) AS s, CAST(sum(n) OVER w AS BIGINT) AS c FROM cells
  WINDOW w AS (PARTITION BY label, patch ORDER BY tubelet RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
losses AS (SELECT label, patch, tubelet, CAST(round_even(abs(total / n - s / c), 0) AS BIGINT) AS loss FROM ctx)"""


@q(f"{_CONTEXT} SELECT label, patch, tubelet, loss FROM losses")
def context_losses(spark, folder):
    return windows.context_losses(cells(spark, folder), ["label"], 7).select("label", "patch", "tubelet", "loss")


@q(
    f"""WITH {_CELLS}, ctx AS (SELECT *, CAST(sum(total) OVER w AS BIGINT) - total AS s, CAST(sum(n) OVER w AS BIGINT) - n AS c FROM cells WINDOW w AS (PARTITION BY label, patch))
SELECT label, patch, tubelet, CASE WHEN c > 0 THEN CAST(round_even(abs(total / n - s / c), 0) AS BIGINT) END AS loss FROM ctx"""
)
def surround_losses(spark, folder):
    return windows.surround_losses(cells(spark, folder), ["label"]).select("label", "patch", "tubelet", "loss")


def pruned_embeddings(spark, folder) -> DataFrame:
    losses = windows.context_losses(cells(spark, folder), ["label"], 7)
    n = losses.groupBy("label").agg((F.max("tubelet") + 1).alias("n_tubelets"))
    # one row per stream: Spark broadcasts it while it is small, and shuffles it otherwise
    rows = losses.join(n, "label").withColumnRenamed("patch", "idx")
    return selection.adaptive_prune(rows, ["label"], "n_tubelets", CFG)


def _prune_sql(source: str, key: str, idx: str) -> str:
    return f"""tiered AS (SELECT *, {_TIER['plugin'].format(t='tubelet', n='n_tubelets')} AS tier FROM {source}),
scored AS (SELECT * FROM tiered WHERE tier IN ('recent', 'old') AND loss IS NOT NULL),
hist AS (
  SELECT *, count(loss) OVER p AS n_prior, quantile_cont(loss, 0.9) OVER p AS p_old, quantile_cont(loss, 0.6) OVER p AS p_recent,
         quantile_cont(loss, 0.9) OVER (PARTITION BY {key}, tubelet) AS l_old, quantile_cont(loss, 0.6) OVER (PARTITION BY {key}, tubelet) AS l_recent
  FROM scored WINDOW p AS (PARTITION BY {key} ORDER BY tubelet RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pruned AS (
  SELECT {key}, tubelet, {idx} AS idx, tier, CASE WHEN n_prior > 100 THEN 'scored_digest_' ELSE 'scored_local_quantile_' END || tier AS mode,
         loss >= CASE WHEN n_prior > 100 THEN CASE WHEN tier = 'recent' THEN p_recent ELSE p_old END ELSE CASE WHEN tier = 'recent' THEN l_recent ELSE l_old END END AS keep
  FROM hist
  UNION ALL
  SELECT {key}, tubelet, {idx}, tier, CASE tier WHEN 'bootstrap' THEN 'bootstrap_drop' WHEN 'tail' THEN 'protected_tail_full_keep' ELSE 'unscored_full_keep' END, tier <> 'bootstrap'
  FROM tiered WHERE NOT (tier IN ('recent', 'old') AND loss IS NOT NULL))"""


_PRUNED_EMB = f"""{_CONTEXT}, sized AS (SELECT *, max(tubelet) OVER (PARTITION BY label) + 1 AS n_tubelets FROM losses), {_prune_sql("sized", "label", "patch")}"""
_PRUNED = f"WITH {_WHOLE}, {_prune_sql('patches', 'stream', 'idx')}"


@q(f"{_PRUNED_EMB} SELECT label, mode, count(*) AS cells, count_if(keep) AS kept FROM pruned GROUP BY label, mode")
def adaptive_prune_embeddings(spark, folder):
    return pruned_embeddings(spark, folder).groupBy("label", "mode").agg(F.count(F.lit(1)).alias("cells"), F.count_if("keep").alias("kept"))


def pruned_patches(spark, folder) -> DataFrame:
    return selection.adaptive_prune(patches(spark, folder, whole=True), ["stream"], "n_tubelets", CFG)


@q(f"{_PRUNED} SELECT stream, tubelet, tier, mode, count(*) AS cells, count_if(keep) AS kept FROM pruned GROUP BY stream, tubelet, tier, mode")
def adaptive_prune_patches(spark, folder):
    return pruned_patches(spark, folder).groupBy("stream", "tubelet", "tier", "mode").agg(F.count(F.lit(1)).alias("cells"), F.count_if("keep").alias("kept"))


_LISTS = {
    "scored": "starts_with(mode, 'scored')",
    "dropped_bootstrap": "tier = 'bootstrap'",
    "full_keep_tail": "tier = 'tail'",
    "recent": "tier = 'recent'",
}


@q(
    f"""{_PRUNED} SELECT stream, count(*) AS original_tokens, count_if(keep) AS kept_tokens, count_if(NOT keep) AS dropped_tokens,
       count_if(keep) / count(*) AS keep_ratio_actual,
       count(DISTINCT CASE WHEN starts_with(mode, 'scored') THEN tubelet END) AS tubelets_scored,
       count(DISTINCT tubelet) - count(DISTINCT CASE WHEN starts_with(mode, 'scored') THEN tubelet END) AS tubelets_unscored,
       {', '.join(f"coalesce(array_to_string(list_sort(list(DISTINCT tubelet) FILTER (WHERE {c})), ','), '') AS {n}" for n, c in _LISTS.items())}
FROM pruned GROUP BY stream"""
)
def keep_stats(spark, folder):
    s = selection.keep_stats(pruned_patches(spark, folder), ["stream"])
    return s.select(*[c for c in s.columns if c not in _LISTS], *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in _LISTS])


@q(
    f"""{_PRUNED} SELECT stream, tubelet, tier, coalesce(max(CASE WHEN starts_with(mode, 'scored') THEN mode END), max(mode)) AS mode,
       string_agg(CASE WHEN keep THEN '1' ELSE '0' END, '' ORDER BY idx) AS mask FROM pruned GROUP BY stream, tubelet, tier"""
)
def keep_masks(spark, folder):
    m = selection.keep_masks(pruned_patches(spark, folder), ["stream"])
    return m.withColumn("mask", F.array_join(F.transform("mask", lambda k: F.when(k, "1").otherwise("0")), ""))


@q(
    f"""WITH {_PATCHES}, v AS (SELECT event_id, user_id, value FROM events), ev AS (
  SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tubelet, 0 AS idx, CAST(round_even(value * 1e6, 0) AS BIGINT) AS loss FROM events),
sized AS (SELECT *, max(tubelet) OVER (PARTITION BY stream) + 1 AS n_tubelets FROM ev), {_prune_sql("sized", "stream", "idx").replace("n_prior > 100", "n_prior > 20")}
SELECT tier, mode, count(*) AS cells, count_if(keep) AS kept FROM pruned GROUP BY tier, mode"""
)
def adaptive_prune_events(spark, folder):
    e = table(spark, folder, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("stream"), (F.row_number().over(order) - 1).alias("tubelet"), F.lit(0).alias("idx"), F.rint(F.col("value") * 1e6).cast("bigint").alias("loss"))
    rows = rows.withColumn("n_tubelets", F.max("tubelet").over(Window.partitionBy("stream")) + 1)
    out = selection.adaptive_prune(rows, ["stream"], "n_tubelets", SelectionConfig(warmup_min=20))
    return out.groupBy("tier", "mode").agg(F.count(F.lit(1)).alias("cells"), F.count_if("keep").alias("kept"))


# ---- other selections


_TOP = "greatest(1, CAST(trunc(count(*) OVER (PARTITION BY stream) * 0.1::DOUBLE) AS INT))"


@q(f"WITH {_PATCHES} SELECT stream, flat, loss FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY loss DESC, flat) AS rk, {_TOP} AS k FROM patches) WHERE rk <= k")
def topk_global(spark, folder):
    return selection.top_share(patches(spark, folder), ["stream"], 0.1).select("stream", "flat", "loss")


@q(
    f"""WITH {_PATCHES}, s AS (SELECT *, count(*) OVER (PARTITION BY stream) AS n, CAST(sum(loss) OVER (PARTITION BY stream) AS BIGINT) AS total, {_TOP} AS k FROM patches),
high AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY loss DESC, flat) AS rk FROM s WHERE CAST(loss AS HUGEINT) * n > total)
SELECT stream, flat, loss FROM high WHERE rk <= k"""
)
def zscore_select(spark, folder):
    return selection.above_mean(patches(spark, folder), ["stream"], 0.1).select("stream", "flat", "loss")


@q(f"WITH {_PATCHES} SELECT stream, flat, loss FROM (SELECT *, quantile_cont(loss, 0.9) OVER (PARTITION BY stream) AS thr FROM patches) WHERE loss >= thr")
def raw_quantile_select(spark, folder):
    return selection.above_quantile(patches(spark, folder), ["stream"], 0.1).select("stream", "flat", "loss")


_COVER = f"""WITH {_PATCHES}, c AS (
  SELECT *, {_TOP} AS k, row_number() OVER (PARTITION BY stream, tubelet, (idx // 16) // 4, (idx % 16) // 4 ORDER BY loss DESC, flat) = 1 AS covered FROM patches),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY covered DESC, loss DESC, flat) AS rk FROM c)"""


@q(f"{_COVER} SELECT stream, flat, loss, covered FROM r WHERE covered OR rk <= k")
def cell_coverage_topk(spark, folder):
    return selection.cell_coverage(patches(spark, folder), ["stream"], 16, 0.1).select("stream", "flat", "loss", "covered")


@q(f"{_COVER.replace('* 0.1::DOUBLE', '* 0.05::DOUBLE')} SELECT stream, flat, loss, covered FROM r WHERE rk <= k")
def cell_coverage_trim(spark, folder):
    return selection.cell_coverage(patches(spark, folder), ["stream"], 16, 0.05, trim=True).select("stream", "flat", "loss", "covered")


@q(
    """SELECT size, x, max(cell) AS cell FROM (
  SELECT size, x, cell FROM (SELECT unnest(range(3, 33)) AS size) s, LATERAL (SELECT unnest(range(s.size)) AS x) a, LATERAL (SELECT unnest(range(least(4, s.size))) AS cell) b
  WHERE x >= cell * size // least(4, size) AND x < (cell + 1) * size // least(4, size)) GROUP BY size, x"""
)
def cell_bounds(spark, folder):
    def places(size):
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: F.struct(F.lit(size).alias("size"), x.alias("x"), selection.cell_of(x, size, 4).alias("cell")))

    return spark.range(1).select(F.inline(F.concat(*[places(size) for size in range(3, 33)])))


_HASHED = f"""WITH {_PATCHES}, h AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY md5('3:' || stream || ':' || flat), flat) AS rk, {_TOP} AS k FROM patches)"""


@q(f"{_HASHED} SELECT stream, flat FROM h WHERE rk <= k")
def hash_random_keep(spark, folder):
    return selection.hashed_share(patches(spark, folder), ["stream"], 0.1, seed=3).select("stream", "flat")


_EVEN = """SELECT DISTINCT {k}, least(total - 1, CAST(round_even(i * total / n::DOUBLE, 0) AS BIGINT)) AS flat
FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT {k}, total, greatest(1, CAST(trunc(total * 0.1::DOUBLE) AS INT)) AS n FROM {src}))"""


@q("WITH s AS (SELECT DISTINCT num_frames, num_frames * 3 AS total FROM run_records WHERE num_frames > 0) " + _EVEN.format(k="num_frames", src="s"))
def uniform_keep(spark, folder):
    return selection.even_share(streams(spark, folder).withColumn("total", F.col("num_frames") * 3), "total", 0.1).select("num_frames", "flat")


@q(
    f"""{_HASHED}, o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY flat) - 1 AS ord, row_number() OVER (PARTITION BY stream ORDER BY loss DESC, flat) AS rl FROM h),
s AS (SELECT stream, count(*) AS total FROM patches GROUP BY stream), e AS ({_EVEN.format(k="stream", src="s")})
SELECT 'baseline' AS method, stream, count(*) AS kept, CAST(sum(loss) AS BIGINT) AS kept_loss FROM o GROUP BY stream
UNION ALL SELECT 'random', stream, count(*), CAST(sum(loss) AS BIGINT) FROM o WHERE rk <= k GROUP BY stream
UNION ALL SELECT 'uniform', o.stream, count(*), CAST(sum(loss) AS BIGINT) FROM o JOIN e ON o.stream = e.stream AND o.ord = e.flat GROUP BY o.stream
UNION ALL SELECT 'scored', stream, count(*), CAST(sum(loss) AS BIGINT) FROM o WHERE rl <= k GROUP BY stream"""
)
def select_by_method(spark, folder):
    p = patches(spark, folder)
    parts = [
        selection.select_by(m, p, ["stream"], 0.1, seed=3).groupBy("stream").agg(F.count(F.lit(1)).alias("kept"), F.sum("loss").alias("kept_loss")).select(F.lit(m).alias("method"), "stream", "kept", "kept_loss")
        for m in selection.METHODS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- window arithmetic on patches


@q(
    f"""WITH {_PATCHES} SELECT stream, tubelet // 2 AS t, (idx // 16) // 4 AS h, (idx % 16) // 4 AS w, CAST(sum(loss) AS BIGINT) AS total, count(loss) AS cells, max(loss) AS top, CAST(sum(loss) AS BIGINT) / count(loss) AS mean
FROM patches GROUP BY ALL"""
)
def grid_pool(spark, folder):
    p = patches(spark, folder).select("stream", F.col("tubelet").alias("t"), grid.div(F.col("idx"), 16).alias("h"), (F.col("idx") % 16).alias("w"), F.col("loss").alias("score"))
    return grid.pool(p, ["stream"], (2, 4, 4))


@q(
    f"""WITH {_PATCHES}, shifted AS (SELECT stream, tubelet, idx, loss FROM patches UNION ALL SELECT stream, tubelet + 1, idx, loss FROM patches),
cells AS (SELECT stream, n, tubelet, unnest(range(256)) AS idx FROM (SELECT stream, n, unnest(range(n)) AS tubelet FROM (SELECT stream, max(n_tubelets) AS n FROM patches GROUP BY stream)))
SELECT c.stream, c.tubelet, c.idx, count(s.loss) AS windows, coalesce(CAST(sum(s.loss) AS BIGINT), 0) / greatest(1, count(s.loss)) AS loss
FROM cells c LEFT JOIN shifted s ON c.stream = s.stream AND c.tubelet = s.tubelet AND c.idx = s.idx GROUP BY c.stream, c.tubelet, c.idx"""
)
def overlap_average(spark, folder):
    p = patches(spark, folder)
    two = p.select("stream", "tubelet", "idx", "loss").unionByName(p.select("stream", (F.col("tubelet") + 1).alias("tubelet"), "idx", "loss"))
    n = p.groupBy("stream").agg(F.max("n_tubelets").alias("n"))
    full = n.select("stream", F.explode(F.expr("sequence(0L, n - 1)")).alias("tubelet")).select("stream", "tubelet", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    return windows.overlap_average(two, full, ["stream", "tubelet", "idx"])


@q(
    """WITH w AS (SELECT video_path, target_frames, scored_at, window_no, patch_loss_16x16 AS l, row_number() OVER (PARTITION BY video_path, target_frames ORDER BY scored_at, window_no) AS up,
           row_number() OVER (PARTITION BY video_path, target_frames ORDER BY scored_at DESC, window_no DESC) AS down FROM loss_windows WHERE scored_at IS NOT NULL),
a AS (SELECT video_path, target_frames, unnest(range(len(l))) AS idx, unnest(l) AS v FROM w WHERE up = 1), b AS (SELECT video_path, target_frames, unnest(range(len(l))) AS idx, unnest(l) AS v FROM w WHERE down = 1)
SELECT coalesce(a.video_path, b.video_path) AS video_path, count(*) AS cells, count(coalesce(b.v, a.v)) AS known, count_if(b.v IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS renewed
FROM a FULL OUTER JOIN b ON a.video_path = b.video_path AND a.target_frames = b.target_frames AND a.idx = b.idx GROUP BY ALL"""
)
def history_carry_over(spark, folder):
    w = table(spark, folder, "loss_windows").filter("scored_at IS NOT NULL")
    s = F.struct("scored_at", "window_no", "patch_loss_16x16")
    both = w.groupBy("video_path", "target_frames").agg(F.min(s).alias("a"), F.max(s).alias("b"))
    keys = ["video_path", "target_frames", "idx"]
    old = both.select("video_path", "target_frames", F.posexplode("a.patch_loss_16x16").alias("idx", "v"))
    new = both.select("video_path", "target_frames", F.posexplode("b.patch_loss_16x16").alias("idx", "v"))
    merged = windows.carry_over(old.withColumnRenamed("v", "mask").withColumn("before", F.col("mask")), new.withColumnRenamed("v", "mask").withColumn("mask", F.col("mask")), keys, "mask")
    return merged.groupBy("video_path").agg(
        F.count(F.lit(1)).alias("cells"), F.count("mask").alias("known"), F.count_if(F.col("mask").isNotNull() & ~F.col("mask").eqNullSafe(F.col("before"))).alias("renewed")
    )


@q(
    f"""{_PRUNED} SELECT stream, tubelet, CAST(sum(coalesce(CASE WHEN idx % 3 = 0 THEN NULL ELSE 2 END, CASE WHEN keep THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM pruned GROUP BY stream, tubelet"""
)
def mask_fallback_scores(spark, folder):
    """Where a loss is missing, the keep mask stands in as the score."""
    p = pruned_patches(spark, folder).withColumn("known", F.when(F.col("idx") % 3 != 0, F.lit(2)))
    return p.groupBy("stream", "tubelet").agg(F.sum(F.coalesce("known", F.col("keep").cast("int"))).alias("score"))


_CELLS_WINDOWED = f"""WITH {_CELLS}, s AS (SELECT label, unnest(range(0, n - 7, 4)) AS start FROM (SELECT label, max(tubelet) + 1 AS n FROM cells GROUP BY label) WHERE n >= 8),
inside AS (SELECT s.start, c.* FROM s JOIN cells c ON c.label = s.label AND c.tubelet >= s.start AND c.tubelet < s.start + 8),
ctx AS (SELECT *, CAST(sum(total) OVER w AS BIGINT) - total AS s, CAST(sum(n) OVER w AS BIGINT) - n AS c FROM inside WINDOW w AS (PARTITION BY label, start, patch))"""
_AXIS = "greatest(0.0::DOUBLE, least({n} - 1, ({o} + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE))"


def _axis_sql(name: str) -> str:
    """Output cells of an axis with their two neighbours and weights."""
    return f"(SELECT * EXCLUDE (x), floor(x)::BIGINT AS i, 1 - (x - floor(x)) AS k FROM {name} UNION ALL SELECT * EXCLUDE (x), floor(x)::BIGINT + 1, x - floor(x) FROM {name} WHERE x > floor(x))"


@q(
    f"""WITH {_PATCHES}, lens AS (SELECT video_path AS stream, greatest((max(total_frames) + 1) // 2, max(target_frames[1]) // 2 + 1) AS n FROM loss_windows GROUP BY video_path),
at0 AS (SELECT *, {_AXIS.format(o='o', n='n', m='m')} AS x FROM (SELECT stream, n, m, unnest(range(m)) AS o FROM (SELECT *, (n * 6 + 7) // 8 AS m FROM lens))),
ah0 AS (SELECT o, {_AXIS.format(o='o', n='16', m='10')} AS x FROM (SELECT unnest(range(10)) AS o)),
aw0 AS (SELECT o, {_AXIS.format(o='o', n='16', m='14')} AS x FROM (SELECT unnest(range(14)) AS o)),
at1 AS {_axis_sql('at0')}, ah1 AS {_axis_sql('ah0')}, aw1 AS {_axis_sql('aw0')}
SELECT p.stream, a.o AS t, b.o AS h, c.o AS w, CAST(floor(sum(p.loss * (a.k * b.k * c.k)) + 0.500123457::DOUBLE) AS BIGINT) AS score
FROM patches p JOIN at1 a ON a.stream = p.stream AND a.i = p.tubelet JOIN ah1 b ON b.i = p.idx // 16 JOIN aw1 c ON c.i = p.idx % 16 GROUP BY ALL"""
)
def trilinear_scores(spark, folder):
    """All tubelets of each stream, resampled to 6 steps for every 8 tubelets (rounded up) of 10 x 14 cells."""
    frames = table(spark, folder, "loss_windows").groupBy(F.col("video_path").alias("stream")).agg(F.max("total_frames").alias("n"), F.max(F.col("target_frames")[0]).alias("last"))
    n = frames.select("stream", F.greatest(grid.div(F.col("n") + 1, 2), grid.div(F.col("last"), 2) + 1).alias("n"))
    p = patches(spark, folder)
    s = p.select("stream", F.col("tubelet").cast("int").alias("t"), grid.div(F.col("idx"), 16).cast("int").alias("h"), (F.col("idx") % 16).cast("int").alias("w"), F.col("loss").alias("score"))
    out = grid.trilinear(s.join(n, "stream"), ["stream"], ("n", 16, 16), (grid.div(F.col("n") * 6 + 7, 8), 10, 14))
    return out.withColumn("score", F.floor(F.col("score") + F.lit(0.500123457)))  # whole micro-units; ties, which the order of the sum would decide, lie elsewhere


@q(f"{_CELLS_WINDOWED} SELECT label, start, patch, tubelet, CASE WHEN c > 0 THEN CAST(round_even(abs(total / n - s / c), 0) AS BIGINT) END AS loss FROM ctx")
def window_surround_losses(spark, folder):
    """Each tubelet of each window of 8 tubelets against the window's others, by patch."""
    c = cells(spark, folder)
    n = c.groupBy("label").agg((F.max("tubelet") + 1).alias("n")).filter("n >= 8")
    starts = n.select("label", F.explode(F.expr("sequence(0L, n - 8, 4L)")).alias("start"))
    inside = starts.withColumn("tubelet", F.explode(F.expr("sequence(start, start + 7)"))).join(c, ["label", "tubelet"])
    return windows.surround_losses(inside, ["label", "start"]).select("label", "start", "patch", "tubelet", "loss")


@q("""SELECT vec_id, CAST(round_even(list_sum([abs(CAST(embedding[i] AS DOUBLE) - CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)) for i in range(1, len(embedding) + 1)]) / len(embedding) * 1e6, 0) AS BIGINT) AS micro FROM embeddings""")
def l1_losses(spark, folder):
    """The mean absolute error of each vector taken as the prediction of its reverse."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select("vec_id", F.rint(windows.l1(v, F.reverse(v)) * 1e6).cast("bigint").alias("micro"))


@q(
    """SELECT mode, count(*) AS frames, sum(value)::BIGINT AS total, sum(frame_idx * value)::BIGINT AS weighted FROM (
  SELECT 'none' AS mode, num_frames, frame_idx, frame_idx AS value FROM f UNION ALL SELECT 'blank', num_frames, frame_idx, 0 FROM f
  UNION ALL SELECT 'shuffle', num_frames, row_number() OVER (PARTITION BY num_frames ORDER BY md5('5:' || frame_idx)) - 1, frame_idx FROM f) GROUP BY mode""".replace(
        "SELECT mode", f"WITH {_STREAMS}, f AS (SELECT num_frames, unnest(range(num_frames)) AS frame_idx FROM streams) SELECT mode", 1
    )
)
def visual_ablation(spark, folder):
    f = streams(spark, folder).withColumn("frame_idx", F.explode(F.expr("sequence(0, num_frames - 1)"))).withColumn("value", F.col("frame_idx").cast("double"))
    parts = [sampling.ablate(f, m, ["num_frames"], seed=5).select(F.lit(m).alias("mode"), "frame_idx", "value") for m in ("none", "blank", "shuffle", "text_only")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("frames"), F.sum("value").cast("bigint").alias("total"), F.sum(F.col("frame_idx") * F.col("value")).cast("bigint").alias("weighted"))


@q(f"WITH {_STREAMS} SELECT num_frames, 0 AS first_start, greatest(0, least(num_frames // 2, num_frames) - 16) AS anchored_start FROM streams")
def window_policies(spark, folder):
    n = F.col("num_frames")
    return streams(spark, folder).select(
        "num_frames", sampling.anchored_start(n, n, 16, "first").alias("first_start"), sampling.anchored_start(n, F.floor(n / 2), 16, "anchor_end").alias("anchored_start")
    )


def queries():
    return q.queries


def oracle_sql():
    return q.sql
