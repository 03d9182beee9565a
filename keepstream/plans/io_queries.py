"""Queries of readers, writers, the scorer boundary and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepstream.config import SelectionConfig
from keepstream.operators import grid, pixels, scoring, windows
from keepstream.operators.ranged import group_rank
from keepstream.plans import evalkit
from keepstream.plans.eval_queries import _AB, SUMMARY, method_summary, samples
from keepstream.plans.registry import Registry, table
from keepstream.plans.selection_queries import _PRUNED, patches
from keepstream.session import durable, shared_dir
from keepstream.sources import readers, writers
from keepstream.streaming import online

q = Registry()
_RECORD = "record_id BIGINT, task STRING, method STRING, worker STRING, total_latency_s DOUBLE, raw_response STRING"


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/keepstream-{name}-{uuid.uuid4().hex}"


_RECORDS = "SELECT record_id, task, method, total_latency_s, raw_response FROM run_records"


@q(f"SELECT method, count(*) AS n, count(DISTINCT record_id) AS records, CAST(sum(length(raw_response)) AS BIGINT) AS chars, count(task) AS with_task FROM ({_RECORDS}) GROUP BY method")
def json_lines_round_trip(spark, folder):
    r = table(spark, folder, "run_records").select("record_id", "task", "method", "worker", "total_latency_s", "raw_response")
    path = place(spark, "lines")
    writers.append_records(r.filter("method <> 'uniform' OR method IS NULL"), path, fresh=True)
    writers.append_records(r.filter("method = 'uniform'"), path)
    back = readers.json_lines(spark, path, _RECORD)
    return back.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"), F.sum(F.length("raw_response")).alias("chars"), F.count("task").alias("with_task")
    )


@q("SELECT task, count(*) AS n, count(DISTINCT record_id) AS records FROM run_records WHERE task IS NOT NULL AND coalesce(worker, '') <> 'w03' GROUP BY task")
def shard_union(spark, folder):
    """A folder of files per worker, read by a glob; other folders are passed over by prefix, one worker by its name."""
    r = table(spark, folder, "run_records").select("record_id", "task", "method", "worker", "total_latency_s", "raw_response")
    path = place(spark, "shards")
    r.withColumn("of", F.concat(F.lit("shard-"), F.coalesce("worker", F.lit("none")))).write.partitionBy("of").json(path)
    r.withColumn("of", F.lit("notes")).write.mode("append").partitionBy("of").json(path)
    back = readers.shard_lines(spark, f"{path}/*/*", "of=shard-", "w03", _RECORD, depth=2)
    return back.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


@q("SELECT method, count(*) AS n, count(worker) AS with_worker, count(score) AS with_score FROM (SELECT method, CASE WHEN record_id % 3 <> 1 THEN worker END AS worker, CASE WHEN record_id % 3 <> 2 THEN score END AS score FROM run_records WHERE record_id IS NOT NULL) GROUP BY method")
def merged_shards(spark, folder):
    """The outputs of three shards as one; two of them lack a column."""
    r = table(spark, folder, "run_records").select("record_id", "method", "worker", "score").filter("record_id IS NOT NULL")
    parts = [r.filter(F.col("record_id") % 3 == k).drop(*gone) for k, gone in enumerate(((), ("worker",), ("score",)))]
    paths = [place(spark, f"shard-{k}") for k in range(3)]
    for part, path in zip(parts, paths):
        writers.append_records(part, path, fresh=True)
    back = [spark.read.schema(part.schema).json(path) for part, path in zip(parts, paths)]
    return writers.merged(back).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("worker").alias("with_worker"), F.count("score").alias("with_score"))


@q(
    """SELECT coalesce(stream_mode, 'none') AS checkpoint, count(*) AS n, max(CASE WHEN NOT isnan(peak_memory_mb) THEN peak_memory_mb END) AS max_allocated_mb,
       max_by(record_id, (written_at, record_id)) AS last_record FROM run_records WHERE written_at IS NOT NULL AND record_id IS NOT NULL GROUP BY 1"""
)
def memory_trace(spark, folder):
    """Trace lines appended by two runs, and the summary of each checkpoint."""
    r = table(spark, folder, "run_records").filter("written_at IS NOT NULL AND record_id IS NOT NULL")
    mb = F.when(~F.isnan("peak_memory_mb"), F.col("peak_memory_mb"))
    line = r.select(F.unix_micros("written_at").alias("ts"), F.coalesce("stream_mode", F.lit("none")).alias("checkpoint"), F.struct(mb.alias("allocated_mb")).alias("memory"), F.struct("record_id").alias("extra"))
    path = place(spark, "trace")
    for k in range(2):
        writers.append_trace(line.filter(F.col("extra.record_id") % 2 == k), path)
    back = spark.read.schema(line.schema).json(path)
    last = F.max(F.struct("ts", "extra.record_id"))
    return back.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n"), F.max("memory.allocated_mb").alias("max_allocated_mb"), last["record_id"].alias("last_record"))


@q("SELECT * FROM (VALUES ('cell_grid_size', '4'), ('keep_ratio', '0.1'), ('record_keep_masks', 'false'), ('score_mode', 'rank'), ('warmup_min', '100')) t(setting, value)")
def run_config(spark, folder):
    """The settings of a run written as one JSON object, and read back."""
    cfg, path = SelectionConfig(), place(spark, "config")
    writers.write_config(spark, {k: getattr(cfg, k) for k in ("keep_ratio", "score_mode", "warmup_min", "cell_grid_size", "record_keep_masks")}, path)
    return readers.settings(spark, path)


@q(f"WITH {_AB} SELECT video_path, count(*) AS windows, max(top) AS max_abs_diff, max(mean) AS max_mean_diff FROM each GROUP BY video_path")
def external_parity(spark, folder):
    """The last scoring of each window against an external JSON file that holds the first, cell by cell."""
    w = table(spark, folder, "loss_windows").filter("scored_at IS NOT NULL")
    s = F.struct("scored_at", "window_no", "patch_loss_16x16", "total_frames", "fps")
    both = durable(w.groupBy("video_path", "target_frames").agg(F.min(s).alias("a"), F.max(s).alias("b")), "scorings")
    path = place(spark, "parity")
    # an object holds the windows of one video
    of = both.groupBy("video_path").agg(
        F.count(F.lit(1)).cast("int").alias("num_windows"), F.max("a.total_frames").alias("total_frames"), F.max("a.fps").alias("fps"),
        F.collect_list(F.struct("target_frames", F.col("a.patch_loss_16x16").alias("patch_loss_16x16"))).alias("windows"),
    )
    of.write.json(path)
    theirs = readers.external_losses(spark, path)
    pairs = both.join(theirs, ["video_path", "target_frames"]).select("video_path", "target_frames", F.explode(F.arrays_zip(F.col("b.patch_loss_16x16").alias("x"), F.col("losses").alias("y"))).alias("p"))
    gap = evalkit.micro(F.abs(F.col("p.x") - F.col("p.y")))
    each = pairs.withColumn("gap", gap).filter("gap IS NOT NULL").groupBy("video_path", "target_frames").agg(F.max("gap").alias("top"), (F.sum("gap") / F.count("gap")).alias("mean"))
    return each.groupBy("video_path").agg(F.count(F.lit(1)).alias("windows"), F.max("top").alias("max_abs_diff"), F.max("mean").alias("max_mean_diff"))


_DECODED = """f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS source_index, embedding, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL)"""


@q(
    f"""WITH {_DECODED} SELECT label, source_index // 2 AS frame_idx, source_index, source_index // 4 AS tubelet,
  CAST(list_sum([CAST(round_even(CAST(x AS DOUBLE) * 1e6, 0) AS BIGINT) for x in embedding]) AS BIGINT) AS total FROM f WHERE source_index % 2 = 0"""
)
def decoded_tubelets(spark, folder):
    """A file per stream through the decoder boundary: every second frame, in tubelets of two."""
    e = table(spark, folder, "embeddings").select("label", "vec_id", "embedding").filter("label IS NOT NULL AND vec_id IS NOT NULL")
    path = place(spark, "videos")
    rows = e.select("label", "vec_id", F.array_join(F.transform("embedding", lambda v: F.rint(v.cast("double") * 1e6).cast("bigint").cast("string")), " ").alias("value"))
    # a file is one stream, bounded as a video is; the plug-in of a real format reads it in its own way
    rows.repartition("label").sortWithinPartitions("label", "vec_id").drop("vec_id").write.partitionBy("label").text(path)
    files = readers.listed(spark, path, "*.txt").select("path")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    plan = files.withColumn("label", F.regexp_extract("path", "label=(-?[0-9]+)", 1).cast("int")).join(n, "label")
    plan = plan.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), grid.div(F.col("n") + 1, 2) - 1)))
    out = readers.decode(spark, path, plan.select("path", F.col("frame_idx").cast("int").alias("frame_idx"), (F.col("frame_idx") * 2).alias("source_index")), readers.text_frames, "*.txt")
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return out.select(F.regexp_extract("path", "label=(-?[0-9]+)", 1).cast("int").alias("label"), "frame_idx", "source_index", grid.div(F.col("frame_idx"), 2).alias("tubelet"), total.alias("total"))


@q("SELECT question_id, count(*) AS n, max(question) AS question, max(options) AS options, max(answer) AS answer FROM stream_answers GROUP BY question_id")
def csv_round_trip(spark, folder):
    s = table(spark, folder, "stream_answers").select("question_id", "task_type", "question", "time_stamp", "options", "answer")
    path = place(spark, "csv")
    writers.write_csv(s, path)
    back = readers.questions(spark, path)
    return back.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("question").alias("question"), F.max("options").alias("options"), F.max("answer").alias("answer"))


@q("SELECT id, count(*) AS n, max(len(options)) AS options, max(len(test_info)) AS checks FROM task_samples GROUP BY id")
def json_array_scan(spark, folder):
    t = table(spark, folder, "task_samples").drop("added_at")
    path = place(spark, "array")
    writers.write_arrays(t, path)
    return readers.tasks(spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("options").isNotNull(), F.size("options"))).alias("options"), F.max(F.when(F.col("test_info").isNotNull(), F.size("test_info"))).alias("checks"))


@q("SELECT video_path, count(DISTINCT target_frames) AS entries FROM loss_windows GROUP BY video_path")
def score_cache_upsert(spark, folder):
    w = table(spark, folder, "loss_windows").groupBy("video_path", "target_frames").agg(F.max(F.struct("scored_at", "window_no")).alias("s")).select("video_path", "target_frames", "s.*")
    path, keys = place(spark, "cache"), ["video_path", "target_frames"]
    first = writers.put_scores(None, w.filter("window_no % 2 = 0"), keys, path)
    second = writers.put_scores(first, w.filter("window_no % 3 <> 1"), keys, path)
    full = writers.put_scores(second, w.filter("window_no IS NULL OR window_no % 2 = 1"), keys, path)
    return full.groupBy("video_path").agg(F.count(F.lit(1)).alias("entries"))


@q(r"""SELECT id, 'bench/' || video AS video_path FROM (SELECT id, video FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC) AS rn FROM task_samples) WHERE rn = 1) ORDER BY id LIMIT 50""")
def bench_samples(spark, folder):
    return readers.bench_samples(samples(spark, folder).select("id", "video"), "id", 50, "bench/").select("id", "video_path")


@q("SELECT id, count(*) AS n FROM task_samples WHERE id = 7 GROUP BY id")
def point_lookup(spark, folder):
    return readers.by_id(table(spark, folder, "task_samples"), "id", 7).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT question_id FROM (SELECT DISTINCT question_id FROM stream_answers) WHERE question_id NOT IN (SELECT question_id FROM stream_answers WHERE correct)")
def resumed_run(spark, folder):
    s = table(spark, folder, "stream_answers")
    return writers.resume(s.select("question_id").distinct(), s.filter("correct"), "question_id")


@q(f"SELECT *, count(*) OVER () AS markdown_rows FROM ({SUMMARY})")
def run_report(spark, folder):
    """The summary of each method as JSON and Markdown, read back."""
    path = place(spark, "report")
    s = method_summary(spark, folder)
    writers.write_report(spark, s.orderBy("method"), path, "Methods")
    rows = spark.read.text(f"{path}/kind=json", wholetext=True).select(F.inline(F.from_json("value", T.ArrayType(s.schema))))
    lines = spark.read.text(f"{path}/kind=markdown", wholetext=True).select((F.size(F.split(F.regexp_replace("value", "\n+$", ""), "\n")) - 4).cast("bigint").alias("markdown_rows"))  # a title, a blank, a head and a rule
    return rows.crossJoin(lines)  # with one row


@q(
    """WITH f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT DISTINCT label, n FROM f),
w AS (SELECT label, 0 AS start, e + 1 AS length, e // 2 AS target FROM (SELECT label, unnest(range(3, least(16, n), 2)) AS e FROM s)
  UNION ALL SELECT label, b, 16, b // 2 + 7 FROM (SELECT label, n, unnest(range(2, n - 15, 2)) AS b FROM s WHERE n >= 18) WHERE b // 2 + 7 < (n + 1) // 2),
x AS (SELECT w.label, w.target, f.i >= w.start + w.length - 2 AS last, unnest(range(1, len(embedding) + 1)) AS patch, unnest(embedding) AS v FROM w JOIN f ON f.label = w.label AND f.i >= w.start AND f.i < w.start + w.length),
m AS (SELECT label, target, patch, avg(CAST(v AS DOUBLE)) FILTER (WHERE last) AS a, avg(CAST(v AS DOUBLE)) FILTER (WHERE NOT last) AS b FROM x GROUP BY ALL)
SELECT label, target, count(*) AS patches, max(CAST(round_even(abs(a - b) * 1e6, 0) AS BIGINT)) AS top FROM m GROUP BY label, target"""
)
def scored_windows(spark, folder):
    """The window schedule of the embeddings' streams through the scorer boundary."""
    e = table(spark, folder, "embeddings").filter("label IS NOT NULL AND vec_id IS NOT NULL")
    f = group_rank(e, ["label"], [F.col("vec_id")], "n").select("label", (F.col("n") - 1).alias("frame_idx"), F.col("embedding").cast("array<double>").alias("value"))
    n = f.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("frames"))
    w = windows.schedule(n, "frames")
    s = scoring.score_windows(f, w, ["label"], scoring.ContextMean())
    micro = F.transform("losses", lambda x: F.rint(x * 1e6).cast("bigint"))
    return s.select("label", "target", F.size("losses").alias("patches"), F.array_max(micro).alias("top"))



@q(
    """WITH ev AS (SELECT to_timestamp(floor(epoch_us(ts) / 1000000 / 3600) * 3600) AT TIME ZONE 'UTC' AS start, event_type, value FROM events)
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, CAST(round_even(sum(CAST(round_even(value * 100, 0) AS BIGINT)), 0) AS BIGINT) AS total FROM ev GROUP BY start, event_type"""
)
def event_time_windows(spark, folder):
    """Hourly counts of events from a stream; all windows, as the run ends with the input."""
    source = place(spark, "events")
    e = table(spark, folder, "events").select("ts", "event_type", F.rint(F.col("value") * 100).cast("bigint").alias("cents"))
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    out = online.event_windows(stream, "ts", "40 days", "1 hour", "event_type", "cents")
    path = place(spark, "windows")
    run = out.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    run.trigger(availableNow=True).option("checkpointLocation", place(spark, "events-state")).start().awaitTermination()
    done = spark.read.schema(out.schema).parquet(path)
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


@q(f"{_PRUNED} SELECT stream, tier, mode, count(*) AS cells, count_if(keep) AS kept FROM pruned GROUP BY stream, tier, mode")
def stream_prune(spark, folder):
    """The patches of all streams through the stateful operator in two runs: the first half, then, with the state read back, the second."""
    source, state, path = place(spark, "patches"), place(spark, "patches-state"), place(spark, "pruned")
    p = durable(patches(spark, folder, whole=True).select("stream", "tubelet", F.col("idx").cast("int").alias("idx"), "loss", F.col("n_tubelets").cast("double").alias("n_tubelets")), "patches")
    ends = p.groupBy("stream").agg(F.max("tubelet").alias("_end"))  # a stream's last rows say its length, which closes it
    p = p.join(ends, "stream")
    half, schema = grid.div(F.col("_end") + 1, 2), p.drop("_end").schema
    for k, part in enumerate((F.col("tubelet") < half, F.col("tubelet") >= half)):
        rows = p.filter(part).withColumn("n_tubelets", F.lit(None).cast("double") if k == 0 else F.col("n_tubelets"))
        rows.drop("_end").write.mode("append").parquet(source)
        out = online.run_to_end(online.online_prune(spark.readStream.schema(schema).parquet(source)), path, state)
    return out.groupBy("stream", "tier", "mode").agg(F.count(F.lit(1)).alias("cells"), F.count_if("keep").alias("kept"))


def resized_frames(spark, folder):
    """The embeddings as 8 x 8 grey frames, resized to 12 x 6."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 400 + 128).alias("v"))
    return e.select("vec_id", pixels.resize(F.col("v"), (8, 8), (12, 6)).alias("pixels"))


q.add("resized_frames", resized_frames)


def queries():
    return q.queries


def oracle_sql():
    return q.sql
