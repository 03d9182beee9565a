"""Queries of the training-data operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstream.llm import chunking, cutoff, mixing, pair_defects, percentiles, proportions, tokenizer, truncation
from keepstream.session import durable

QUANTILES = (0.5, 0.9, 0.95, 0.99)
MEASURES = ("total_latency_s", "peak_memory_mb")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return proportions.proportional_sample(table(spark, folder, "task_samples"), table(spark, folder, "task_targets"))[0]


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return proportions.proportional_sample(table(spark, folder, "task_samples"), table(spark, folder, "task_targets"))[1]


def p2_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the sample: its size, each sample once and in the table, floors kept where there are enough rows and the sample has room for them all."""
    samples = table(spark, folder, "task_samples")
    sample, report = proportions.proportional_sample(samples, table(spark, folder, "task_targets"))
    sample = durable(sample, "sample")
    known = samples.select("id").distinct()
    low = F.least("min_rows", "available")
    kept = (F.count_if(F.col("taken") < low) == 0) | (F.sum(low) > F.sum("taken"))
    floors = report.agg(kept.alias("floors_kept"))
    one = sample.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))
    strange = sample.join(known, "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return one.crossJoin(strange).crossJoin(floors)  # one row each


def measured(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """One row per record of run_records, its latest delivery: method, task and the measures.

    Rows without an id are records of their own.
    """
    r = table(spark, folder, "run_records")
    task = F.upper(F.regexp_replace("task", r"^\s+|\s+$", "")).alias("task")
    rows = r.select("record_id", "ingested_at", "method", task, *more, *MEASURES)
    wanted = ["method", "task", *more, *MEASURES]
    last = rows.filter("record_id IS NOT NULL").groupBy("record_id").agg(F.max(F.struct("ingested_at", *wanted)).alias("s"))
    return last.select(*[f"s.{c}" for c in wanted]).unionByName(rows.filter("record_id IS NULL").select(*wanted))


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles by radix selection: the value at rank max(1, ceil(q n)); the error bound is 0."""
    groups = ["method", "task", "metric"]
    values = percentiles.long_form(measured(spark, folder), ["method", "task"], MEASURES)
    found = percentiles.radix_percentiles(values, groups, QUANTILES)
    return found.select(*groups, "q", "n", percentiles.value(F.col("low")).alias("value"), F.lit(0.0).alias("error_bound"))


def p3_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The mergeable summary of each day: the counts of leading digits."""
    days = measured(spark, folder, "written_at").withColumn("day", F.to_date("written_at"))
    values = percentiles.long_form(days, ["method", "task", "day"], MEASURES)
    return percentiles.summaries(values, ["method", "task", "day", "metric"])


def p3_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the merged daily summaries, between two bounds 2^-12 of the value apart."""
    groups = ["method", "task", "metric"]
    stored = durable(p3_daily(spark, folder), "days")  # what each day would keep; the records are not read again
    found = percentiles.summary_percentiles(percentiles.merged(stored, groups), groups, QUANTILES)
    low, high = (percentiles.value(F.col(c)) for c in ("low", "high"))
    return found.select(*groups, "q", "n", low.alias("low"), high.alias("high"), (high - low).alias("error_bound"))


def p3_within(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each exact percentile lies between the bounds that the merged daily summaries give, and these within their stated error."""
    keys = ["method", "task", "metric", "q", "n"]
    exact, merged = p3_percentiles(spark, folder), p3_merged(spark, folder)
    on = percentiles.safe(keys, "e", "m")
    v, low, high = F.col("e.value"), F.col("m.low"), F.col("m.high")
    both = exact.alias("e").join(merged.alias("m"), on, "full_outer")
    small = high - low <= F.greatest(F.abs(low), F.abs(high)) * F.lit(2.0**-12)
    return both.select(*[F.coalesce(f"e.{k}", f"m.{k}").alias(k) for k in keys], ((v >= low) & (v <= high)).alias("within"), small.alias("bounded"))


def p4_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return cutoff.loss_cutoffs(table(spark, folder, "loss_windows"), table(spark, folder, "keep_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = truncation.cut_records(truncation.record_texts(table(spark, folder, "run_records")))
    return cut.filter("cut").select(F.col("id").alias("record_id"))


def p5_workers(spark: SparkSession, folder: str) -> DataFrame:
    cut = truncation.cut_records(truncation.record_texts(table(spark, folder, "run_records")))
    return truncation.cut_shares(cut).withColumnRenamed("source", "worker")


def p6_defects(spark: SparkSession, folder: str) -> DataFrame:
    """All defect types that fire on a pair."""
    pairs = pair_defects.recorded_pairs(table(spark, folder, "run_records"), table(spark, folder, "stream_answers"))
    return pair_defects.pair_defects(pairs)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_defects(spark, folder).select("src", "pair_id", pair_defects.defect_name(F.col("defects")[0]).alias("defect"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose ids do not decode to their text: none."""
    ids = tokenizer.token_ids(table(spark, folder, "documents").select("doc_id", "text"))
    back = tokenizer.decoded(ids, out="decoded")
    return back.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).select("doc_id")


def sized(spark: SparkSession, folder: str) -> DataFrame:
    """The size of each document; written once, as a range sort reads its input twice."""
    docs = tokenizer.token_count(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return durable(docs.select("doc_id", "source", "n_tokens"), "sizes")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.fair_mix(sized(spark, folder), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.fair_mix(sized(spark, folder), table(spark, folder, "mix_targets"))[1]


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix: caps, named sources only, and a size that no further copy would fit into."""
    targets, sizes = table(spark, folder, "mix_targets"), sized(spark, folder)
    drawn, shares = mixing.fair_mix(sizes, targets)
    caps = targets.groupBy("source").agg(F.max("max_repeats").alias("cap"))
    named = drawn.join(F.broadcast(caps), "source", "left")  # the small targets table
    totals = shares.agg(F.sum("available").alias("available"), F.sum("tokens").alias("reported"))
    most = sizes.join(F.broadcast(caps), "source", "left_semi").agg(F.max("n_tokens").alias("most"))
    got = named.agg(
        F.count_if(F.col("cap").isNull()).alias("not_named"),
        F.count_if(F.col("copies") > F.col("cap")).alias("over_cap"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
    )
    gap = F.floor(F.col("available") / 2) - F.col("tokens")
    one = got.crossJoin(totals).crossJoin(most)  # one row each
    return one.select("not_named", "over_cap", (F.col("tokens") == F.col("reported")).alias("reported"), ((gap >= 0) & (gap < F.col("most"))).alias("filled"))


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces: limit, overlap and cover of every text, and each its own part of the text."""
    split = durable(chunking.split_texts(table(spark, folder, "documents")), "split")
    by = Window.partitionBy("doc_id").orderBy("piece_no")  # the pieces of one text
    rows = chunking.piece_rows(split).join(split.select("doc_id", F.length("text").alias("length")), "doc_id")
    rows = tokenizer.token_count(rows, "piece", "counted")
    rows = rows.withColumn("next", F.lead("start").over(by)).withColumn("first", F.row_number().over(by) == 1)
    shared = F.when(F.col("next").isNotNull(), F.expr("right(piece, greatest(0, end - next))"))
    rows = tokenizer.token_count(rows.withColumn("shared", shared), "shared", "overlap")
    return rows.agg(
        F.count_if((F.col("counted") > chunking.LIMIT) | (F.col("counted") != F.col("n_tokens"))).alias("over_limit"),
        F.count_if(F.col("next").isNotNull() & ((F.col("next") <= F.col("start")) | (F.col("overlap") < chunking.OVERLAP))).alias("short_overlap"),
        F.count_if(F.when(F.col("first"), F.col("start") != 0).otherwise(False) | F.when(F.col("next").isNull(), F.col("end") != F.col("length")).otherwise(False)).alias("uncovered"),
        F.count_if(F.length("piece") != F.col("end") - F.col("start")).alias("wrong_text"),
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.split_texts(table(spark, folder, "documents")).select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.piece_rows(chunking.split_texts(table(spark, folder, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p2_sample, p2_report, p2_checked, p3_percentiles, p3_daily, p3_merged, p3_within, p4_cutoffs, p5_found, p5_workers, p6_found, p6_defects,
            p7_ids, p7_round_trip, p8_mix, p8_shares, p8_checked, p9_found, p9_pieces, p9_checked,
        )
    }


_MEASURED = r"""
WITH last AS (
  SELECT record_id, method, upper(regexp_replace(task, '^\s+|\s+$', '', 'g')) AS task, total_latency_s, peak_memory_mb,
         CASE WHEN record_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) END AS rn
  FROM run_records),
long AS (
  SELECT method, task, 'total_latency_s' AS metric, total_latency_s AS v FROM last WHERE rn = 1
  UNION ALL SELECT method, task, 'peak_memory_mb', peak_memory_mb FROM last WHERE rn = 1),
ranked AS (
  SELECT method, task, metric, v + 0.0 AS v,
         row_number() OVER (PARTITION BY method, task, metric ORDER BY v) AS rk, count(*) OVER (PARTITION BY method, task, metric) AS n
  FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_percentiles": _MEASURED
        + """SELECT method, task, metric, q, n, v AS value, CAST(0 AS DOUBLE) AS error_bound
FROM ranked, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) t(q)
WHERE rk = greatest(1, CAST(ceil(q * n) AS BIGINT))""",
        "p3_within": _MEASURED
        + """SELECT method, task, metric, q, n, true AS within, true AS bounded
FROM (SELECT DISTINCT method, task, metric, n FROM ranked), (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) t(q)""",
        "p2_checked": """
SELECT CAST(floor(count(DISTINCT id) * 0.1 + 0.5) AS BIGINT) AS n_rows, CAST(floor(count(DISTINCT id) * 0.1 + 0.5) AS BIGINT) AS n_ids,
       CAST(0 AS BIGINT) AS unknown, true AS floors_kept FROM task_samples""",
        "p7_round_trip": "SELECT doc_id FROM documents WHERE false",
        "p8_checked": "SELECT CAST(0 AS BIGINT) AS not_named, CAST(0 AS BIGINT) AS over_cap, true AS reported, true AS filled",
        "p9_checked": "SELECT CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS short_overlap, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS wrong_text",
        "p4_cutoffs": """
WITH once AS (
  SELECT collection, patch_loss_16x16 AS losses,
         row_number() OVER (PARTITION BY video_path, target_frames ORDER BY scored_at DESC NULLS LAST, window_no DESC NULLS LAST) AS rn
  FROM loss_windows),
vals AS (SELECT collection, v + 0.0 AS v FROM (SELECT collection, unnest(losses) AS v FROM once WHERE rn = 1) x WHERE v IS NOT NULL AND NOT isnan(v)),
tot AS (SELECT collection, count(*) AS total FROM vals GROUP BY collection),
want AS (
  SELECT k.collection, k.keep_ratio, coalesce(t.total, 0) AS total, CAST(ceil(CAST(least(greatest(k.keep_ratio, 0.0), 1.0) AS DECIMAL(17,15)) * t.total) AS BIGINT) AS rk
  FROM (SELECT DISTINCT collection, keep_ratio FROM keep_targets WHERE collection IS NOT NULL) k LEFT JOIN tot t USING (collection)),
ranked AS (SELECT collection, v, row_number() OVER (PARTITION BY collection ORDER BY v DESC) AS rn FROM vals),
cut AS (SELECT r.collection, r.v AS cutoff FROM ranked r JOIN want w ON r.collection = w.collection AND r.rn = w.rk)
SELECT w.collection, w.keep_ratio, c.cutoff,
       coalesce((SELECT count(*) FROM vals v WHERE v.collection = w.collection AND v.v >= c.cutoff), 0) AS kept, w.total
FROM want w LEFT JOIN cut c USING (collection)""",
    }
