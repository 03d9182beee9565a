"""Queries of sequences, joins, answers and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepstream.functions import answers, prompts
from keepstream.operators import grid, positions, pruning, relational
from keepstream.operators.ranged import group_rank
from keepstream.plans import evalkit
from keepstream.plans.registry import Registry, table
from keepstream.plans.selection_queries import _PATCHES, _PRUNED, patches, pruned_patches

q = Registry()
KEYS = ["seq_id"]


def sequences(spark, folder) -> DataFrame:
    """Line items of an order as a token sequence."""
    li = table(spark, folder, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("seq_id"),
        (F.row_number().over(order) - 1).alias("pos"),
        F.when(F.col("l_returnflag") == "N", "video").otherwise("text").alias("kind"),
        (F.col("l_quantity") > 5).alias("valid"),
        F.col("l_partkey").alias("token"),
    )


_SEQ = """seq AS (
  SELECT l_orderkey AS seq_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos,
         CASE WHEN l_returnflag = 'N' THEN 'video' ELSE 'text' END AS kind, l_quantity > 5 AS valid, l_partkey AS token FROM lineitem),
num AS (SELECT *, CASE WHEN kind = 'video' AND valid THEN CAST(sum(CASE WHEN kind = 'video' AND valid THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 END AS ordinal FROM seq)"""
_KEPT = "kept AS (SELECT o_orderkey AS seq_id, o_custkey % 3 AS ordinal FROM orders UNION ALL SELECT o_orderkey, 0 FROM orders)"


def kept_ids(spark, folder) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("seq_id"), (F.col("o_custkey") % 3).alias("ordinal")).unionByName(o.select(F.col("o_orderkey").alias("seq_id"), F.lit(0).cast("bigint").alias("ordinal")))


_KEEP_SEQ = f"WITH {_SEQ}, {_KEPT}, k AS (SELECT DISTINCT seq_id, ordinal FROM kept), out AS (SELECT n.* FROM num n LEFT JOIN k ON n.seq_id = k.seq_id AND n.ordinal = k.ordinal WHERE n.valid AND (n.kind <> 'video' OR k.ordinal IS NOT NULL))"


@q(f"{_KEEP_SEQ} SELECT seq_id, pos, kind, token FROM out")
def prune_sequence(spark, folder):
    return pruning.keep_sequence(sequences(spark, folder), kept_ids(spark, folder), KEYS).select("seq_id", "pos", "kind", "token")


@q(f"WITH {_SEQ}, {_KEPT} SELECT DISTINCT k.seq_id, k.ordinal FROM kept k LEFT JOIN num n ON n.seq_id = k.seq_id AND n.ordinal = k.ordinal WHERE n.seq_id IS NULL")
def keep_ids_out_of_range(spark, folder):
    return pruning.check_keep(sequences(spark, folder), kept_ids(spark, folder), KEYS)


@q(
    f"""{_KEEP_SEQ}, r AS (SELECT seq_id % 100 AS batch, seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS new_pos, token FROM out),
l AS (SELECT batch, seq_id, max(new_pos) + 1 AS len FROM r GROUP BY batch, seq_id), m AS (SELECT *, max(len) OVER (PARTITION BY batch) AS top FROM l)
SELECT batch, seq_id, new_pos, token, -100 + 0 * token AS label, false AS padded FROM (SELECT batch, seq_id, new_pos, token FROM r) WHERE false
UNION ALL SELECT batch, seq_id, new_pos, token, token * 2, false FROM r
UNION ALL SELECT batch, seq_id, unnest(range(len, top)), 0, -100, true FROM m WHERE len < top"""
)
def pad_right(spark, folder):
    s = pruning.keep_sequence(sequences(spark, folder), kept_ids(spark, folder), KEYS)
    s = s.withColumn("batch", F.col("seq_id") % 100).withColumn("label", F.col("token") * 2)
    return pruning.pad_right(s, ["batch"], KEYS, {"token": 0, "label": -100})


@q(
    f"""WITH {_SEQ}, {_KEPT}, c AS (SELECT seq_id % 100 AS batch, seq_id, count(ordinal) AS n FROM num GROUP BY seq_id),
o AS (SELECT *, coalesce(CAST(sum(n) OVER (PARTITION BY batch ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS off FROM c)
SELECT k.seq_id, k.ordinal, off + k.ordinal AS flat_index FROM (SELECT DISTINCT seq_id, ordinal FROM kept) k JOIN o ON k.seq_id = o.seq_id"""
)
def flat_visual_index(spark, folder):
    n = pruning.video_ordinals(sequences(spark, folder), KEYS).groupBy("seq_id").agg(F.count("ordinal").alias("n")).withColumn("batch", F.col("seq_id") % 100)
    off = pruning.batch_offsets(n, ["batch"], "seq_id", "n")
    return pruning.flat_visual(kept_ids(spark, folder).distinct(), off, KEYS)


@q("SELECT r_regionkey, n_nationkey % 7 AS ordinal FROM region CROSS JOIN (SELECT DISTINCT n_nationkey % 7 AS n_nationkey FROM nation)")
def keep_list_for_all(spark, folder):
    kept = table(spark, folder, "nation").select((F.col("n_nationkey") % 7).alias("ordinal"))
    return pruning.for_all(kept, table(spark, folder, "region").select("r_regionkey"))


@q(f"{_PRUNED}, f AS (SELECT stream, n, unnest(range(n)) AS frame_idx FROM (SELECT video_path AS stream, max(total_frames) AS n FROM loss_windows GROUP BY video_path)), m AS (SELECT stream, tubelet, count_if(keep) AS kept FROM pruned GROUP BY stream, tubelet) SELECT f.stream, f.frame_idx, m.tubelet, m.kept FROM f JOIN m ON f.stream = m.stream AND f.frame_idx // 2 = m.tubelet")
def mask_to_frames(spark, folder):
    m = pruned_patches(spark, folder).groupBy("stream", "tubelet").agg(F.count_if("keep").alias("kept"))
    n = table(spark, folder, "loss_windows").groupBy(F.col("video_path").alias("stream")).agg(F.max("total_frames").alias("n"))
    f = n.select("stream", F.explode(F.expr("sequence(0, n - 1)")).alias("frame_idx"))
    return pruning.mask_to_frames(f, m, ["stream"]).select("stream", "frame_idx", "tubelet", "kept")


@q(f"{_PRUNED} SELECT stream, tubelet, idx, row_number() OVER (PARTITION BY stream ORDER BY tubelet, idx) - 1 AS slot, tubelet AS pos_t, idx // 16 AS pos_h, idx % 16 AS pos_w FROM pruned WHERE keep")
def compact_memory(spark, folder):
    kept = pruned_patches(spark, folder).filter("keep").select("stream", "tubelet", "idx")
    cut = F.col("tubelet") < 20
    out = pruning.append_compact(kept.filter(cut), kept.filter(~cut), ["stream"])
    return positions.compact_positions(out, 16)


@q(
    f"""WITH {_SEQ}, e AS (SELECT o_orderkey AS seq_id, o_custkey AS emb, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) - 1 AS ordinal FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders))
SELECT n.seq_id, n.pos, n.kind, e.emb FROM num n LEFT JOIN e ON n.seq_id = e.seq_id AND n.ordinal = e.ordinal"""
)
def placeholder_scatter(spark, folder):
    o = table(spark, folder, "orders")
    e = o.select(F.col("o_orderkey").alias("seq_id"), F.col("o_custkey").alias("emb")).unionByName(o.select(F.col("o_orderkey").alias("seq_id"), (F.col("o_custkey") + 1).alias("emb")))
    return pruning.scatter(sequences(spark, folder), e, KEYS, F.col("emb"), "emb").select("seq_id", "pos", "kind", "emb")


@q(
    """WITH g AS (SELECT DISTINCT g[1] AS t, g[2] // 2 AS h, g[3] // 2 AS w FROM (SELECT unnest(video_grid_thw) AS g FROM run_records))
SELECT t, h, w, i, i // (h * w) + 10 AS pos_t, (i % (h * w)) // w + 10 AS pos_h, i % w + 10 AS pos_w FROM (SELECT *, unnest(range(t * h * w)) AS i FROM g)"""
)
def vision_positions(spark, folder):
    g = table(spark, folder, "run_records").select(F.explode("video_grid_thw").alias("g"))
    g = g.select(F.col("g")[0].alias("t"), grid.div(F.col("g")[1], 2).alias("h"), grid.div(F.col("g")[2], 2).alias("w")).distinct()
    return positions.vision_positions(g.withColumn("start", F.lit(10))).select("t", "h", "w", "i", "pos_t", "pos_h", "pos_w")


_ROPE = f"""WITH {_SEQ}, b AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS new FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS run FROM b),
g AS (SELECT seq_id, run, kind, min(pos) AS first, count(*) AS len FROM r GROUP BY seq_id, run, kind),
a AS (SELECT *, 2 * len AS h, 4 AS w, CASE WHEN kind = 'video' THEN greatest(2 * len, 4) // 2 ELSE len END AS adv FROM g),
s AS (SELECT *, coalesce(CAST(sum(adv) OVER (PARTITION BY seq_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM a)"""


@q(f"{_ROPE} SELECT seq_id, run, kind, first, len AS length FROM s")
def modality_runs(spark, folder):
    return positions.runs(sequences(spark, folder), KEYS)


@q(
    f"""{_ROPE}, p AS (SELECT r.seq_id, r.pos, r.kind, s.start + CASE WHEN r.kind = 'video' THEN (r.pos - s.first) // (s.len * 2) ELSE r.pos - s.first END AS pos_t,
  s.start + CASE WHEN r.kind = 'video' THEN ((r.pos - s.first) % (s.len * 2)) // 2 ELSE r.pos - s.first END AS pos_h, s.start + CASE WHEN r.kind = 'video' THEN (r.pos - s.first) % 2 ELSE r.pos - s.first END AS pos_w
  FROM r JOIN s ON r.seq_id = s.seq_id AND r.run = s.run)
SELECT *, max(greatest(pos_t, pos_h, pos_w)) OVER (PARTITION BY seq_id) + 1 - count(*) OVER (PARTITION BY seq_id) AS delta FROM p"""
)
def rope_index(spark, folder):
    s = sequences(spark, folder)
    g = positions.runs(s, KEYS).filter("kind = 'video'").select("seq_id", "run", (F.col("length") * 2).alias("h"), F.lit(4).cast("bigint").alias("w"))
    return positions.rope_index(s, KEYS, g).select("seq_id", "pos", "kind", "pos_t", "pos_h", "pos_w", "delta")


@q(f"WITH {_SEQ} SELECT seq_id, pos, CASE WHEN valid THEN CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 + seq_id % 5 ELSE 1 END AS position FROM seq")
def incremental_positions(spark, folder):
    return positions.incremental(sequences(spark, folder).withColumn("delta", F.col("seq_id") % 5), KEYS, "delta").select("seq_id", "pos", "position")


@q("SELECT o_orderkey, beam, beam = 0 AS sees_video FROM orders CROSS JOIN (SELECT unnest(range(3)) AS beam)")
def beam_expand(spark, folder):
    b = positions.expand_beams(table(spark, folder, "orders").select("o_orderkey"), 3)
    return b.withColumn("step", F.col("beam")).select("o_orderkey", "beam", pruning.decode_step().alias("sees_video"))


@q(
    """WITH v AS (SELECT l_orderkey % 50 AS batch, l_orderkey AS sample_no, count(*) AS n FROM lineitem GROUP BY l_orderkey),
vid AS (SELECT batch, sample_no, unnest(range(n)) AS k FROM v)
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY sample_no, k) - 1 AS video_no, sample_no FROM vid"""
)
def videos_of_samples(spark, folder):
    s = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("sample_no")).agg(F.count(F.lit(1)).alias("tokens")).withColumn("batch", F.col("sample_no") % 50)
    each = s.select("batch", "sample_no", F.explode(F.expr("sequence(1L, tokens)")).alias("k"))
    v = group_rank(each, ["batch"], [F.col("sample_no"), F.col("k")], "n").select("batch", (F.col("n") - 1).alias("video_no"), F.lit(1).cast("bigint").alias("tokens"))
    return positions.videos_of_samples(v, s.select("batch", "sample_no", "tokens"), ["batch"]).select("batch", "video_no", "sample_no")


# ---- prompts and answers


def samples(spark, folder) -> DataFrame:
    """Distinct samples with a clean task."""
    t = table(spark, folder, "task_samples")
    last = t.groupBy("id").agg(F.max_by(F.struct("task", "question", "options", "gt", "answer", "activity", "test_info", "video"), F.struct("added_at", F.xxhash64("task", "question", "answer"))).alias("s"))
    return last.select("id", "s.*").withColumn("task", F.upper(answers.strip(F.col("task"))))


_SAMPLES = r"""samples AS (
  SELECT id, upper(regexp_replace(task, '^\s+|\s+$', '', 'g')) AS task, question, options, gt, answer, activity, test_info, video FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC) AS rn FROM task_samples) t WHERE rn = 1)"""
_CHOICE = "('EPM', 'ASI', 'HLD', 'STU', 'OJR', 'ATR', 'ACR', 'OCR', 'FPD')"
_LETTERED = "coalesce(array_to_string([chr(CAST(64 + i AS INT)) || '. ' || coalesce(options[i], '') for i in range(1, len(options) + 1)], '; '), '')"


def _lit(s: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))


@q(
    f"""WITH {_SAMPLES} SELECT id, CASE
  WHEN task IN {_CHOICE} THEN {_lit(prompts.QUESTION)} || coalesce(question, '') || {_lit(prompts.OPTIONS)} || {_LETTERED} || ';' || {_lit(prompts.LETTER_ONLY)}
  WHEN task = 'REC' THEN {_lit(prompts.NUMBER_HEAD)} || coalesce(activity, 'the action') || {_lit(prompts.NUMBER_TAIL)}
  WHEN task = 'SSR' THEN {_lit(prompts.STEP_HEAD)} || coalesce(test_info[1].step, 'this step') || {_lit(prompts.YES_NO_TAIL)}
  WHEN task = 'CRR' THEN {_lit(prompts.QUESTION)} || coalesce(question, '') || {_lit(prompts.YES_NO_TAIL)}
  ELSE {_lit(prompts.QUESTION)} || coalesce(question, '') || {_lit(prompts.CONCISE)} END AS prompt FROM samples"""
)
def task_prompts(spark, folder):
    c = F.col
    return samples(spark, folder).select("id", prompts.task_prompt(c("task"), c("question"), c("options"), c("activity"), F.get("test_info", F.lit(0))["step"]).alias("prompt"))


_CHOICE_PROMPT = f"{_lit(prompts.QUESTION)} || coalesce(question, '') || {_lit(prompts.OPTIONS)} || {_LETTERED} || {_lit(prompts.LETTER_ONLY_HEAD)} || array_to_string([chr(CAST(64 + i AS INT)) for i in range(1, least(len(options), 3) + 1)], ', ') || {_lit(prompts.LETTER_ONLY_TAIL)}"


@q(
    f"""WITH {_SAMPLES} SELECT id, CASE
  WHEN task IN {_CHOICE} AND len(options) > 0 THEN {_CHOICE_PROMPT}
  WHEN task IN ('SSR', 'CRR') THEN CASE WHEN length(question) > 0 THEN {_lit(prompts.QUESTION)} || question || {_lit(prompts.YES_NO_TAIL)} WHEN len(test_info) > 0 THEN {_lit(prompts.STEP_HEAD)} || coalesce(test_info[1].step, 'this step') || {_lit(prompts.YES_NO_TAIL)} ELSE {_lit(prompts.YES_NO_ONLY)} END
  WHEN task = 'REC' THEN {_lit(prompts.NUMBER_HEAD)} || coalesce(activity, 'the action') || {_lit(prompts.NUMBER_TAIL)}
  WHEN length(question) > 0 THEN {_lit(prompts.QUESTION)} || question || {_lit(prompts.CONCISE_WORDS)} ELSE {_lit(prompts.DESCRIBE)} END AS prompt,
  CASE WHEN task IN {_CHOICE} THEN coalesce(chr(65 + gt), '')
  WHEN task IN ('SSR', 'CRR') THEN CASE WHEN length(answer) > 0 THEN CASE WHEN contains(lower(answer), 'yes') THEN 'Yes' ELSE answer END WHEN len(test_info) > 0 THEN CASE WHEN test_info[1].type = 1 THEN 'Yes' ELSE 'No' END ELSE '' END
  WHEN task = 'REC' THEN coalesce(CAST(test_info[1].count AS VARCHAR), '') ELSE coalesce(answer, '') END AS truth FROM samples"""
)
def sample_prompts(spark, folder):
    c = F.col
    s = samples(spark, folder)
    return s.select(
        "id",
        prompts.sample_prompt(c("task"), c("question"), c("options"), c("activity"), c("test_info")).alias("prompt"),
        prompts.truth(c("task"), c("gt"), c("answer"), c("test_info")).alias("truth"),
    )


@q(f"WITH {_SAMPLES} SELECT id, CASE WHEN len(options) > 0 AND NOT coalesce(task IN ('REC', 'SSR', 'CRR'), false) THEN {_CHOICE_PROMPT} ELSE {_lit(prompts.QUESTION)} || coalesce(question, '') || {_lit(prompts.CONCISE_WORDS)} END AS prompt FROM samples")
def single_prompts(spark, folder):
    return samples(spark, folder).select("id", prompts.single_prompt(F.col("task"), F.col("question"), F.col("options")).alias("prompt"))


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_OPTS = r"""t AS (SELECT answer_id, regexp_replace(options, '^\s+|\s+$', '', 'g') AS o FROM (SELECT DISTINCT answer_id, options FROM stream_answers)),
l AS (SELECT answer_id, CASE WHEN o IS NULL OR o = '' OR lower(o) = 'nan' THEN NULL WHEN starts_with(o, '[')
  THEN [regexp_replace(x[2:-2], '\\(.)', '\1', 'g') for x in regexp_extract_all(o, '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"')]
  ELSE [y for y in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split(o, chr(10))] if y <> ''] END AS opts FROM t)"""


@q(
    f"""WITH {_OPTS} SELECT answer_id, len(opts) AS n, array_to_string([CASE WHEN starts_with(opts[i], chr(CAST(64 + i AS INT)) || '.') OR starts_with(opts[i], chr(CAST(64 + i AS INT)) || ')') THEN opts[i] ELSE chr(CAST(64 + i AS INT)) || '. ' || opts[i] END for i in range(1, len(opts) + 1)], chr(10)) AS formatted FROM l"""
)
def parsed_options(spark, folder):
    o = prompts.parse_options(F.col("options"))
    s = table(spark, folder, "stream_answers").select("answer_id", "options").distinct().withColumn("opts", o)
    return s.select("answer_id", F.when(F.col("opts").isNotNull(), F.size("opts")).alias("n"), F.array_join(prompts.lettered_once(F.col("opts")), "\n").alias("formatted"))


@q(
    """SELECT DISTINCT answer_id, CASE WHEN len(p) = 2 THEN p[1]::BIGINT * 60 + p[2]::BIGINT ELSE p[1]::BIGINT * 3600 + p[2]::BIGINT * 60 + p[3]::BIGINT END AS seconds, string_split(question_id, '_')[-2] AS sample_id
FROM (SELECT answer_id, question_id, string_split(time_stamp, ':') AS p FROM stream_answers)"""
)
def question_times(spark, folder):
    s = table(spark, folder, "stream_answers")
    return s.select("answer_id", prompts.seconds(F.col("time_stamp")).alias("seconds"), prompts.id_token(F.col("question_id")).alias("sample_id")).distinct()


def _cascade_sql(patterns, x: str, tail: list[str]) -> str:
    parts = [f"nullif(upper(regexp_extract({x}, '(?i){p}', 1)), '')" for p in patterns] + [f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in tail]
    return f"coalesce({', '.join(parts)})"


@q(
    f"""SELECT DISTINCT answer_id, {_cascade_sql(answers.CASCADE, 't', ['([A-D])'])} AS letter, {_cascade_sql(answers.SHORT_CASCADE, 't', ['^([A-D])', '([A-D])'])} AS short_letter
FROM (SELECT answer_id, {_STRIP.format(x='response')} AS t FROM stream_answers)"""
)
def answer_letters(spark, folder):
    s = table(spark, folder, "stream_answers")
    return s.select("answer_id", answers.extract_letter(F.col("response")).alias("letter"), answers.extract_letter_short(F.col("response")).alias("short_letter")).distinct()


def records(spark, folder, *columns: str) -> DataFrame:
    """One row per record and content of run_records, with a clean task."""
    r = table(spark, folder, "run_records").select("record_id", "task", *columns).distinct()
    return r.withColumn("task", F.upper(answers.strip(F.col("task"))))


def _records(*columns: str) -> str:
    return f"rec AS (SELECT record_id, {_STRIP.format(x='upper(task)')} AS task, {', '.join(columns)} FROM (SELECT DISTINCT record_id, task, {', '.join(columns)} FROM run_records))"


_E = r"[^\p{L}\p{N}_]"
_POS = "CASE WHEN regexp_matches(t, '(?is)(?:^|" + _E + ")(?:{w})(?:" + _E + "|$)') THEN 1 + length(regexp_extract(t, '(?is)^(.*?)(?:^|" + _E + ")(?:{w})(?:" + _E + "|$)', 1)) ELSE 0 END"


@q(
    f"""WITH {_records('raw_response', 'options', 'ground_truth_letter')}, p AS (SELECT *, {_STRIP.format(x='raw_response')} AS t FROM rec),
yn AS (SELECT *, {_POS.replace('{w}', 'yes|y')} AS yes, {_POS.replace('{w}', 'no|n')} AS no FROM p),
parsed AS (SELECT record_id, task, ground_truth_letter AS g, CASE WHEN task IN {_CHOICE} AND len(options) > 0 THEN upper(regexp_extract(t, '(?is)(?:^|{_E})([A-D])(?:{_E}|$)', 1))
  WHEN task IN ('SSR', 'CRR') THEN CASE WHEN t IS NULL THEN '' WHEN yes > 0 AND (no = 0 OR yes < no) THEN 'Yes' WHEN no > 0 THEN 'No' ELSE '' END
  WHEN task = 'REC' THEN regexp_extract(t, '(?s)(?:^|{_E})([0-9]+)(?:{_E}|$)', 1) ELSE t END AS parsed FROM yn)
SELECT record_id, parsed, CASE WHEN length(parsed) > 0 AND length(g) > 0 AND (CASE WHEN task IN {_CHOICE} THEN upper(parsed) = {_STRIP.format(x='upper(g)')}
  WHEN task IN ('SSR', 'CRR') THEN lower(parsed) = {_STRIP.format(x='lower(g)')} WHEN task = 'REC' THEN parsed = {_STRIP.format(x='g')}
  ELSE contains(regexp_replace({_STRIP.format(x='lower(parsed)')}, '\\s+', ' ', 'g'), regexp_replace({_STRIP.format(x='lower(g)')}, '\\s+', ' ', 'g')) END) THEN 1 ELSE 0 END AS score FROM parsed"""
)
def parsed_answers(spark, folder):
    r = records(spark, folder, "raw_response", "options", "ground_truth_letter").withColumn("parsed", answers.parse(F.col("raw_response"), F.col("task"), F.col("options")))
    return r.select("record_id", "parsed", answers.score_parsed(F.col("parsed"), F.col("ground_truth_letter"), F.col("task")).alias("score"))


_SCORES = """CASE WHEN coalesce(response, '') <> '' AND contains(upper(response), upper(ground_truth_letter)) THEN 1 ELSE 0 END AS mc,
  CASE WHEN array_to_string(regexp_extract_all(response, '[0-9]+'), '') <> '' AND array_to_string(regexp_extract_all(response, '[0-9]+'), '') = ground_truth_letter THEN 1 ELSE 0 END AS rec_score,
  CASE WHEN coalesce(response, '') = '' THEN 0 WHEN (upper(response) = 'N' AND kind = 0) OR (upper(response) = 'Y' AND kind = 1) THEN 1
       WHEN kind = 0 THEN CASE WHEN contains(lower(response), 'no') THEN 1 ELSE 0 END ELSE CASE WHEN contains(lower(response), 'yes') THEN 1 ELSE 0 END END AS yn"""


def scored(spark, folder) -> DataFrame:
    """Records with the score of their task's family."""
    r = records(spark, folder, "method", "response", "ground_truth_letter").filter("ground_truth_letter IS NOT NULL")
    kind = (F.lower("ground_truth_letter") == "yes").cast("int")
    a, g = F.col("response"), F.col("ground_truth_letter")
    score = (
        F.when(F.col("task").isin(*prompts.CHOICE), answers.contains_truth(a, g)).when(F.col("task") == "REC", answers.digits_equal(a, g)).when(F.col("task").isin("SSR", "CRR"), answers.yes_no(a, kind))
    )
    return r.withColumn("score", score).filter("score IS NOT NULL")


_SCORED = f"""WITH {_records('method', 'response', 'ground_truth_letter')}, k AS (SELECT *, CASE WHEN lower(ground_truth_letter) = 'yes' THEN 1 ELSE 0 END AS kind FROM rec WHERE ground_truth_letter IS NOT NULL),
s AS (SELECT *, {_SCORES} FROM k),
scored AS (SELECT record_id, task, method, CASE WHEN task IN {_CHOICE} THEN mc WHEN task = 'REC' THEN rec_score ELSE yn END AS score FROM s WHERE task IN {_CHOICE} OR task IN ('REC', 'SSR', 'CRR'))"""


@q(f"{_SCORED} SELECT record_id, task, score FROM scored")
def task_scores(spark, folder):
    return scored(spark, folder).select("record_id", "task", "score")


@q(f"{_SCORED} SELECT method, task, count(*) AS n, CAST(sum(score) AS BIGINT) AS hits, 100.0::DOUBLE * CAST(sum(score) AS BIGINT) / count(*) AS accuracy FROM scored GROUP BY method, task")
def task_accuracy(spark, folder):
    return evalkit.task_accuracy(scored(spark, folder), ["method"])


@q(
    f"""{_SCORED}, t AS (SELECT method, task, CAST(round_even(100.0::DOUBLE * CAST(sum(score) AS BIGINT) / count(*) * 1e9, 0) AS BIGINT) AS nano,
  CASE WHEN task IN ('EPM', 'ASI', 'HLD') THEN 'backward' WHEN task IN ('REC', 'SSR', 'CRR') THEN 'forward' ELSE 'realtime' END AS category FROM scored GROUP BY method, task),
c AS (SELECT method, category, CAST(round_even(CAST(sum(nano) AS BIGINT) / count(*) / 1e7::DOUBLE, 0) AS BIGINT) AS cents FROM t GROUP BY method, category),
w AS (SELECT method, max(CASE WHEN category = 'backward' THEN cents END) AS b, max(CASE WHEN category = 'realtime' THEN cents END) AS r, max(CASE WHEN category = 'forward' THEN cents END) AS f FROM c GROUP BY method)
SELECT method, b / 100 AS backward, r / 100 AS realtime, f / 100 AS forward, round_even((coalesce(b, 0) + coalesce(r, 0) + coalesce(f, 0)) / 3.0::DOUBLE, 0) / 100 AS overall FROM w"""
)
def accuracy_hierarchy(spark, folder):
    return evalkit.hierarchy(scored(spark, folder), ["method"])


@q(
    f"""WITH {_records('method', 'raw_response', 'ground_truth_letter')}, h AS (SELECT *, {_STRIP.format(x='upper(raw_response)')} AS r, {_STRIP.format(x='upper(ground_truth_letter)')} AS g FROM rec WHERE task = 'HLD'),
f AS (SELECT *, nullif(regexp_extract(r, '(?s)(?:^|{_E})([A-D])(?:{_E}|$)', 1), '') AS first FROM h)
SELECT record_id, CASE WHEN coalesce(raw_response, '') <> '' AND CASE WHEN first IS NOT NULL THEN first = g ELSE contains(r, g) END THEN 1 ELSE 0 END AS score,
       CASE WHEN coalesce({_STRIP.format(x='lower(ground_truth_letter)')}, '') <> '' AND contains(regexp_replace({_STRIP.format(x='lower(coalesce(raw_response, chr(0)))')}, '\\s+', ' ', 'g'), regexp_replace({_STRIP.format(x='lower(ground_truth_letter)')}, '\\s+', ' ', 'g')) THEN 1 ELSE 0 END AS open_score FROM f"""
)
def first_letter_scores(spark, folder):
    r = records(spark, folder, "method", "raw_response", "ground_truth_letter").filter("task = 'HLD'")
    a, g = F.col("raw_response"), F.col("ground_truth_letter")
    return r.select("record_id", answers.score_first_letter(a, g).alias("score"), answers.score_open(a, g).alias("open_score"))


# ---- roll-ups

_M = "CASE WHEN NOT isnan({x}) THEN CAST(round_even({x} * 1e6, 0) AS BIGINT) END"


def _mean(x: str) -> str:
    m = _M.format(x=x)
    return f"coalesce(CAST(sum({m}) AS BIGINT) / count({m}) / 1e6::DOUBLE, 0.0)"


def _mean_nonzero(x: str) -> str:
    m = _M.format(x=x)
    return f"coalesce(CAST(sum({m}) AS BIGINT), 0) / greatest(1, count_if({m} <> 0)) / 1e6::DOUBLE"


def _mean_or_zero(x: str) -> str:
    return f"CAST(sum(coalesce({_M.format(x=x)}, 0)) AS BIGINT) / count(*) / 1e6::DOUBLE"


_STATS = ("predictmem_stats.original_video_tokens", "predictmem_stats.kept_video_tokens", "predictmem_stats.keep_ratio_actual", "total_latency_s", "peak_memory_mb")


@q(
    f"""WITH d AS (SELECT DISTINCT record_id, method, total_latency_s, peak_memory_mb, predictmem_stats FROM run_records)
SELECT method, count_if(predictmem_stats IS NOT NULL) + count_if(NOT isnan(total_latency_s) AND total_latency_s <> 0) AS with_stats, {', '.join(f"{_mean_nonzero(f'CAST({x} AS DOUBLE)')} AS {x.split('.')[-1]}" for x in _STATS)} FROM d GROUP BY method"""
)
def nonzero_means(spark, folder):
    d = table(spark, folder, "run_records").select("record_id", "method", "total_latency_s", "peak_memory_mb", "predictmem_stats").distinct()
    n = F.count_if(F.col("predictmem_stats").isNotNull()) + F.count_if(~F.isnan("total_latency_s") & (F.col("total_latency_s") != 0))
    return d.groupBy("method").agg(n.alias("with_stats"), *[evalkit.mean_nonzero(F.col(x)).alias(x.split(".")[-1]) for x in _STATS])


_CORRECT = f"coalesce(correct, false) OR {_STRIP.format(x='lower(coalesce(predicted_answer, chr(32)))')} = {_STRIP.format(x='lower(coalesce(answer, chr(110) || chr(111) || chr(110) || chr(101)))')}"


@q(
    f"""WITH d AS (SELECT DISTINCT answer_id, task_type, correct, predicted_answer, answer, total_latency_s, peak_memory_mb FROM stream_answers)
SELECT CASE WHEN grouping(task_type) = 1 THEN 'overall' ELSE coalesce(task_type, 'unknown') END AS task_type, count(*) AS total, count_if({_CORRECT}) AS correct, count_if({_CORRECT}) / count(*) * 100 AS accuracy,
       {_mean("nullif(total_latency_s, 0)")} AS avg_latency_s, {_mean("nullif(peak_memory_mb, 0)")} AS avg_peak_memory_mb, {_mean("total_latency_s")} AS plain_latency_s
FROM d GROUP BY ROLLUP (task_type)"""
)
def accuracy_grouping_sets(spark, folder):
    d = table(spark, folder, "stream_answers").select("answer_id", "task_type", "correct", "predicted_answer", "answer", "total_latency_s", "peak_memory_mb").distinct()
    hit = F.count_if(answers.resolved(F.col("correct"), F.col("predicted_answer"), F.col("answer")))
    lat, mem = F.col("total_latency_s"), F.col("peak_memory_mb")
    return evalkit.overall_and_groups(
        d,
        "task_type",
        [
            F.count(F.lit(1)).alias("total"),
            hit.alias("correct"),
            (hit / F.count(F.lit(1)) * 100).alias("accuracy"),
            evalkit.mean(F.when(lat != 0, lat)).alias("avg_latency_s"),
            evalkit.mean(F.when(mem != 0, mem)).alias("avg_peak_memory_mb"),
            evalkit.mean(lat).alias("plain_latency_s"),
        ],
    )


SUMMARY = f"""WITH d AS (SELECT DISTINCT record_id, method, score, total_latency_s, peak_memory_mb, predictmem_stats FROM run_records)
SELECT method, count(*) AS n, CAST(sum(coalesce(score, 0)) AS BIGINT) AS total_score, {_mean_or_zero('total_latency_s')} AS avg_total_s, {_mean_or_zero('peak_memory_mb')} AS avg_peak_mb,
       {_mean_or_zero('CAST(predictmem_stats.kept_video_tokens AS DOUBLE)')} AS avg_kept FROM d GROUP BY method"""


@q(SUMMARY)
def method_summary(spark, folder):
    d = table(spark, folder, "run_records").select("record_id", "method", "score", "total_latency_s", "peak_memory_mb", "predictmem_stats").distinct()
    return d.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("score", F.lit(0))).alias("total_score"),
        evalkit.mean_or_zero(F.col("total_latency_s")).alias("avg_total_s"),
        evalkit.mean_or_zero(F.col("peak_memory_mb")).alias("avg_peak_mb"),
        evalkit.mean_or_zero(F.col("predictmem_stats.kept_video_tokens")).alias("avg_kept"),
    )


_RUN = ("score", "total_latency_s", "predictmem_scoring_latency_s", "expected_video_tokens", "kept")


def run_of(spark, folder, method: str) -> DataFrame:
    r = table(spark, folder, "run_records").filter(F.col("method") == method)
    return r.select("sample_id", "record_id", "ingested_at", F.col("predictmem_stats.kept_video_tokens").alias("kept"), *_RUN[:-1])


_LASTRUN = """{n} AS (SELECT * FROM (SELECT sample_id, score, total_latency_s, predictmem_scoring_latency_s, expected_video_tokens, predictmem_stats.kept_video_tokens AS kept,
  row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC, record_id DESC) AS rn FROM run_records WHERE method = '{m}') x WHERE rn = 1)"""
_R2 = "round_even(({a} / {b}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE"


def _ratio(a: str, b: str, otherwise: str) -> str:
    return f"CASE WHEN {b} IS NULL OR {b} <= 0 OR isnan({b}) OR {a} IS NULL OR isnan({a}) THEN {otherwise} ELSE {_R2.format(a=a, b=b)} END"


_SPEED = f"""WITH {_LASTRUN.format(n='bl', m='baseline')}, {_LASTRUN.format(n='pl', m='predictmem')}, j AS (
  SELECT pl.sample_id, CASE WHEN regexp_matches(pl.sample_id, '^[0-9]+$') THEN CAST(pl.sample_id AS BIGINT) ELSE 0 END AS sort_key, {_ratio('bl.total_latency_s', 'pl.total_latency_s', '0.0')} AS e2e_speedup,
         {_ratio('bl.total_latency_s', '(pl.total_latency_s - pl.predictmem_scoring_latency_s)', '0.0')} AS lm_speedup,
         {_ratio('CAST(pl.expected_video_tokens AS DOUBLE)', 'CAST(pl.kept AS DOUBLE)', '1.0')} AS compression, coalesce(bl.score, 0) AS base_score, coalesce(pl.score, 0) AS plugin_score
  FROM bl JOIN pl ON bl.sample_id = pl.sample_id)"""


def speedups(spark, folder) -> DataFrame:
    both = relational.compare_runs(run_of(spark, folder, "baseline"), run_of(spark, folder, "predictmem"), ["sample_id"], ["ingested_at", "record_id"], list(_RUN))
    base, total, rest = F.col("base_total_latency_s"), F.col("total_latency_s"), F.col("total_latency_s") - F.col("predictmem_scoring_latency_s")

    def ratio(a, b, otherwise):
        bad = b.isNull() | (b <= 0) | F.isnan(b) | a.isNull() | F.isnan(a)
        return F.when(bad, F.lit(otherwise)).otherwise(evalkit.rounded(a / b))

    return both.select(
        "sample_id",
        relational.numeric_order(F.col("sample_id")).alias("sort_key"),
        ratio(base, total, 0.0).alias("e2e_speedup"),
        ratio(base, rest, 0.0).alias("lm_speedup"),
        ratio(F.col("expected_video_tokens").cast("double"), F.col("kept").cast("double"), 1.0).alias("compression"),
        F.coalesce("base_score", F.lit(0)).alias("base_score"),
        F.coalesce("score", F.lit(0)).alias("plugin_score"),
    )


@q(f"{_SPEED} SELECT * FROM j")
def run_speedups(spark, folder):
    return speedups(spark, folder)


@q(f"{_SPEED} SELECT count(*) AS samples, {_mean('e2e_speedup')} AS avg_e2e_speedup, {_mean('lm_speedup')} AS avg_lm_speedup, {_mean('compression')} AS avg_compression, {_mean('CAST(base_score AS DOUBLE)')} AS avg_base_score, {_mean('CAST(plugin_score AS DOUBLE)')} AS avg_plugin_score FROM j")
def mean_speedups(spark, folder):
    s = speedups(spark, folder)
    cols = {"avg_e2e_speedup": "e2e_speedup", "avg_lm_speedup": "lm_speedup", "avg_compression": "compression", "avg_base_score": "base_score", "avg_plugin_score": "plugin_score"}
    return s.agg(F.count(F.lit(1)).alias("samples"), *[evalkit.mean(F.col(c)).alias(n) for n, c in cols.items()])


@q(
    f"""WITH d AS (SELECT DISTINCT record_id, method, total_latency_s, predictmem_scoring_latency_s, predictmem_stats FROM run_records),
m AS (SELECT method, {_mean_nonzero('total_latency_s')} AS total_s, {_mean_nonzero('predictmem_scoring_latency_s')} AS scoring_s, {_mean_nonzero('CAST(predictmem_stats.original_video_tokens AS DOUBLE)')} AS orig, {_mean_nonzero('CAST(predictmem_stats.kept_video_tokens AS DOUBLE)')} AS kept FROM d GROUP BY method),
b AS (SELECT total_s AS base_s FROM m WHERE method = 'baseline')
SELECT method, base_s / nullif(total_s, 0) AS e2e_speedup, base_s / nullif(total_s - scoring_s, 0) AS lm_speedup, orig / nullif(kept, 0) AS compression FROM m, b"""
)
def ratio_of_means(spark, folder):
    d = table(spark, folder, "run_records").select("record_id", "method", "total_latency_s", "predictmem_scoring_latency_s", "predictmem_stats").distinct()
    m = d.groupBy("method").agg(
        evalkit.mean_nonzero(F.col("total_latency_s")).alias("t"),
        evalkit.mean_nonzero(F.col("predictmem_scoring_latency_s")).alias("s"),
        evalkit.mean_nonzero(F.col("predictmem_stats.original_video_tokens")).alias("o"),
        evalkit.mean_nonzero(F.col("predictmem_stats.kept_video_tokens")).alias("k"),
    )
    base = F.max(F.when(F.col("method") == "baseline", F.col("t"))).over(Window.partitionBy(F.lit(1)))  # a row per method
    zero = lambda c: F.nullif(c, F.lit(0.0))
    return m.withColumn("b", base).select("method", (F.col("b") / zero(F.col("t"))).alias("e2e_speedup"), (F.col("b") / zero(F.col("t") - F.col("s"))).alias("lm_speedup"), (F.col("o") / zero(F.col("k"))).alias("compression"))


_AB = """w AS (SELECT video_path, target_frames, patch_loss_16x16 AS l, row_number() OVER (PARTITION BY video_path, target_frames ORDER BY scored_at, window_no) AS up,
         row_number() OVER (PARTITION BY video_path, target_frames ORDER BY scored_at DESC, window_no DESC) AS down FROM loss_windows WHERE scored_at IS NOT NULL),
ab AS (SELECT a.video_path, a.target_frames, a.l AS la, b.l AS lb FROM w a JOIN w b ON a.video_path = b.video_path AND a.target_frames = b.target_frames WHERE a.up = 1 AND b.down = 1),
g AS (SELECT video_path, target_frames, CAST(round_even(abs(la[i] - lb[i]) * 1e6, 0) AS BIGINT) AS gap FROM (SELECT *, unnest(range(1, least(len(la), len(lb)) + 1)) AS i FROM ab) z WHERE la[i] IS NOT NULL AND lb[i] IS NOT NULL AND NOT isnan(la[i]) AND NOT isnan(lb[i])),
each AS (SELECT video_path, target_frames, max(gap) AS top, CAST(sum(gap) AS BIGINT) / count(*) AS mean FROM g GROUP BY video_path, target_frames)"""


@q(f"WITH {_AB} SELECT video_path, count(*) AS windows, max(top) AS max_abs_diff, max(mean) AS max_mean_diff FROM each GROUP BY video_path")
def window_parity(spark, folder):
    """First and last scoring of the windows of a video, cell by cell."""
    w = table(spark, folder, "loss_windows").filter("scored_at IS NOT NULL")
    s = F.struct("scored_at", "window_no", F.col("patch_loss_16x16").alias("l"))
    both = w.groupBy("video_path", "target_frames").agg(F.min(s).alias("a"), F.max(s).alias("b"))
    pairs = both.select("video_path", "target_frames", F.explode(F.arrays_zip(F.col("a.l").alias("x"), F.col("b.l").alias("y"))).alias("p"))
    gap = evalkit.micro(F.abs(F.col("p.x") - F.col("p.y")))
    each = pairs.withColumn("gap", gap).filter("gap IS NOT NULL").groupBy("video_path", "target_frames").agg(F.max("gap").alias("top"), (F.sum("gap") / F.count("gap")).alias("mean"))
    return each.groupBy("video_path").agg(F.count(F.lit(1)).alias("windows"), F.max("top").alias("max_abs_diff"), F.max("mean").alias("max_mean_diff"))


@q("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def peak_stage(spark, folder):
    return evalkit.peak_stage(table(spark, folder, "events"), ["user_id"], "value", ["event_id"], ["event_id", "event_type"])


@q("SELECT method, predictmem_stats.window_mode AS mode, count(*) AS n FROM (SELECT DISTINCT record_id, method, predictmem_stats FROM run_records) GROUP BY ALL")
def mode_histogram(spark, folder):
    r = table(spark, folder, "run_records").select("record_id", "method", "predictmem_stats").distinct()
    return r.groupBy("method", F.col("predictmem_stats.window_mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@q(
    f"""WITH {_records('method', 'score', 'written_at', 'total_latency_s')}, h AS (SELECT * FROM rec WHERE task = 'HLD')
SELECT record_id, method, count(*) OVER w AS seen, CAST(sum(coalesce(score, 0)) OVER w AS BIGINT) / count(*) OVER w AS accuracy, CAST(sum(coalesce({_M.format(x='total_latency_s')}, 0)) OVER w AS BIGINT) / count(*) OVER w / 1e6::DOUBLE AS mean_value
FROM h WINDOW w AS (PARTITION BY method ORDER BY written_at, record_id ROWS UNBOUNDED PRECEDING)"""
)
def running_accuracy(spark, folder):
    r = records(spark, folder, "method", "score", "written_at", "total_latency_s").filter("task = 'HLD'")
    return evalkit.running_accuracy(r, ["method"], ["written_at", "record_id"], F.col("score"), F.col("total_latency_s")).select("record_id", "method", "seen", "accuracy", "mean_value")


@q(f"WITH {_PATCHES}, b AS (SELECT *, min(loss) OVER (PARTITION BY stream) AS lo, max(loss) OVER (PARTITION BY stream) AS hi FROM patches) SELECT stream, tubelet, idx, CASE WHEN hi > lo THEN CAST(trunc((loss - lo) / (hi - lo) * 255) AS INT) ELSE 0 END AS heat FROM b")
def heat_map(spark, folder):
    return evalkit.heat(patches(spark, folder), ["stream"], "loss").select("stream", "tubelet", "idx", "heat")


# ---- joins, sets and partitioning


@q(f"WITH {_SAMPLES}, v AS (SELECT DISTINCT video FROM run_records) SELECT s.id, v.video IS NOT NULL AS found FROM samples s LEFT JOIN v ON s.video = v.video")
def samples_with_files(spark, folder):
    here, gone = relational.with_files(samples(spark, folder).select("id", "video"), table(spark, folder, "run_records").select("video"), "video")
    return here.select("id", F.lit(True).alias("found")).unionByName(gone.select("id", F.lit(False).alias("found")))


@q(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS s, event_type FROM events)
SELECT q.event_id AS question, f.event_id AS frame FROM e q JOIN e f ON f.user_id = q.user_id AND f.s BETWEEN greatest(0.0, q.s - 3600) AND q.s WHERE q.event_type = 'purchase'"""
)
def clip_range_join(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"))
    ask = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("question"), "user_id", F.col("s").alias("at"))
    return relational.clip_join(e.select(F.col("event_id").alias("frame"), "user_id", "s"), ask, "user_id", "s", "at", 3600.0).select("question", "frame")


@q(
    """WITH r AS (SELECT DISTINCT video AS video_path, num_frames FROM run_records WHERE num_frames > 0), t AS (SELECT video_path, unnest(range((n + 1) // 2)) AS tubelet FROM (SELECT video_path, max(num_frames) AS n FROM r GROUP BY video_path)),
c AS (SELECT video_path, target_frames[1] // 2 AS tubelet, max(scored_at) AS scored_at FROM loss_windows GROUP BY ALL)
SELECT t.video_path, count(*) AS requested, count(c.tubelet) AS hits, count(*) - count(c.tubelet) AS misses FROM t LEFT JOIN c ON t.video_path = c.video_path AND t.tubelet = c.tubelet GROUP BY t.video_path"""
)
def cache_hits(spark, folder):
    n = table(spark, folder, "run_records").filter("num_frames > 0").groupBy(F.col("video").alias("video_path")).agg(F.max("num_frames").cast("bigint").alias("n"))
    want = n.select("video_path", grid.div(F.col("n") + 1, 2).alias("size"))
    have = table(spark, folder, "loss_windows").groupBy("video_path", F.expr("get(target_frames, 0) div 2").alias("tubelet")).agg(F.max("scored_at").alias("scored_at"))
    hit, miss = relational.cache_split(want, have, ["video_path"], "tubelet", "size")
    both = hit.select("video_path", F.lit(1).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("m")).unionByName(
        miss.select("video_path", F.lit(0).cast("bigint").alias("h"), (F.col("end") - F.col("first")).alias("m"))
    )
    return both.groupBy("video_path").agg((F.sum("h") + F.sum("m")).alias("requested"), F.sum("h").alias("hits"), F.sum("m").alias("misses"))


@q("SELECT sample_id, 'a' AS side FROM (SELECT sample_id FROM ledger_a EXCEPT SELECT sample_id FROM ledger_b) UNION ALL SELECT sample_id, 'b' FROM (SELECT sample_id FROM ledger_b EXCEPT SELECT sample_id FROM ledger_a)")
def unmatched_ids(spark, folder):
    return relational.unmatched(table(spark, folder, "ledger_a"), table(spark, folder, "ledger_b"), ["sample_id"])


@q(f"WITH {_PATCHES}, w AS (SELECT DISTINCT stream, tubelet FROM patches), o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY tubelet) - 1 AS o, count(*) OVER (PARTITION BY stream) AS n FROM w) SELECT stream, tubelet FROM o WHERE n <= 3 OR o IN (0, CAST(trunc(1 * ((n - 1) / 2.0::DOUBLE)) AS BIGINT), CAST(trunc(2 * ((n - 1) / 2.0::DOUBLE)) AS BIGINT))")
def sampled_windows(spark, folder):
    w = patches(spark, folder).select("stream", "tubelet").distinct()
    return relational.sample_ordinals(w, [F.col("tubelet")], ["stream"], 3)


@q("SELECT o_orderkey, least((row_number() OVER (ORDER BY o_orderkey) - 1) // (count(*) OVER () // 7), 6) AS shard FROM orders")
def range_split(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    return relational.range_split(o, [F.col("o_orderkey")], 7, o.count())


_LPT = f"""WITH RECURSIVE {_SAMPLES}, r AS (SELECT id, task, CASE WHEN task IN ('REC', 'SSR', 'CRR') THEN coalesce(len(test_info), 0) ELSE 1 END AS weight FROM samples),
it AS (SELECT *, row_number() OVER (ORDER BY weight DESC, id) AS rn FROM r),
g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS shard, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
  UNION ALL SELECT n, p - 1, [CASE WHEN i = p THEN loads[i] + w ELSE loads[i] END for i in range(1, 6)]
  FROM (SELECT it.rn AS n, loads, CAST(list_position(loads, list_min(loads)) AS BIGINT) AS p, it.weight AS w FROM g JOIN it ON it.rn = g.rn + 1)),
placed AS (SELECT it.id, it.task, it.weight, CAST(g.shard AS INT) AS shard FROM it JOIN g ON it.rn = g.rn)"""


@q(f"{_LPT} SELECT id, task, weight, shard FROM placed")
def lpt_shards(spark, folder):
    """Samples by weight (checks of a forward task, else 1) over five shards."""
    s = samples(spark, folder)
    w = F.when(F.col("task").isin(*prompts.FORWARD), F.size(F.coalesce("test_info", F.array()))).otherwise(1)
    return relational.lpt_shards(s.select("id", "task", w.alias("weight")), "weight", ["id"], 5)



@q(f"WITH {_SAMPLES}, r AS (SELECT id, CASE WHEN task IN ('REC', 'SSR', 'CRR') THEN coalesce(len(test_info), 0) ELSE 1 END AS weight FROM samples) SELECT weight, count(*) AS n FROM r GROUP BY weight")
def shard_weights(spark, folder):
    return lpt_shards(spark, folder).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


@q(f"{_LPT} SELECT shard, task, count(*) AS n, CAST(sum(weight) AS BIGINT) AS load FROM placed GROUP BY shard, task")
def shard_tasks(spark, folder):
    """Tasks per shard, and each shard's load."""
    return lpt_shards(spark, folder).groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("load"))



@q(f"WITH {_SAMPLES} SELECT id, task FROM samples WHERE task IN ('OCR', 'HLD', 'REC') AND id % 2 = 1 ORDER BY id LIMIT 100")
def task_filter(spark, folder):
    """Samples of some tasks and ids, the first hundred by id: the limit is the feature."""
    return samples(spark, folder).filter(F.col("task").isin("OCR", "HLD", "REC") & (F.col("id") % 2 == 1)).orderBy("id").limit(100).select("id", "task")


@q("SELECT DISTINCT CAST(id AS VARCHAR) AS id FROM task_samples ORDER BY id")
def distinct_ids(spark, folder):
    return table(spark, folder, "task_samples").select(F.col("id").cast("string")).distinct().orderBy("id")


@q("SELECT DISTINCT record_id, coalesce(video, '') || '|' || coalesce(stream_mode, '') || '|' || coalesce(CAST(frame_budget AS VARCHAR), '') || '|' || coalesce(CAST(num_frames AS VARCHAR), '') AS cache_key FROM run_records")
def cache_keys(spark, folder):
    c = F.col
    return table(spark, folder, "run_records").select("record_id", prompts.cache_key([c("video"), c("stream_mode"), c("frame_budget"), c("num_frames")]).alias("cache_key")).distinct()


def queries():
    return q.queries


def oracle_sql():
    return q.sql
