import pytest
from pyspark.sql import functions as F

from keepstream.functions import answers, prompts
from keepstream.plans import evalkit
from keepstream.sources import readers, writers


def one(spark, value, col, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,letter",
    [("option b is it", "B"), ("C is the best", "C"), ("The answer is d.", "D"), ("(A)", "A"), ("b", "B"), ("I think B", "B"), ("option available", "A"), ("nothing", None), ("", None), (None, None), ("the C one", "C")],
)
def test_letters(spark, text, letter):
    assert one(spark, text, answers.extract_letter(F.col("x"))) == letter


@pytest.mark.parametrize("text,truth,score", [("B.", "b", 1), ("know", "no", 1), ("x", "", 1), ("", "A", 0), (None, "A", 0)])
def test_containment(spark, text, truth, score):
    df = spark.createDataFrame([(text, truth)], "r string, g string")
    assert df.select(answers.contains_truth(F.col("r"), F.col("g")).alias("s")).first()["s"] == score


@pytest.mark.parametrize("text,count,score", [("3", 3, 1), ("1 and 2", 12, 1), ("none", 0, 0), ("03", 3, 0)])
def test_counts(spark, text, count, score):
    df = spark.createDataFrame([(text, count)], "r string, c int")
    assert df.select(answers.digits_equal(F.col("r"), F.col("c")).alias("s")).first()["s"] == score


@pytest.mark.parametrize("text,kind,score", [("N", 0, 1), ("y", 1, 1), ("I know", 0, 1), ("Yes", 1, 1), ("No", 1, 0), (None, 0, 0)])
def test_yes_no(spark, text, kind, score):
    df = spark.createDataFrame([(text, kind)], "r string, k int")
    assert df.select(answers.yes_no(F.col("r"), F.col("k")).alias("s")).first()["s"] == score


@pytest.mark.parametrize("text,want", [("No, but yes", "No"), ("Yes or no", "Yes"), ("known", ""), ("noです", "")])
def test_parse_words(spark, text, want):
    df = spark.createDataFrame([(text, "CRR", [])], "r string, t string, o array<string>")
    assert df.select(answers.parse(F.col("r"), F.col("t"), F.col("o")).alias("p")).first()["p"] == want


@pytest.mark.parametrize("stamp,seconds", [("01:02", 62), ("1:00:05", 3605), (None, None)])
def test_times(spark, stamp, seconds):
    assert one(spark, stamp, prompts.seconds(F.col("x"))) == seconds


def test_bad_time_is_an_error(spark):
    with pytest.raises(Exception, match="invalid time"):
        one(spark, "12", prompts.seconds(F.col("x")))


@pytest.mark.parametrize(
    "text,options",
    [("['A. x', \"B's\"]", ["A. x", "B's"]), ("a\n b \n\n", ["a", "b"]), ("nan", None), (None, None), ("", None), ("['it\\'s']", ["it's"]), ("__import__('os')", ["__import__('os')"])],
)
def test_options(spark, text, options):
    assert one(spark, text, prompts.parse_options(F.col("x"))) == options


def test_options_get_their_letters_once(spark):
    assert one(spark, ["A. x", "y", "C) z"], prompts.lettered_once(F.col("x")), "array<string>") == ["A. x", "B. y", "C) z"]


def test_ids_and_letters(spark):
    assert one(spark, "rt_6_672", prompts.id_token(F.col("x"))) == "6"
    assert one(spark, "single", prompts.id_token(F.col("x"))) is None
    assert one(spark, 2, prompts.letter(F.col("x")), "int") == "C"


def test_means(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,), (float("nan"),), (3.0,)], "x double")
    r = df.agg(evalkit.mean(F.col("x")).alias("a"), evalkit.mean_nonzero(F.col("x")).alias("b"), evalkit.mean_or_zero(F.col("x")).alias("c")).first()
    assert (round(r["a"], 6), r["b"], r["c"]) == (round(4 / 3, 6), 2.0, 0.8)
    assert df.limit(0).agg(evalkit.mean(F.col("x")).alias("a")).first()["a"] == 0.0


def test_missing_category_adds_nothing(spark):
    df = spark.createDataFrame([("m", "EPM", 1), ("m", "ASI", 0), ("m", "STU", 1)], "method string, task string, score int")
    r = evalkit.hierarchy(df, ["method"]).first()
    assert (r["backward"], r["realtime"], r["forward"], r["overall"]) == (50.0, 100.0, None, 50.0)


def test_decoding_reads_only_planned_frames(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(range(10)))
    path = readers.listed(spark, str(tmp_path), "*.raw").first()["path"]
    plan = spark.createDataFrame([(path, 0, 3), (path, 1, 7)], "path string, frame_idx int, source_index bigint")
    asked = readers.decode(spark, str(tmp_path), plan, lambda content, frames: [[float(content[i])] for i in frames], "*.raw")
    assert [(r["frame_idx"], r["value"]) for r in asked.orderBy("frame_idx").collect()] == [(0, [3.0]), (1, [7.0])]


def test_reports_do_not_cut(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.write_report(spark, spark.range(5), str(tmp_path / "r"), "t", most=3)
    _, table = writers.write_report(spark, spark.range(2), str(tmp_path / "r"), "t")
    assert "| id |" in table


def test_cache_upsert(spark, tmp_path):
    new = lambda rows: spark.createDataFrame(rows, "k int, v string")
    a = writers.put_scores(None, new([(1, "a"), (2, "b")]), ["k"], str(tmp_path / "c"))
    b = writers.put_scores(a, new([(2, "B"), (3, "c")]), ["k"], str(tmp_path / "c"))
    assert sorted((r["k"], r["v"]) for r in b.collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_json_lines_skip_blanks(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"sample_id": "1", "task": "EPM"}\n\n{"sample_id": "2"}\n')
    assert readers.json_lines(spark, str(tmp_path)).filter("sample_id IS NOT NULL").count() == 2
    assert readers.shard_lines(spark, f"{tmp_path}/*.json", "x").count() == 1
    assert readers.shard_lines(spark, f"{tmp_path}/*.json", "x", excluded="x.").count() == 0
