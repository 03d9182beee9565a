import random
from datetime import datetime

import numpy as np
import pytest

from keepstream.llm import endings, language, pair_defects, truncation
from keepstream.llm.endings import CLOSED, OPEN, UNSURE

OPTIONS = "the dog\ta red bucket on the lower shelf"


@pytest.mark.parametrize(
    "text",
    [None, "", "  ", "A", "b.", "(C)", "**D**", " B\n", "A ✅", "7", "5 times", "2 veces", "Yes", "Oui", "No!", "いいえ", "还没有", "Answer: A", "Final answer: C", "B. the dog", "the dog",
     "B. a red bucket on the lower shelf", "A whole sentence.", "Two. Sentences!", '{"answer": "A"}', '{"answer": "A", "reason": "It is so."}', "<think>\nSo it is.\n</think>\n\nB",
     'The sign says "EXIT 4".', "正解はAです。", "null", "...", "…", "```\n```", "No, todavía no", '"KEEP DRY"', "It is seen (at 5:10).", "<answer></answer>", "<answer>B</answer>"],
)
def test_whole_answers(text):
    assert endings.end_state(text, OPTIONS, "What is it?")[0] == CLOSED


@pytest.mark.parametrize(
    "text",
    ["The answer is A. Then the man mov", "<think>\nSo it is.", "<think>\nSo it is.\n</thin", '{"answer": "A", "reason": "It is so.', "```\nA whole sentence.",
     'It is so. The sign says "EXIT', "It is seen (at 5:1", "It is A. And th…(+307)", "It is A. And th [...]", "It is A. And th…", "It is A. And th�", "It is A. And th\\", "It is A. And th\n", "It is A. And wh...",
     "A,", "No, ", "A. the dog and", "正解はAです。その後、庭師はは", "B. a red bucket on the low", "What does the driver of the van do right aft"],
)
def test_cut_answers(text):
    assert endings.end_state(text, "a red bucket on the lower shelf\tthe dog and the cat over there", "What does the driver of the van do right after?")[0] == OPEN


def test_unsure_answers():
    assert endings.end_state("the phone", None, None) == (UNSURE, "the phone")
    assert endings.end_state("red cup on the left table", None, None)[0] == UNSURE
    assert endings.end_state("B. the", "the dog\tthe cat", None)[0] == OPEN
    assert endings.end_state("The kettle", None, "The kettle: where is it?")[0] == UNSURE
    for text in ('The 6" pipe.', "5' 10\"", 'It says "EXIT 4".'):
        assert endings.end_state(text)[0] != OPEN
    for text in ('It says "EXIT 4', 'It says "EXIT 4" and "GO', 'A 6" pipe. It says "GO'):
        assert endings.end_state(text)[0] == OPEN


def test_terminality(spark):
    df = spark.createDataFrame([("See the phone. See the mug.",)] * 9 + [(None,), ("",)], "text string")
    table = truncation.terminality(df)
    assert table.whole("phone") and not table.whole("the") and not table.whole("unseen")
    assert not truncation.terminality(df.limit(0)).whole("phone")
    letters = spark.createDataFrame([("A.",), ("The answer is A.",), ("See a phone.",)] * 9, "text string")
    assert not truncation.terminality(letters).whole("a")


def test_a_slot_shared_with_another_word():
    import numpy as np

    total, final = np.zeros(2 * truncation.SLOTS), np.zeros(2 * truncation.SLOTS)
    first, _ = truncation.slots("optio")
    total[first], final[first] = 1000, 900  # another word's counts, in one table only
    assert not truncation.TerminalityTable(total, final).whole("optio")


def long_text(rng, n=60):
    return " ".join(f"word{rng.randrange(3000)}" for _ in range(n))


def record_rows(texts):
    return [(i, f"w{i % 3}", datetime(2031, 1, 1), t, None, None, 1, "x") for i, t in enumerate(texts)]


RECORDS = "id bigint, source string, delivered_at timestamp, text string, options string, question string, h int, bands string"


def test_band_keys_find_near_copies():
    rng = random.Random(0)
    hits = 0
    for _ in range(200):
        a = long_text(rng, 100)
        b = " ".join(a.split()[:92])
        _, keys = truncation.band_keys([a, "too short", None, b])
        assert truncation.similarity(a, b) >= 0.8
        hits += bool((keys[0] == keys[1]).any())
    assert hits >= 190
    which, keys = truncation.band_keys(["one two three four", None, ""])
    assert len(which) == 0 and keys.shape == (0, truncation.BANDS)


def test_cut_records(spark):
    rng = random.Random(2)
    full = long_text(rng) + "."
    texts = [full, full[:-20], full, "A", None, "", "t" * 300_000, "It ends here. And goes o", *["the phone"] * 2, "See the phone."]
    rows = record_rows(texts) + [(0, "w0", datetime(2031, 1, 2), full[:-30], None, None, 1, "x")]
    df = spark.createDataFrame(rows, RECORDS)
    cut = {r["id"]: r["cut"] for r in truncation.cut_records(df).collect()}
    assert sorted(i for i, c in cut.items() if c) == [0, 1, 6, 7] or sorted(i for i, c in cut.items() if c) == [0, 1, 7]
    assert len(cut) == len(texts)
    shares = {r["source"]: r for r in truncation.cut_shares(truncation.cut_records(df)).collect()}
    assert sum(r["records"] for r in shares.values()) == len(texts)
    assert truncation.cut_records(df.limit(0)).collect() == []


def test_early_copies_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        t = long_text(rng, 80)
        texts += [t, t, t[: len(t) - rng.randrange(1, 30)]] if rng.random() < 0.6 else [t]
    texts += [texts[0]] * 30
    df = spark.createDataFrame(record_rows(texts), RECORDS)
    from pyspark.sql import functions as F
    import numpy as np

    which, keys = truncation.band_keys(texts)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    marked = spark.createDataFrame([(hashes[texts[i]], len(texts[i]), [int(x) for x in k.view(np.int64)]) for i, k in zip(which, keys)], "h bigint, size int, bands array<bigint>")
    got = {r["h"] for r in truncation.early_copies(marked, df.select(F.xxhash64("text").alias("h"), "text")).collect()}
    want = {hashes[a] for a in set(texts) for b in set(texts) if a != b and truncation.ends_early(a, b)}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("text,want", [("Der Mann geht in das Haus und nimmt die Leiter.", "de"), ("The man goes into the house.", "en"), ("L'homme ouvre le tiroir de gauche.", "fr"), ("El hombre abre el cajón de la mesa.", "es"), ("O homem abre a gaveta embaixo da mesa.", "pt"), ("男の人がまな板を洗います。", "ja"), ("厨师打开砧板。", "zh"), ("Мужчина идёт домой", "ru"), ("A", "en"), ("12", None), (None, None)])
def test_languages(text, want):
    assert language.language(text) in (want, None) if text == "A" else language.language(text) == want


Q = "Where is the kettle when the mechanic closes the ladder?"
CASES = [
    (None, []),
    ("", ["empty"]),
    ("​", ["empty"]),
    ("...", ["empty"]),
    ("—", ["empty"]),
    ("```\n```", ["empty"]),
    ("<answer></answer>", ["empty"]),
    ('{"answer": ""}', ["empty"]),
    ("<think>\n\n</think>\n\n", ["empty"]),
    ("N/A", ["empty"]),
    (Q, ["copies_question"]),
    (Q.upper().rstrip("?"), ["copies_question"]),
    (f"**{Q}**\n{Q}", ["copies_question"]),
    (f"You asked: {Q}", ["copies_question"]),
    (f"Question: {Q}\nOptions:\nA. the dog; B. a cat;\n\nRespond only with the letter corresponding to your chosen option.", ["copies_question"]),
    (f"{Q} The answer is A.", []),
    (f"{Q} A. the dog", []),
    ("The kettle is on the she", ["abrupt"]),
    ("I'm sorry, but I cannot assist with questions about people in footage.", ["refusal"]),
    ("Content declined by policy.", ["refusal"]),
    ("Désolé, je ne peux pas répondre à cette question.", ["refusal", "other_language"]),
    ("I'm sorry for the long description, but the dog also moves. It is A.", []),
    ("Although the cook cannot reach the kettle, the view stays clear. It is A.", []),
    ("Sorry, my first count was off; it is 4.", []),
    ("正解はAです。", ["other_language"]),
    ("La respuesta correcta es B. El mecánico abre la escalera.", ["other_language"]),
    ('The label reads "出口" and hangs by the fence.', []),
    ("A", []),
    ("7", []),
    ("B ✅", []),
]


#: A table of nothing that takes unknown words for whole.
TABLE = truncation.TerminalityTable(np.zeros(2 * truncation.SLOTS), np.zeros(2 * truncation.SLOTS))
TABLE.unseen = 1.0


@pytest.mark.parametrize("text,want", CASES)
def test_defects(text, want):
    got = pair_defects.defects(Q, "the dog\ta cat", text, TABLE.whole)
    assert got == (want if text is not None else ["empty"])


def test_ideographs_of_either_language():
    ask = "庭師ははしごを拭いた後、何をしますか？"
    assert pair_defects.defects(ask, None, "D. 料理人", lambda w: True) == []
    assert pair_defects.defects(ask, None, "正确答案是A。随后厨师打开砧板并离开。", lambda w: True) == ["other_language"]


def test_blank_question_has_no_language_and_no_copy():
    assert pair_defects.defects("", None, "正解はAです。", lambda w: True) == []
    assert pair_defects.defects(None, None, "Yes.", lambda w: True) == []


def test_pair_table(spark):
    t = [datetime(2031, 1, d) for d in (1, 2)]
    rows = [("s", i, Q, "the dog\ta cat", x, t[0], "k") for i, (x, _) in enumerate(CASES)]
    rows += [("s", 9000, Q, None, "", t[0], "k"), ("s", 9000, Q, None, "A", t[1], "k"), ("s", None, Q, None, "", t[0], "k"), ("s", None, Q, None, "", t[0], "k"), ("s", 9001, None, None, "x" * 200_000 + ".", t[0], "k")]
    df = spark.createDataFrame(rows, "src string, pair_id bigint, question string, options string, response string, delivered_at timestamp, mask string")
    got = {r["pair_id"]: r["defects"] for r in pair_defects.pair_defects(df).collect()}
    want = {i: w if x is not None else ["empty"] for i, (x, w) in enumerate(CASES) if w or x is None} | {None: ["empty"]}
    assert got == want
    assert pair_defects.pair_defects(df.limit(0)).collect() == []
