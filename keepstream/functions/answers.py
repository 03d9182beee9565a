"""Reading and scoring of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepstream.functions.prompts import CHOICE

#: Patterns of an answer's letter, tried in this order.
CASCADE = (r"option\s*([A-D])", r"([A-D])\s*is\s*the\s*best", r"answer\s*is\s*([A-D])", r"([A-D])\)", r"^([A-D])$", r"option is\s*([A-D])", r"\(([A-D])\)")
#: The shorter cascade.
SHORT_CASCADE = (r"answer is ([A-D])", r"^([A-D])[\.:\s]", r"\(([A-D])\)")
#: Word edges over all scripts' letters and digits.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def found(col: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def extract_letter(response: Column) -> Column:
    """The letter an answer gives: the first pattern that matches, in any case, else the first capital A to D."""
    t = strip(response)
    return F.coalesce(*[F.upper(found(t, f"(?i){p}")) for p in CASCADE], found(t, "([A-D])"))


def extract_letter_short(response: Column) -> Column:
    t = strip(response)
    return F.coalesce(*[F.upper(found(t, f"(?i){p}")) for p in SHORT_CASCADE], found(t, "^([A-D])"), found(t, "([A-D])"))


def contains_truth(response: Column, truth: Column) -> Column:
    """1 if the answer contains the truth, case aside. An empty truth is in every non-empty answer."""
    said = F.coalesce(F.length(response) > 0, F.lit(False))
    return (said & F.coalesce(F.contains(F.upper(response), F.upper(truth)), F.lit(False))).cast("int")


def digits_equal(response: Column, count: Column) -> Column:
    """1 if all digits of the answer, one after another, are the count."""
    d = F.array_join(F.regexp_extract_all(response, F.lit(r"([0-9]+)"), F.lit(1)), "")
    return F.coalesce((d != "") & (d == count.cast("string")), F.lit(False)).cast("int")


def yes_no(response: Column, kind: Column) -> Column:
    """1 for N with 0 or Y with 1, else whether the answer contains no or yes."""
    r, said = F.upper(response), F.coalesce(F.length(response) > 0, F.lit(False))
    exact = ((r == "N") & (kind == 0)) | ((r == "Y") & (kind == 1))
    word = F.when(F.coalesce(kind == 0, F.lit(False)), F.lower(response).contains("no")).otherwise(F.lower(response).contains("yes"))
    return (said & (F.coalesce(exact, F.lit(False)) | F.coalesce(word, F.lit(False)))).cast("int")


def parse(raw: Column, task: Column, options: Column) -> Column:
    """An answer by its task's family: a letter, Yes or No by what comes first, a number, or the text."""
    t = strip(raw)
    letter = F.upper(F.regexp_extract(t, f"(?i){BEFORE}([A-D]){AFTER}", 1))
    yes, no = (F.regexp_instr(t, F.lit(f"(?i){BEFORE}(?:{w}){AFTER}")) for w in ("yes|y", "no|n"))
    word = (
        F.when((yes > 0) & ((no == 0) | (yes < no)), "Yes").when(no > 0, "No").otherwise("")
    )
    number = F.regexp_extract(t, f"{BEFORE}([0-9]+){AFTER}", 1)
    has = F.coalesce(F.size(options) > 0, F.lit(False))
    return F.when(task.isin(*CHOICE) & has, letter).when(task.isin("SSR", "CRR"), word).when(task == "REC", number).otherwise(t)


def squeeze(col: Column) -> Column:
    return F.regexp_replace(strip(F.lower(col)), r"\s+", " ")


def score_parsed(parsed: Column, truth: Column, task: Column) -> Column:
    """1 if a parsed answer equals the truth, or, as open text, contains it."""
    ok = (F.length(parsed) > 0) & (F.length(truth) > 0)
    hit = (
        F.when(task.isin(*CHOICE), F.upper(parsed) == strip(F.upper(truth)))
        .when(task.isin("SSR", "CRR"), strip(F.lower(parsed)) == strip(F.lower(truth)))
        .when(task == "REC", strip(parsed) == strip(truth))
        .otherwise((squeeze(truth) != "") & squeeze(parsed).contains(squeeze(truth)))
    )
    return (F.coalesce(ok, F.lit(False)) & F.coalesce(hit, F.lit(False))).cast("int")


def score_first_letter(response: Column, truth: Column) -> Column:
    """1 if the first standalone letter A to D is the truth; without one, if the answer contains it."""
    r, g = F.upper(strip(response)), F.upper(strip(truth))
    first = found(r, f"{BEFORE}([A-D]){AFTER}")
    said = F.coalesce(F.length(response) > 0, F.lit(False))
    return (said & F.coalesce(F.when(first.isNotNull(), first == g).otherwise(F.contains(r, g)), F.lit(False))).cast("int")


def score_open(prediction: Column, truth: Column) -> Column:
    """1 if the truth is in the prediction, case and spacing aside."""
    p, g = squeeze(F.coalesce(prediction, F.lit(""))), squeeze(F.coalesce(truth, F.lit("")))
    return ((g != "") & (p != "") & F.contains(p, g)).cast("int")


def resolved(correct: Column, predicted: Column, answer: Column) -> Column:
    """Whether an answer counts as correct: marked so, or equal to the key, case aside; no prediction is ''."""
    same = strip(F.lower(F.coalesce(predicted, F.lit("")))) == strip(F.lower(F.coalesce(answer, F.lit("none"))))
    return F.coalesce(correct, F.lit(False)) | same
