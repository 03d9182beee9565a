"""Prompts of question samples, and their options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Task codes by family.
BACKWARD = ("EPM", "ASI", "HLD")
REALTIME = ("STU", "OJR", "ATR", "ACR", "OCR", "FPD")
FORWARD = ("REC", "SSR", "CRR")
CHOICE = BACKWARD + REALTIME

#: The wording of the prompts.
QUESTION = "Question: "
OPTIONS = "\nOptions:\n"
LETTER_ONLY = "\n\nRespond only with the letter corresponding to your chosen option (e.g., A, B, C).\nDo not include any additional text or explanation in your response."
LETTER_ONLY_HEAD = "\n\nRespond only with the letter corresponding to your chosen option (e.g., "
LETTER_ONLY_TAIL = ").\nDo not include any additional text or explanation in your response."
NUMBER_HEAD = "How many times was "
NUMBER_TAIL = " performed in the video?\n\nRespond only with a number.\nDo not include any additional text or explanation in your response."
STEP_HEAD = "Is the following step being performed at the indicated time?\nStep: "
YES_NO_TAIL = "\n\nRespond only with Yes or No.\nDo not include any additional text or explanation in your response."
YES_NO_ONLY = "Respond only with Yes or No."
CONCISE = "\n\nAnswer concisely."
CONCISE_WORDS = "\n\nAnswer concisely in a few words."
DESCRIBE = "Describe what is happening in the video."


def text(col: Column, otherwise: str = "") -> Column:
    return F.coalesce(col, F.lit(otherwise))


def letter(i: Column) -> Column:
    """A for 0, B for 1 and so on; null for null."""
    return F.when(i.isNotNull(), F.char(F.lit(65) + i))


def lettered(options: Column) -> Column:
    return F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), text(o)))


def task_prompt(task: Column, question: Column, options: Column, activity: Column, step: Column) -> Column:
    """The prompt of a sample by its task; forward tasks ask about an activity, a step or the question."""
    opts = F.coalesce(options, F.array().cast("array<string>"))
    choice = F.concat(F.lit(QUESTION), text(question), F.lit(OPTIONS), F.array_join(lettered(opts), "; "), F.lit(";"), F.lit(LETTER_ONLY))
    return (
        F.when(task.isin(*CHOICE), choice)
        .when(task == "REC", F.concat(F.lit(NUMBER_HEAD), text(activity, "the action"), F.lit(NUMBER_TAIL)))
        .when(task == "SSR", F.concat(F.lit(STEP_HEAD), text(step, "this step"), F.lit(YES_NO_TAIL)))
        .when(task == "CRR", F.concat(F.lit(QUESTION), text(question), F.lit(YES_NO_TAIL)))
        .otherwise(F.concat(F.lit(QUESTION), text(question), F.lit(CONCISE)))
    )


def choice_prompt(question: Column, options: Column) -> Column:
    """The prompt with the letters there are named as examples, three at most."""
    names = F.transform(F.slice(options, 1, 3), lambda o, i: F.char(F.lit(65) + i))
    return F.concat(
        F.lit(QUESTION), text(question), F.lit(OPTIONS), F.array_join(lettered(options), "; "), F.lit(LETTER_ONLY_HEAD), F.array_join(names, ", "), F.lit(LETTER_ONLY_TAIL)
    )


def sample_prompt(task: Column, question: Column, options: Column, activity: Column, info: Column) -> Column:
    """The scripts' prompt: choice only with options, yes-no by question or first step."""
    has = F.coalesce(F.size(options) > 0, F.lit(False))
    asked = F.coalesce(F.length(question) > 0, F.lit(False))
    step = F.when(F.size(info) > 0, F.concat(F.lit(STEP_HEAD), text(F.get(info, F.lit(0))["step"], "this step"), F.lit(YES_NO_TAIL))).otherwise(F.lit(YES_NO_ONLY))
    return (
        F.when(task.isin(*CHOICE) & has, choice_prompt(question, options))
        .when(task.isin("SSR", "CRR"), F.when(asked, F.concat(F.lit(QUESTION), question, F.lit(YES_NO_TAIL))).otherwise(step))
        .when(task == "REC", F.concat(F.lit(NUMBER_HEAD), text(activity, "the action"), F.lit(NUMBER_TAIL)))
        .otherwise(F.when(asked, F.concat(F.lit(QUESTION), question, F.lit(CONCISE_WORDS))).otherwise(F.lit(DESCRIBE)))
    )


def single_prompt(task: Column, question: Column, options: Column) -> Column:
    """The prompt of a single sample: choice with options outside the forward tasks, else a short answer."""
    has = F.coalesce(F.size(options) > 0, F.lit(False)) & ~F.coalesce(task.isin(*FORWARD), F.lit(False))
    return F.when(has, choice_prompt(question, options)).otherwise(F.concat(F.lit(QUESTION), text(question), F.lit(CONCISE_WORDS)))


def truth(task: Column, gt: Column, answer: Column, info: Column) -> Column:
    """The expected answer of a sample: a letter, Yes or No, a count, or the answer's text."""
    first = F.get(info, F.lit(0))
    said = F.coalesce(F.length(answer) > 0, F.lit(False))
    yes_no = F.when(said, F.when(F.lower(answer).contains("yes"), "Yes").otherwise(answer)).when(
        F.size(info) > 0, F.when(F.coalesce(first["type"] == 1, F.lit(False)), "Yes").otherwise("No")
    )
    return (
        F.when(task.isin(*CHOICE), F.coalesce(letter(gt), F.lit("")))
        .when(task.isin("SSR", "CRR"), F.coalesce(yes_no, F.lit("")))
        .when(task == "REC", F.coalesce(first["count"].cast("string"), F.lit("")))
        .otherwise(text(answer))
    )


#: Quoted strings of a list literal.
QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def parse_options(options: Column) -> Column:
    """Options of a list literal or of lines, trimmed; null for none. Text is never run as code."""
    t = F.regexp_replace(options, r"^\s+|\s+$", "")
    quoted = F.transform(F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0)), lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1"))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.when(t.isNotNull() & (t != "") & (F.lower(t) != "nan"), F.when(t.startswith("["), quoted).otherwise(lines))


def lettered_once(options: Column) -> Column:
    """Options with their letter in front, unless it is there."""

    def one(o: Column, i: Column) -> Column:
        name = F.char(F.lit(65) + i)
        return F.when(o.startswith(F.concat(name, F.lit("."))) | o.startswith(F.concat(name, F.lit(")"))), o).otherwise(F.concat(name, F.lit(". "), o))

    return F.transform(options, one)


def seconds(stamp: Column) -> Column:
    """mm:ss or hh:mm:ss in seconds; anything else is an error, null stays null."""
    p = F.split(F.regexp_replace(stamp, r"^\s+|\s+$", ""), ":")
    n = F.transform(p, lambda x: x.cast("bigint"))
    two, three = n[0] * 60 + n[1], n[0] * 3600 + n[1] * 60 + F.get(n, F.lit(2))
    return F.when(stamp.isNull(), F.lit(None).cast("bigint")).when(F.size(p) == 2, two).when(F.size(p) == 3, three).otherwise(
        F.raise_error(F.concat(F.lit("invalid time "), stamp)).cast("bigint")
    )


def id_token(qid: Column) -> Column:
    """The second-last part of an id, by underscores; null where there is none."""
    parts = F.split(qid, "_")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def cache_key(parts: list[Column]) -> Column:
    """One canonical key of a score cache entry."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
