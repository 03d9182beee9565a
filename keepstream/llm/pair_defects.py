"""Defective prompt and response pairs by ordered rules.

The rules run from emptiness over unclosed parts, abrupt ends, refusal phrases
and copied prefixes to script and language; every rule that fires is emitted,
and the first names the pair's kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstream.llm.endings import (
    ABRUPT,
    ALNUM,
    INVISIBLE,
    NO_VALUE,
    OPEN,
    UNCLOSED,
    UNSURE,
    after_thinking,
    end_state,
    json_values,
    norm,
    normed,
    option_texts,
    unclosed,
)
from keepstream.llm.language import differs
from keepstream.llm.refusals import refuses
from keepstream.llm.truncation import TerminalityTable, terminality

#: In the order in which they name a pair; the two kinds of truncation have one name.
KINDS = ("empty", "copies_question", "unclosed", "abrupt", "refusal", "other_language")
NAMES = {"unclosed": "truncated", "abrupt": "truncated"}

#: A label before a repeated question, such as "Question:" or "You asked:".
ASKED = re.compile(r"^\W*(?:[^\W\d_]+[ \t]*){0,3}[:：]\W*")
#: How a list of options is headed.
LISTED = frozenset(norm(w) for w in "options option choices answers opciones optionen opções réponses 选项 選択肢 選項".split())
HINT = re.compile(r"(?:respond|answer|reply|choose|select|pick|give|return|output)\b[^.?!\n]*(?:letter|option|number|yes|no|only|choice|word)[^.?!\n]*[.?!:]?", re.I)
MARKUP = re.compile(r"```\w*|</?\w+/?>|[*_`#>~|]+")
MARKS = frozenset("`<>*_#~|")
REASON = re.compile(r"<think>.*?</think>", re.S)


def spoken(text: str) -> str:
    """The answer's wording: without reasoning, markup and JSON syntax."""
    body = after_thinking(REASON.sub(" ", text)) if "think>" in text else text
    fenced = body if MARKS.isdisjoint(body) else MARKUP.sub(" ", body)
    j = json_values(fenced)
    return j[1] if j and j[0] else fenced


#: Marks that may stand around a placeholder; a letter or a number by itself.
AROUND = " \t\r\n.…\"'()[]{}<>-–—:;,!?*_`~|/\\"
BARE = re.compile(r"(?:[\W_]*[A-Za-z][\W_]*|[\W\d_]*)\Z")


def is_empty(text: str | None, said: str) -> bool:
    """Whether nothing in a text answers: blank, invisible, bare marks, or a placeholder for no value, whatever surrounds it."""
    if text is None:
        return True
    if "<think>" in text and "</think>" not in text:
        return False
    said = said if said.isascii() and said.isprintable() else INVISIBLE.sub(" ", said)
    return not ALNUM.search(said) and "✅" not in said or said.strip(AROUND).lower() in NO_VALUE


def copies(question: str | None, options: str | None, said: str) -> bool:
    """Whether nothing is left of an answer without the question, its options and the prompt's instructions."""
    asked = normed(question)
    if not asked or len(said) < len(asked) or asked not in norm(said):
        return False
    left = norm(HINT.sub(" ", said))
    if asked not in left:  # the hint's pattern met the question itself
        left = norm(said)
    if not left.startswith(asked):
        left = norm(ASKED.sub("", HINT.sub(" ", said), 1))
        if not left.startswith(asked):
            return False
    left = left.replace(asked, "")
    if not left:
        return True
    opts = {norm(o) for o in option_texts(options)} - {""}
    if not opts or not all(o in left for o in opts):
        return False  # one option's wording is an answer, all of them are a copy
    for o in sorted(opts, key=len, reverse=True):
        left = left.replace(o, "\x00")
    return all(len(w) <= 1 or w[:-1] in LISTED or w in LISTED for w in left.split("\x00"))


def bare(said: str) -> bool:
    """A letter or a number, which is in no language."""
    return bool(BARE.match(said))


def defects(question: str | None, options: str | None, text: str | None, whole: Callable[[str], bool]) -> list[str]:
    """All kinds that fire, in order; ``whole`` judges an unsure end's last wording.

    An empty answer has no wording, so of the other rules only that of open parts can fire with it.
    """
    if text is None:
        return ["empty"]
    said = spoken(text)
    state, why = end_state(text, options, question)
    out = ["empty"] if is_empty(text, said) else []
    if not out and copies(question, options, said):
        out.append("copies_question")
    if out[:1] == ["empty"]:
        return [*out, UNCLOSED] if unclosed(text.strip()) else out
    if state == OPEN:
        out.append(why)
    elif state == UNSURE and not whole(why):
        out.append(ABRUPT)
    if refuses(said):
        out.append("refusal")
    if not bare(said) and differs(question, said, options):
        out.append("other_language")
    return out


def pair_defects(pairs: DataFrame, table: TerminalityTable | None = None) -> DataFrame:
    """(src, pair_id, defects) of the defective pairs; ``pairs`` has src, pair_id, question, options, response, delivered_at.

    ``options`` is a text, a list literal or lines. Of several deliveries of a pair
    the latest counts, of equally late ones one with defects; each row without an id is
    a pair of its own. A null question or options is as a blank one: nothing can copy
    it, and no language differs from it.
    """
    table = terminality(pairs.select(F.col("response").alias("text"))) if table is None else table

    def judge(q: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for questions, options, texts in q:
            masks = []
            for a, o, t in zip(questions.to_pylist(), options.to_pylist(), texts.to_pylist()):
                masks.append(sum(1 << KINDS.index(d) for d in defects(a, o, t, table.whole)))
            yield pa.array(masks, pa.int32())

    mask = F.arrow_udf(judge, "int")(F.col("question"), F.col("options"), F.col("response"))
    judged = pairs.select("src", "pair_id", "delivered_at", mask.alias("mask"))
    # a row without an id gets a key of its own, so that one judgement of the rows serves all
    lone = F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id())
    last = judged.withColumn("_lone", lone).groupBy("src", "pair_id", "_lone").agg(F.max(F.struct("delivered_at", "mask")).alias("s")).filter("s.mask > 0")
    named = [F.when(F.col("s.mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(KINDS)]
    return last.select("src", "pair_id", F.array_compact(F.array(*named)).alias("defects"))


def defect_name(kind: Column) -> Column:
    """The name of a kind: both kinds of truncation have one."""
    out = kind
    for k, name in NAMES.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def recorded_pairs(records: DataFrame, answers: DataFrame) -> DataFrame:
    """The pairs of run_records (question, raw_response) and of stream_answers (question, response)."""
    run = records.select(
        F.lit("run_records").alias("src"),
        F.col("record_id").alias("pair_id"),
        "question",
        F.array_join("options", "\t").alias("options"),
        F.col("raw_response").alias("response"),
        F.col("ingested_at").alias("delivered_at"),
    )
    stream = answers.select(
        F.lit("stream_answers").alias("src"), F.col("answer_id").alias("pair_id"), "question", "options", "response", F.col("written_at").alias("delivered_at")
    )
    return run.unionByName(stream)
