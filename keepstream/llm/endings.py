"""How a text ends: closed, open, or not to be told from its form alone."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

CLOSED, OPEN, UNSURE = 0, 1, 2
#: Why a text is closed: it is a whole answer in itself, which a longer copy cannot open again.
ANSWER = "answer"
#: Why a text is open: a part left open, or an end that comes too early.
UNCLOSED, ABRUPT = "unclosed", "abrupt"

#: Words for yes, no and their short additions.
YES_NO = frozenset(
    "yes no yep nope true false sí si oui non ja nein sim não nao はい いいえ 是 是的 不是 否 对 不 没有 有 네 아니요 да нет sì 还没有 まだです まだ".split()
) | frozenset(("notyet", "stillnot", "notodavíano", "todavíano", "noaúnno", "aúnno", "neinnochnicht", "nochnicht", "nonpasencore", "pasencore", "nãoaindanão", "aindanão"))
#: Texts that stand for no value.
NO_VALUE = frozenset("null none nan n/a na nil undefined unknown error empty no_answer".split()) | {"no answer"}

TERMINAL = ".!?。！？．…؟।"
CLOSERS = "\"'”’»」』）)]】》*_`}>~ \t\r\n​﻿"
#: What a cut may leave behind: a mark with or without a count, a replacement character, a lone backslash.
DEBRIS = re.compile(
    r"(?:\s*(?:…\s*\(\+\s*\d+[^)]*\)|\[(?:\.\.\.|…|truncated|cut|trunc\.?|more)\]|<(?:truncated|cut|trunc)>|\((?:truncated|cut|\.\.\.|…)\)|�+|\\+(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|…|(?<=\w)\s?\.{3,}))+\s*$", re.I
)
TRAIL = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "\u200b\u200c\u200d\ufeff\u00ad\x00"
ALNUM = re.compile(r"[^\W_]")
INVISIBLE = re.compile(r"[\s​-‏⁠﻿­\x00-\x1f]+")
TAG = re.compile(r"<(/?)([a-zA-Z_]{2,20})>")
HALF_TAG = re.compile(r"<[/a-zA-Z_]{0,20}$")
SENTENCE_END = re.compile(r"[.!?][\"'”’)\]]*\s|[。！？]")
LETTER = re.compile(r"^\W*(?:(?:final\s+)?(?:answer|antwort|respuesta|réponse|resposta|答案|回答)\s*(?:is|:|：)?\s*)?(?:option\s+)?[A-HYN]\W*$", re.I)
NUMBER = re.compile(r"^\W*(?:(?:final\s+)?(?:answer|antwort|respuesta|réponse|resposta|答案|回答)\s*(?:is|:|：)?\s*)?-?\d+(?:[.,:]\d+)*\s*(?:[^\W\d]{1,8})?\W*$", re.I)
LABEL = re.compile(r"^\W*(?:(?:final\s+)?answer\s*:?\s*)?\(?([A-Ha-h])\s*[.):：]\s*", re.I)
NOT_WORD = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def norm(text: str | None) -> str:
    """Letters and digits only, in compatibility form and lower case."""
    if not text:
        return ""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    return NOT_WORD.sub("", t)


@functools.lru_cache(8192)
def normed(question: str | None) -> str:
    """The normal form of a text that comes again and again."""
    return norm(question)


def without_debris(t: str) -> str:
    """A text without what a cut left at its end; the pattern is tried only where an end may be such a mark."""
    may = t[-1:] in tuple(")]>\ufffd\\…") or t.endswith("...") or "\\" in t[-6:]
    return DEBRIS.sub("", t) if may else t


def after_thinking(text: str) -> str:
    """What follows the last closed reasoning block."""
    return text.rpartition("</think>")[2]


@functools.lru_cache(4096)
def option_texts(options: str | None) -> tuple[str, ...]:
    """Option wordings of a list literal, of lines, or of a tab-joined list; never evaluated as code."""
    if not options or options.strip().lower() in ("nan", "none", "null", "[]"):
        return ()
    if options.startswith("["):
        parts = [a or b for a, b in re.findall(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"", options)]
    else:
        parts = re.split(r"[\n\t]", options)
    return tuple(p for x in parts if (p := LABEL.sub("", x.strip(), 1).strip() if re.match(r"^[A-Ha-h][.)] ", x.strip()) else x.strip()))


def json_values(text: str) -> tuple[bool, str] | None:
    """For a text that is a JSON object or list: whether it is whole, and its string values; else None."""
    t = text.strip()
    if not t or t[0] not in "{[" or (t[0] == "[" and not t.startswith(('["', "[]", "[{"))):
        return None
    try:
        value = json.loads(t)
    except ValueError:
        inside, depth, escaped = False, 0, False
        for c in t:
            if escaped:
                escaped = False
            elif inside:
                escaped, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
        return (False, "") if inside or depth > 0 else None
    out: list[str] = []

    def walk(v) -> None:
        if isinstance(v, dict):
            for x in v.values():
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif v is not None:
            out.append(str(v))

    walk(value)
    return True, "\n".join(out)


def open_quote(text: str) -> bool:
    """Whether a straight double quote is left open; one after a digit with none open is a sign for inches."""
    inside, at = False, text.find('"')
    while at >= 0:
        if inside or not (at and text[at - 1].isdigit()):
            inside = not inside
        at = text.find('"', at + 1)
    return inside


def cut_in_word(own: list[str], other: list[str]) -> bool:
    """Whether words break off within a word of another wording that starts alike."""
    n = len(own)
    return 0 < n <= len(other) and own[:-1] == other[: n - 1] and own[-1] != other[n - 1] and other[n - 1].startswith(own[-1])


def unclosed(text: str) -> bool:
    """A tag, a fence, an object, a quotation, a bracket or an emphasis that was opened and not closed."""
    if "<" in text and HALF_TAG.search(text) or text.count("```") % 2:
        return True
    opened: list[str] = []
    for close, name in TAG.findall(text) if "<" in text else ():
        if not close:
            opened.append(name)
        elif name in opened:
            opened.remove(name)
    if opened:
        return True
    body = after_thinking(text)
    j = json_values(body)
    if j is not None:
        return not j[0]
    if open_quote(body) or body.count("**") % 2 or body.count("“") > body.count("”") or body.count("「") > body.count("」"):
        return True
    return body.rfind("(") > body.rfind(")") or body.rfind("（") > max(body.rfind("）"), body.rfind(")"))


def end_state(text: str | None, options: str | None = None, question: str | None = None) -> tuple[int, str]:
    """The state of a text's end, with its last wording where the form leaves the state open, or why it is closed or open.

    Null and blank texts are closed: nothing was cut from them. A stop, a letter, a
    number, a whole option or question closes a text; an open part, a comma, an
    option's or the question's wording broken off, or a sentence without a stop after
    others that have one leave it open. Length decides nothing: any other wording
    without a stop is unsure.
    """
    if text is None or not ALNUM.search(after_thinking(text)) and "<think>" not in text and not HALF_TAG.search(text.strip()):
        return CLOSED, ""
    t = text.rstrip(TRAIL)
    bare = without_debris(t)
    if bare != t and ALNUM.search(bare):
        return OPEN, ABRUPT
    if unclosed(t):
        return OPEN, UNCLOSED
    body = after_thinking(t)
    body = (TAG.sub("", body) if "<" in body else body).strip()  # all tags are closed by here, and their names are no wording
    j = json_values(body)
    if j is not None:
        return CLOSED, ANSWER
    core = body.rstrip(CLOSERS)
    if not ALNUM.search(core):
        return CLOSED, ""
    if core[-1] in TERMINAL or unicodedata.category(core[-1]) in ("So", "Sk"):
        return CLOSED, ""
    if core[-1] in ",，、":
        return OPEN, ABRUPT
    if LETTER.match(body) or NUMBER.match(body):
        return CLOSED, ANSWER
    said = norm(body)
    if body[0] in "\"“「«" and body[-1] in "\"”」»":
        return CLOSED, ""
    if said in YES_NO or said in NO_VALUE:
        return CLOSED, ANSWER
    opts = option_texts(options)
    unlabelled = LABEL.sub("", body, 1)
    if opts:
        wording = norm(unlabelled)
        if any(wording == norm(o) or said == norm(o) for o in opts):
            return CLOSED, ANSWER
        if unlabelled != body and wording and not wording.isdigit() and any(norm(o).startswith(wording) for o in opts):
            return OPEN, ABRUPT  # a part of an option's wording
        own = WORD.findall(unlabelled.casefold())
        if any(cut_in_word(own, WORD.findall(o.casefold())) for o in opts):
            return OPEN, ABRUPT
        if body[-1] == ";" and said.endswith(norm(opts[-1])):  # the whole list of options
            return CLOSED, ANSWER
    asked = normed(question)
    if asked and said.startswith(asked):
        rest = said[len(asked) :]
        if not rest or rest == asked or len(opts) > 1 and all(norm(o) in rest for o in opts) and rest.endswith(norm(opts[-1])):
            return CLOSED, ANSWER
    if asked and asked.startswith(said) and cut_in_word(WORD.findall(body.casefold()), WORD.findall(question.casefold())):
        return OPEN, ABRUPT
    if question and (q := question.strip()) and body.startswith(q) and body[len(q) :].strip():
        return end_state(body[len(q) :].strip(), options)  # a question said again before the answer
    if SENTENCE_END.search(unlabelled):
        return OPEN, ABRUPT
    return UNSURE, unlabelled
