import itertools
import re
import re._parser as parser

import pytest

from keepstream.llm import refusals
from keepstream.llm.pair_defects import defects


def wordings(tokens):
    """Wordings of a parsed pattern: every branch, optional parts in and out, the shortest of each repetition."""
    parts = []
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "ANY":
            parts.append([" "])
        elif name == "IN":
            kind, value = arg[0]
            parts.append([chr(value)] if str(kind) == "LITERAL" else [" " if "SPACE" in str(value) else "x"])
        elif name == "BRANCH":
            parts.append([w for branch in arg[1] for w in wordings(branch)])
        elif name == "SUBPATTERN":
            parts.append(list(wordings(arg[3])))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            one = list(wordings(inner))
            if low:
                parts.append([w * low for w in one])
            else:
                parts.append(one if str(inner[0][0]) == "ANY" else ["", *one] if high == 1 else [""])
        else:
            assert name in ("AT", "ASSERT"), name
    return ("".join(p) for p in itertools.product(*parts))


@pytest.mark.parametrize("name", sorted(refusals.DECLINING))
def test_every_head_and_phrase_has_a_stem(name):
    """Each wording of the heads, or each of the acts, and each phrase has a stem where it is looked for."""
    d = refusals.DECLINING[name]

    def without(pattern):
        seen = [w for w in wordings(parser.parse(pattern, re.I)) if re.search(pattern, w) or "(?<" in pattern]
        assert seen
        at = list(refusals.DECLINING).index(name)
        return [w for w in seen if at not in refusals.stems().languages(w)]

    assert without(d.heads) == [] or without(d.acts) == []
    assert not d.phrases or without(d.phrases) == []


def test_stems_of_texts():
    got = [refusals.stems().languages(t) for t in ("i cannot answer", "no puedo", "すみません、お答えできません", "the red cup", "")]
    assert all(got[:3]) and got[3:] == [set(), set()]


@pytest.mark.parametrize("text", ["I can't see the red cup in the last frame, so the answer is B.", "컵이 없습니다.", "Il refuse de manger.", "Leider ist die Tasse kaputt.", "The ball falls outside the frame.", "彼は泳ぐことができません。", "I cannot identify the man, but it is B."])
def test_what_is_no_refusal(text):
    assert not refusals.refuses(text)


@pytest.mark.parametrize(
    "text",
    [
        "My instructions forbid me from answering.",
        "Our rules do not allow an answer.",
        "Je dois décliner.",
        "As an AI, I will have this one pass.",
        "I am not  able to say.",
    ],
)
def test_refusals_reach_their_pattern(text):
    assert "refusal" in defects("What is shown?", None, text, lambda w: True)
