"""Precision and recall of every defect on pairs not worded from the test tables."""

from collections import Counter

import pytest

from keepstream.llm import pair_defects, truncation
from tests.llm.pair_set import pairs

PLAIN = [
    "The crew waited for the fog to lift before the plane left.", "The cook cuts onions, carrots and garlic.", "The landlord and the tenant met at the house.", "It takes two hours and ten minutes.", "The pipe is near the exit.",
    "The table on the left has a red cup.", "The bag is blue.", "We saw the film to the end.", "He paid for the wine and the pasta.", "They drove a taxi to Vienna.",
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = pairs()
    table = truncation.terminality(spark.createDataFrame([(t,) for t in PLAIN * 5] + [(r[2],) for r in rows], "text string"))
    return [(*r, pair_defects.defects(*r[:3], table.whole)) for r in rows]


def test_there_are_enough(judged):
    assert len(judged) >= 300


@pytest.mark.parametrize("kind", pair_defects.KINDS)
def test_precision_and_recall(judged, kind):
    """A pair's first kind is its name; a refusal in another language than the question's is one of both."""
    hit, missed, false = [], [], []
    for q, o, text, want, got in judged:
        named = got[0] if got else None
        if want == kind:
            (hit if named == kind else missed).append((text, got))
        elif named == kind:
            false.append((text, want, got))
    print(kind, len(hit), "missed", missed, "false", false)
    assert len(hit) >= 0.9 * (len(hit) + len(missed)) and len(hit) >= 0.9 * (len(hit) + len(false)), (missed, false)


def test_all_kinds_that_fire(judged):
    seen = Counter(tuple(got) for *_, got in judged)
    assert seen["refusal", "other_language"] > 10
    assert "unclosed" in pair_defects.defects("What is it?", None, "```", lambda w: True)
