"""Text values that were cut off.

Near-copies are found by min-hash banding over shingles of five words. In a verified
pair (similarity of 0.8 or more) the copy whose alignment with the other ends early,
within a word or a sentence, is the cut one, whatever its own form, unless it ends in
a whole answer (a letter, a number, an option), to which the other merely adds. A record
without such a copy is scored by its end: an open part or sentence is a cut, and
where the form leaves it open, the closing word decides by its terminality, the part
of its occurrences in the whole corpus that end a sentence.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstream.llm.endings import ANSWER, CLOSED, DEBRIS, OPEN, UNSURE, end_state
from keepstream.session import durable

SHINGLE, SIMILARITY = 5, 0.8
#: 5 bands of 3 rows find a pair of similarity 0.8 with probability 0.97.
BANDS, ROWS = 5, 3
#: Neighbours on either side that a text is aligned with, besides all texts that continue it word for word.
NEAR = 4
#: Words before the last one by which the end of a text is placed in its copy.
ANCHOR = 4
#: Bits of the set by which places of interest are told, 8 MB.
BITS = 1 << 26
#: Characters of the texts that are held at once while all places of their key pass by.
BLOCK = 2_000_000
#: Characters of the texts that pass by them in one task.
PASSING = 32_000_000
#: Slots of each of the two terminality tables: a fixed size, so that they may be broadcast whatever the corpus. A word's
#: occurrences are overstated by those of the words that share both its slots: of a corpus of n words by more than
#: 4 n / SLOTS with a probability below 1/16 (a count-min table of two rows).
SLOTS = 1 << 17
#: A closing word that ends sentences less often than this leaves its sentence unfinished. Set by hand, not fitted:
#: no labels are at hand. In the test tables function words score 0 and nouns about 0.23.
LEAST_TERMINALITY = 0.04
#: A word seen this often that lies in wordings without a stop at most half as often as words do in all is a sentence's, not a phrase's.
CLAUSE_SEEN, CLAUSE_LOOSE = 20, 0.5
#: Verbs and conjunctions that make a wording a sentence; they count where the corpus says too little of a word.
CLAUSE_WORDS = frozenset(
    "is are was were am has have had do does did will would can could should may might must because although while when if until "
    "es son está están era eran fue hay porque aunque cuando mientras est sont était étaient parce quand lorsque ist sind war waren wird würde weil dass wenn "
    "é são estão foi quando sono perché zijn omdat wanneer は が 是".split()
)

EDGE = re.compile(r"^[^\w]+|[^\w]+$")
STOPS = re.compile(r"[.!?。！？][\"'”’)\]*}]*$")
#: A stop with a word after it, or a mark that may belong to one.
STOP_WITHIN = re.compile(r"[.!?。！？].*\w|\u0307", re.S)
STOP_INSIDE = re.compile(r"[.!?。！？]\S*\w|\u0307")
#: A comma counts as a word of its own: like a verb, it may be a sign of sentences.
COMMA = re.compile(r"[,，、]$")
#: Blank-separated words; each ideograph and kana is a word, with the marks after it.
PIECES = re.compile(r"[぀-ヿ㐀-鿿가-힯][^\w\s]*|[^\s぀-ヿ㐀-鿿가-힯]+")


def words(text: str) -> list[str]:
    """The words of a text with the marks on them."""
    return text.split() if text.isascii() else PIECES.findall(text)


def slots(word: str) -> tuple[int, int]:
    """A word's place in each of two tables, from different bits of its hash."""
    h = zlib.crc32(word.encode())
    return h & (SLOTS - 1), SLOTS + (h >> 15)


class TerminalityTable:
    """How often the words of each slot occur, end a sentence, and lie in a wording without a stop."""

    def __init__(self, total: np.ndarray, final: np.ndarray, loose: np.ndarray | None = None):
        self.total, self.final, self.loose = total, final, np.zeros_like(total) if loose is None else loose
        first = total[:SLOTS]
        # words seen once stand for words not seen: where they abound, an unknown closing word is no sign of a cut
        self.share = float(self.loose[:SLOTS].sum()) / max(1.0, float(first.sum()))
        self.unseen = float((first == 1).sum()) / max(1.0, float(first.sum()))

    def place(self, word: str) -> int:
        """The slot with fewer occurrences: two words rarely meet in both tables."""
        return min(slots(word), key=self.total.__getitem__)

    def score(self, word: str) -> float:
        s = self.place(word)
        return float((self.final[s] + self.unseen / 2) / (self.total[s] + 1.0))

    def in_clauses(self, word: str) -> bool:
        s = self.place(word)
        return bool(self.loose[s] <= CLAUSE_LOOSE * self.share * self.total[s]) if self.total[s] >= CLAUSE_SEEN else word in CLAUSE_WORDS

    def whole(self, wording: str) -> bool:
        """Whether a wording without a stop may end here: a phrase, not a sentence, with a word that ends sentences."""
        tokens = words(wording)
        said = [w for t in tokens if (w := EDGE.sub("", t).lower())]
        if len(said) > 1 and (any(map(self.in_clauses, said)) or any(map(COMMA.search, tokens)) and self.in_clauses(",")):
            return False
        return not said or self.score(said[-1]) >= LEAST_TERMINALITY


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, final, loose = (np.zeros(2 * SLOTS, np.int64) for _ in range(3))
    for b in batches:
        seen: Counter[str] = Counter()
        ending: Counter[str] = Counter()
        for t in b.column(0):
            if (v := t.as_py()) is not None:
                tokens = words(v)
                seen.update(tokens)
                for token in reversed(tokens):  # what follows the last stop
                    if STOPS.search(token):
                        break
                    ending[token] += 1
        for counts, into in ((seen, total), (ending, loose)):
            for token, n in counts.items():
                if COMMA.search(token):
                    for s in slots(","):
                        into[s] += n
                word = EDGE.sub("", token)
                if not word or len(word) == 1 and word.isupper():
                    continue  # a single capital is an option's letter, not the article or pronoun
                for s in slots(word.lower()):
                    into[s] += n
                    if into is total and STOPS.search(token):
                        final[s] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in (total, final, loose))], names=["slot", "total", "final", "loose"])


def terminality(texts: DataFrame) -> TerminalityTable:
    """The table of all words of a one-column DataFrame of texts.

    Each partition sends one row per used slot, and the result has 2 * ``SLOTS`` rows
    at most, whatever the size of the corpus.
    """
    partial = texts.mapInArrow(_count, "slot int, total bigint, final bigint, loose bigint")
    rows = partial.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("total", "final", "loose")]).toPandas()
    out = []
    for c in ("total", "final", "loose"):
        x = np.zeros(2 * SLOTS)
        x[rows["slot"]] = rows[c]
        out.append(x)
    return TerminalityTable(*out)


_IDS: dict[str, int] = {}


def word_ids(tokens: list[str]) -> list[int]:
    """A 32-bit number per word, whatever its case and punctuation."""
    if len(_IDS) > 500_000:
        _IDS.clear()
    out = []
    for t in tokens:
        i = _IDS.get(t)
        if i is None:
            i = zlib.crc32(EDGE.sub("", t.lower()).encode() or b"-")
            if len(t) < 40:
                _IDS[t] = i
        out.append(i)
    return out


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five numbers (of a run shorter than that, nothing)."""
    n = len(ids) - SHINGLE + 1
    s = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        s = (s ^ ids[k : k + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return s


def band_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have five words at least, and a key per band of each of those."""
    lists = [word_ids(words(t)) if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    which = np.flatnonzero(sizes >= SHINGLE)
    keys = np.zeros((len(which), BANDS), np.uint64)
    if not len(which):
        return which, keys
    flat = np.fromiter((i for w in which for i in lists[w]), np.uint64, int(sizes[which].sum()))
    ends = np.cumsum(sizes[which])
    s = shingles(flat)
    inside = np.ones(len(flat), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False  # runs that would reach into the next text
    s = s[inside[: len(s)]]
    starts = np.r_[0, np.cumsum(sizes[which] - SHINGLE + 1)[:-1]]
    rng = np.random.default_rng(20240131)
    a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    for k in range(BANDS * ROWS):
        v = s * a[k]
        low = np.minimum.reduceat(v ^ (v >> np.uint64(32)), starts)
        band = k // ROWS
        keys[:, band] = (keys[:, band] ^ low) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band)
        keys[:, band] ^= keys[:, band] >> np.uint64(32)
    return which, keys


class Copy:
    """A text as its bucket's order and the alignment see it."""

    def __init__(self, h: int, text: str):
        self.h, self.text, self.early = h, text, False
        self.raw = words(DEBRIS.sub("", text).rstrip())
        self.words = [EDGE.sub("", w.lower()) for w in self.raw]
        self._shingles: set[int] | None = None

    @property
    def shingles(self) -> set[int]:
        if self._shingles is None:
            self._shingles = set(shingles(np.array(word_ids(words(self.text)), np.uint64)).tolist())
        return self._shingles

    def key(self, start: int) -> str:
        """The wording from a word on: a text that goes on follows its beginning in this order."""
        return " ".join(self.words[start:] if len(self.words) > start else self.words)


def similar(a: Copy, b: Copy) -> bool:
    """Whether two texts have a similarity of 0.8 over their shingles of five words."""
    small, large = sorted((len(a.shingles), len(b.shingles)))
    if small < SIMILARITY * large or not large:
        return False
    both = len(a.shingles & b.shingles)
    return both >= SIMILARITY * (small + large - both)


def goes_on(a: Copy, b: Copy) -> bool:
    """Whether ``b`` goes on where ``a`` ends, within a word or a sentence.

    The end of ``a`` is placed in ``b`` by the words before its last one, at the place
    nearest to its own, so words changed, added or left out before them don't matter.
    """
    n, m = len(a.words), len(b.words)
    if n < 2 or m < n:
        return False
    anchor = a.words[-1 - ANCHOR : -1]
    k = len(anchor)
    reach = max(2, m - n)
    at = [p for p in range(max(k, n - 1 - reach), min(m, n + reach)) if b.words[p - k : p] == anchor]
    if not at:
        return False
    p = min(at, key=lambda x: abs(x - (n - 1)))
    own, other = a.words[-1], b.words[p]
    if STOPS.search(a.raw[-1]):  # a stop that the copy has within a word, as in a number, is none
        return b.raw[p].lower().startswith(a.raw[-1].lower()) and bool(EDGE.sub("", b.raw[p][len(a.raw[-1]) :]))
    if own == other:
        return p + 1 < m and not STOPS.search(b.raw[p])
    return bool(own) and other.startswith(own)


def similarity(a: str, b: str) -> float:
    x, y = Copy(0, a).shingles, Copy(1, b).shingles
    return len(x & y) / len(x | y) if x or y else 0.0


def ends_early(short: str, long: str) -> bool:
    """Whether the alignment of a near-copy with another reaches its end, while the other goes on."""
    a, b = Copy(0, short), Copy(1, long)
    return goes_on(a, b) and similar(a, b)


def neighbours(rows: Iterator[tuple[int, str, Copy]]) -> Iterator[Copy]:
    """The copies that end early, of (bucket, key, copy) rows in that order; then ``rows`` is exhausted.

    In the order of the keys all texts that begin with another follow it directly. So
    the texts that continue a text word for word are met while it lies on a stack of
    beginnings, which is never deeper than a text has characters, and all of them are
    tried until one is similar. Of texts worded alike (their marks or case may differ)
    one with and one without a stop at the end stands for all, until it is found; then
    each of them is tried. Of copies that differ before the end, the ``NEAR`` rows on
    either side are tried, so some are missed; no more pairs than that arise, however
    many texts a bucket has. ``early_copies`` doesn't use it: ``aligned_copies`` meets all.
    """
    bucket, stack, last = None, [], deque(maxlen=NEAR)
    for band, key, new in rows:
        if band != bucket:
            bucket, stack = band, []
            last.clear()
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        tried = set()
        for begun, size, alike in reversed(stack):
            if size < 0.75 * len(new.words) - 1:
                break  # too short for a similarity of 0.8, as are all before it
            if begun == key:
                continue
            for copies in alike:
                if copies:
                    tried.add(copies[0].h)
                    if goes_on(copies[0], new) and similar(copies[0], new):
                        found = [c for c in copies if c is copies[0] or goes_on(c, new) and similar(c, new)]
                        for c in found:
                            if not c.early:
                                c.early = True
                                yield c
                        copies[:] = [c for c in copies if not c.early]
        for old in last:
            if old.h in tried or old.h == new.h:
                continue
            for a, b in ((old, new), (new, old)):
                if not a.early and goes_on(a, b) and similar(a, b):
                    a.early = True
                    yield a
        if not stack or stack[-1][0] != key:
            stack.append((key, len(new.words), ([], [])))
        stack[-1][2][bool(new.raw and STOPS.search(new.raw[-1]))].append(new)
        last.append(new)


def _hashes(found: Iterator[Copy]) -> Iterator[pa.RecordBatch]:
    while some := [c.h for c in itertools.islice(found, 4096)]:
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64())], names=["h"])


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` numbers."""
    s = np.full(max(len(ids) - k + 1, 0), k, np.uint64)
    for j in range(k):
        s = mix(s ^ ids[j : j + len(s)])
    return s


def tail(gram: int, last: str, stopped: bool) -> int:
    """A hash of the words before a place, and of what the word there begins with."""
    x = (gram ^ zlib.crc32(last.encode("utf-8", "surrogatepass")) ^ (stopped << 40)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 29)  # as in mix


def may_be_debris(text: str) -> bool:
    """Whether ``DEBRIS`` may match; it is slow to try on every text."""
    end = text[-200:].rstrip()
    return not end or end[-1] in ")]>\ufffd…" or end.endswith("...") or "\\" in end[-6:]


class Ends:
    """The texts of a batch as word numbers, one after another."""

    def __init__(self, texts: list[str]):
        self.raw = [words(DEBRIS.sub("", t).rstrip() if may_be_debris(t) else t) for t in texts]
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.fromiter((i for r in self.raw for i in word_ids(r)), np.uint64, int(self.sizes.sum()))
        self.grams = {k: grams(self.ids, k) for k in range(1, ANCHOR + 1)}

    def own(self, i: int) -> tuple[int, int, bool] | None:
        """The hash of the anchor and of the tail by which another text must go on, and whether the text ends in a stop (see ``goes_on``)."""
        raw, n = self.raw[i], int(self.sizes[i])
        if n < 2:
            return None
        k = min(ANCHOR, n - 1)
        gram = int(self.grams[k][self.starts[i] + n - 1 - k])
        stopped = bool(STOPS.search(raw[-1]))
        return gram, tail(gram, raw[-1].lower() if stopped else EDGE.sub("", raw[-1].lower()), stopped), stopped

    def within_words(self, i: int) -> Iterator[int]:
        """The tails of all texts that end in a stop which text ``i`` has within a word."""
        for p, w in enumerate(self.raw[i] if STOP_INSIDE.search(" ".join(self.raw[i])) else ()):
            if p and STOP_WITHIN.search(w):
                low = w.lower()
                begun = [low[:e] for e in range(1, len(low) + ("\u0307" in low)) if STOPS.search(low[:e])]  # a dotted i may take two characters
                for k in range(1, min(ANCHOR, p) + 1) if begun else ():
                    gram = int(self.grams[k][self.starts[i] + p - k])
                    yield from (tail(gram, x, True) for x in begun)

    def places(self, bits: np.ndarray, bands: list[list[int]]) -> Iterator[tuple[int, int]]:
        """Text and tail, wherever a text goes on after an anchor and tail that ``bits`` may have."""
        whose = np.repeat(np.arange(len(self.sizes)), self.sizes)
        per = np.array([len(x) for x in bands], np.int64)
        flat, first = np.fromiter((x for y in bands for x in y), np.int64, int(per.sum())).view(np.uint64), np.cumsum(per) - per
        for k, g in self.grams.items():
            at = np.flatnonzero(has(bits, g))
            at = at[at + k < len(whose)]
            at = at[whose[at] == whose[at + k]]  # a run and the word after it lie in one text
            many = np.repeat(at, per[whose[at]])
            nth = np.arange(len(many)) - np.repeat(np.cumsum(per[whose[at]]) - per[whose[at]], per[whose[at]])
            at = np.unique(many[has(bits, mix(g[many] ^ flat[first[whose[many]] + nth]))])
            tails, texts = [], []
            for a in at.tolist():
                i = int(whose[a])
                p = a + k - int(self.starts[i])
                w, gram = self.raw[i][p], int(g[a])
                word = EDGE.sub("", w.lower())
                whole = p + 1 < len(self.raw[i]) and not STOPS.search(w)
                for e in range(1 if word else 0, len(word) + whole):
                    tails.append((gram ^ zlib.crc32(word[:e].encode("utf-8", "surrogatepass"))) & 0xFFFFFFFFFFFFFFFF)
                    texts.append(i)
            if tails:
                t = mix(np.array(tails, np.uint64))
                yield from ((texts[x], int(t[x])) for x in np.flatnonzero(has(bits, t)).tolist())


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _keyed(rows: list[tuple[int, int, bool, list[int], int, int | None]], bits: np.ndarray | None = None) -> pa.RecordBatch:
    """(key, h, size, query, anchor, gram, tail): a row per band of a text and tail, of those that ``bits`` may have; the hashes for the bits on the first alone."""
    per = np.array([len(r[3]) for r in rows], np.int64)
    at = np.repeat(np.arange(len(rows)), per)
    bands = np.fromiter((x for r in rows for x in r[3]), np.int64, int(per.sum())).view(np.uint64)
    t, g = (np.array([r[c] or 0 for r in rows], np.uint64) for c in (4, 5))
    key = mix(t[at] ^ bands)
    if bits is not None:
        met = has(bits, key)
        at, key = at[met], key[met]
    later = np.r_[False, at[1:] == at[:-1]] if len(at) else np.zeros(0, bool)
    no_gram = np.array([r[5] is None for r in rows], bool)[at]
    anchor = mix(g[at] ^ (bands if bits is None else bands[met]))
    columns = [pa.array(key.view(np.int64)), *(pa.array([rows[x][c] for x in at.tolist()], kind) for c, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_())))]
    columns += [pa.array(x.view(np.int64), mask=m) for x, m in ((anchor, no_gram), (g[at], no_gram | later), (t[at], later))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "h", "size", "query", "anchor", "gram", "tail"])


KEYED = "key bigint, h bigint, size bigint, query boolean, anchor bigint, gram bigint, tail bigint"


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tails that are fewer: of texts that end without a stop, and of places with a stop within a word."""
    for b in batches:
        h, text, bands = (b.column(c).to_pylist() for c in ("h", "text", "bands"))
        ends, rows = Ends(text), []
        for i in range(len(h)):
            own = ends.own(i)
            if own and not own[2]:
                rows.append((h[i], len(text[i]), True, bands[i], own[1], own[0]))
            rows += [(h[i], len(text[i]), False, bands[i], t, None) for t in set(ends.within_words(i))]
        yield _keyed(rows)


def _rest(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The tails that those of ``_fewer`` may meet: places within texts, and texts that end with a stop."""
    for b in batches:
        h, text, bands = (b.column(c).to_pylist() for c in ("h", "text", "bands"))
        ends = Ends(text)
        rows = [(h[i], len(text[i]), False, bands[i], t, None) for i, t in set(ends.places(bits, bands))]
        closed = [(i, own[1]) for i in range(len(h)) if (own := ends.own(i)) and own[2]]
        met = has(bits, np.array([t for _, t in closed], np.uint64))
        rows += [(h[i], len(text[i]), True, bands[i], t, None) for (i, t), m in zip(closed, met) if m]
        yield _keyed(rows, bits)


def _met(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose keys ``bits`` may have."""
    for b in batches:
        yield b.filter(pa.array(has(bits, b.column("key").to_numpy().view(np.uint64))))


def bits_of(rows: DataFrame, *columns: str) -> np.ndarray:
    """A set of hashes as ``BITS`` bits, a size that doesn't depend on the corpus; a place taken twice costs time, no result."""
    slot = F.explode(F.array(*columns)).alias("x")
    slots = rows.select(slot).filter("x IS NOT NULL").select(F.col("x").bitwiseAND(BITS - 1).alias("x")).select(F.shiftright("x", 15).alias("part"), F.col("x").bitwiseAND(32767).alias("bit"))
    parts = slots.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((BITS >> 15, 4096), np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h) of the texts that end early, of rows sorted by cell (key, block, part), in each the texts whose end is sought before those that may go on."""

    def found() -> Iterator[Copy]:
        group, held = None, []
        for b in batches:
            for *cell, query, h, text in zip(*(c.to_pylist() for c in b.columns)):
                if cell != group:
                    group, held = cell, []
                if query:
                    held.append(Copy(h, text))
                elif held:
                    new = Copy(h, text)
                    for a in held:
                        if a.h != h and goes_on(a, new) and similar(a, new):
                            a.early = True
                            yield a
                    held = [a for a in held if not a.early]

    yield from _hashes(found())


def aligned_copies(texts: DataFrame) -> DataFrame:
    """(h): of (h, text, bands) all texts with which a text of a bucket of theirs is similar and goes on.

    All pairs are met that ``goes_on`` can accept, however many share a bucket and wherever
    they differ: what it asks for is equal words before the last one (the anchor) and a word
    there that begins with the last one. So texts are joined by band, anchor and last word
    with the places of the others. To find the few places of interest, those that are fewer
    are put into a set of bits first. The texts of a key that has many are split into blocks and
    its places into parts, and each block meets each part.
    """
    fewer = durable(texts.mapInArrow(_fewer, KEYED), "tails")
    bits = bits_of(fewer, "key", "anchor", "gram", "tail")
    rest = durable(texts.mapInArrow(lambda it: _rest(it, bits), KEYED), "places")
    own = bits_of(rest, "key")
    columns = ["key", "h", "size", "query"]
    met = fewer.select(*columns).mapInArrow(lambda it: _met(it, own), "key bigint, h bigint, size bigint, query boolean")
    rows = met.unionByName(rest.select(*columns))
    sized = [F.ceil(F.sum(F.when(c, F.col("size"))) / n).cast("int").alias(x) for c, n, x in ((F.col("query"), BLOCK, "blocks"), (~F.col("query"), PASSING, "parts"))]
    per = rows.groupBy("key").agg(*sized, F.min("h").alias("lo"), F.max("h").alias("hi"))
    both = rows.join(per.filter("blocks > 0 AND parts > 0 AND lo <> hi").select("key", "blocks", "parts"), "key")
    one = lambda n: F.array(F.pmod(F.xxhash64("h"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = both.withColumn("block", F.explode(F.when(F.col("query"), one("blocks")).otherwise(every("blocks"))))
    both = block.withColumn("part", F.explode(F.when(F.col("query"), every("parts")).otherwise(one("parts"))))
    placed = both.select("key", "block", "part", "h", "query").join(texts.select("h", "text"), "h")
    cell = ["key", "block", "part"]
    return placed.repartition(*cell).sortWithinPartitions(*cell, F.col("query").desc(), "h").select(*cell, "query", "h", "text").mapInArrow(_aligned, "h bigint")


def _states(batches: Iterator[pa.RecordBatch], table: TerminalityTable) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, options, questions = (b.column(c).to_pylist() for c in ("text", "options", "question"))
        state = np.zeros(len(texts), np.int8)
        whole, answered = np.ones(len(texts), bool), np.zeros(len(texts), bool)
        for i, (t, o, q) in enumerate(zip(texts, options, questions)):
            state[i], wording = end_state(t, o, q)
            answered[i] = state[i] == CLOSED and wording == ANSWER
            if state[i] == UNSURE:
                whole[i] = table.whole(wording)
        which, keys = band_keys(texts)
        per = np.zeros(len(texts), np.int64)
        per[which] = BANDS
        bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("id", "source", "delivered_at", "h")), pa.array(state), pa.array(whole), pa.array(answered), bands],
            names=["id", "source", "delivered_at", "h", "state", "whole", "answered", "bands"],
        )


def early_copies(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(h): hashes of texts whose alignment with a near-copy ends early, while the copy goes on.

    Exact copies fall together in the aggregation. Texts of a bucket are joined with all
    places of the others at which one may go on (see ``aligned_copies``).
    """
    keyed = marked.filter(F.size("bands") > 0).select("h", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("band")
    needed = durable(keyed.join(shared, "band").groupBy("h").agg(F.collect_set("band").alias("bands")), "members")
    kept = texts.join(needed.select("h"), "h", "left_semi").groupBy("h").agg(F.max("text").alias("text"))
    return aligned_copies(durable(kept.join(needed, "h"), "kept")).distinct()


def marked_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records with the state of their ends and their bands, and the near-copies (h) that end early."""
    table = terminality(records.select("text"))
    hashed = records.select("id", "source", "delivered_at", F.xxhash64("text").alias("h"), "text", "options", "question")
    kinds = {f.name: f.dataType.simpleString() for f in hashed.schema}
    schema = f"id {kinds['id']}, source {kinds['source']}, delivered_at {kinds['delivered_at']}, h bigint, state tinyint, whole boolean, answered boolean, bands array<bigint>"
    marked = durable(hashed.mapInArrow(lambda it: _states(it, table), schema), "marked")
    return marked, early_copies(marked, hashed.select("h", "text"))


def cut_records(records: DataFrame) -> DataFrame:
    """(id, source, cut, stage) of each record; ``records`` has id, source, delivered_at, text, options, question.

    ``stage`` says what decided: ``near_copy``, ``form`` or ``terminality``. Of several
    deliveries of an id the latest counts, of equally late ones a cut one; each row
    without an id is a record of its own. Null and empty texts are not cut. Whole
    texts are judged, whatever their length. A text of fewer than five words has no
    shingle; none can reach a similarity of 0.8 with a text that goes on, so it is
    scored by its end.
    """
    marked, copies = marked_records(records)
    judged = marked.join(copies.withColumn("early", F.lit(True)), "h", "left")
    early = F.coalesce("early", F.lit(False)) & ~F.col("answered")
    stage = F.when(early, "near_copy").when(F.col("state") == UNSURE, "terminality").otherwise("form")
    cut = early | (F.col("state") == OPEN) | ((F.col("state") == UNSURE) & ~F.col("whole"))
    every = judged.select("id", "source", "delivered_at", cut.alias("cut"), stage.alias("stage"))
    last = every.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("delivered_at", "cut", "source", "stage")).alias("s"))
    lone = every.filter("id IS NULL").select("id", "source", "cut", "stage")
    return last.select("id", "s.source", "s.cut", "s.stage").unionByName(lone)


def record_texts(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("record_id").alias("id"),
        F.col("worker").alias("source"),
        F.col("ingested_at").alias("delivered_at"),
        F.col("raw_response").alias("text"),
        F.array_join("options", "\t").alias("options"),
        "question",
    )


def cut_shares(cut: DataFrame) -> DataFrame:
    """(source, records, cut, share): how often each source's records are cut."""
    by = cut.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if("cut").alias("cut"))
    return by.withColumn("share", F.col("cut") / F.col("records"))
