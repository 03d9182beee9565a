"""Splitting oversized texts at natural boundaries, with overlap.

Balanced targets: the least number of pieces gives targets of equal length, each
target is moved to the strongest boundary near it, and if a piece still passes
the limit, the text is cut again into one piece more. Boundaries are ranked
claims, paragraphs, lines, sentences, words; tokens serve only where a text has
none of these. All positions are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstream.llm.tokenizer import VOCABULARY, Encoder, encoder, has_over, share

LIMIT, OVERLAP = 4096, 128
CLAIM, PARAGRAPH, LINE, SENTENCE, WORD, TOKEN = 5, 4, 3, 2, 1, 0
#: A pre-token of more tokens than this may be cut inside.
LONG = 64

#: Where a piece may begin: the group's start is the boundary.
BOUNDARIES = (
    (SENTENCE, r"[.!?;:][\"')\]]*\s+(?=(\S))|[。！？；](?=(.))"),
    (LINE, r"[\r\n]+[ \t]*(?=(\S))"),
    (PARAGRAPH, r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*(?=(\S))|[\r\n]\s*(?=(\[\d{3,5}\]|§|#))"),
    (CLAIM, r"(?:^|[\r\n])[ \t]*(?=((?:claim\s+|anspruch\s+|revendication\s+)?\d{1,3}\s*[.)．、]\s*\S|【[^\d】\n]{1,12}\d+】|\[(?:claim|請求項)\s*\d+\]))"),
)


def boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """The strength of a cut before each unit; a unit may carry the boundary's white space in front."""
    import regex

    strength = np.zeros(len(starts), np.int8)
    spaced = [i for i, p in enumerate(starts.tolist()) if text[p].isspace() or p and text[p - 1].isspace()]
    strength[spaced] = WORD
    for rank, pattern in BOUNDARIES:
        flags = regex.I | regex.M if rank == CLAIM else 0
        at = [next(m.start(g) for g in range(1, m.re.groups + 1) if m.start(g) >= 0) for m in regex.finditer(pattern, text, flags)]
        if at:
            pos = np.asarray(at)
            unit = np.searchsorted(starts, pos, "right") - 1
            exact = np.array([starts[u] == p or text[starts[u] : p].isspace() for u, p in zip(unit.tolist(), pos.tolist())])
            unit = np.where(exact, unit, np.minimum(unit + 1, len(starts) - 1))
            strength[unit] = np.maximum(strength[unit], rank)
    return strength


def units(enc: Encoder, words: list[str], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code point and token position of each place a text may be cut, and of its end."""
    chars, tokens, at, n = [], [], 0, 0
    for w, i in zip(words, ids):
        chars.append(at)
        tokens.append(n)
        if len(i) > LONG:  # between tokens that end with a character
            done, raw = 0, b""
            for k, piece in enumerate(enc.token_bytes(i)[:-1], 1):
                raw += piece
                try:
                    done += len(raw.decode())
                except UnicodeDecodeError:
                    continue
                raw = b""
                chars.append(at + done)
                tokens.append(n + k)
        at += len(w)
        n += len(i)
    return np.array([*chars, at]), np.array([*tokens, n])


def _cuts(chars: np.ndarray, tokens: np.ndarray, strength: np.ndarray, k: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """k pieces as unit ranges, or None where a limit fails."""
    n, last, out, s = int(tokens[-1]), len(tokens) - 1, [], 0
    for left in range(k, 1, -1):
        begin = int(tokens[s])
        if n - begin <= limit and left == 1:
            break
        target = begin + (n - begin + (left - 1) * overlap) / left
        top = min(begin + limit, n - 1)
        floor = begin + overlap + 1
        best = None
        for reach in (limit // 8, limit // 2, limit):
            lo, hi = (int(np.searchsorted(tokens, x)) for x in (max(floor, target - reach), min(top, target + reach) + 1))
            lo, hi = max(lo, s + 1), min(hi, last)
            if lo >= hi:
                continue
            near = strength[lo:hi].astype(float) - np.abs(tokens[lo:hi] - target) / (4 * limit)
            at = lo + int(near.argmax())
            best = at if best is None or strength[at] > strength[best] else best
            if strength[best] >= SENTENCE:
                break
        if best is None:
            return None
        out.append((s, best))
        s = max(s + 1, int(np.searchsorted(tokens, tokens[best] - overlap, "right")) - 1)
    out.append((s, last))
    return out if all(tokens[e] - tokens[b] <= limit for b, e in out) else None


def pieces(enc: Encoder, text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of one text; a text within the limit is one piece, an empty one none.

    Consecutive pieces share at least ``overlap`` tokens, counted in the text as well as
    of the shared part alone, up to the next place where a text may be cut. Each
    piece's count is that of its own text.
    """
    if not text:
        return []
    words = enc.split(text)
    ids = enc.words(words)
    n = sum(map(len, ids))
    if n <= limit:
        return [(0, len(text), n)]
    chars, tokens = units(enc, words, ids)
    strength = np.r_[boundaries(text, chars[:-1]), np.int8(CLAIM)]
    k = max(2, -(-(n - overlap) // (limit - overlap)))
    while True:
        cut = _cuts(chars, tokens, strength, k, limit, overlap)
        if cut:
            for i in range(1, len(cut)):  # a shared part encoded by itself may have a token less than within the text
                b, e = cut[i]
                while b - 1 > cut[i - 1][0] and enc.count(text[int(chars[b]) : int(chars[cut[i - 1][1]])]) < overlap:
                    b -= 1
                cut[i] = (b, e)
            spans = [(int(chars[b]), int(chars[e])) for b, e in cut]
            counts = [enc.count(text[b:e]) for b, e in spans]
            if max(counts) <= limit:
                return [(b, e, c) for (b, e), c in zip(spans, counts)]
        k += 1
        if k > n:
            raise ValueError("the limit is below what one character needs")


def split_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(key, text, pieces) of the texts of more than ``limit`` tokens, pieces as ARRAY<STRUCT<start, end, n_tokens>>.

    Texts of at most ``limit`` bytes cannot have more tokens and are passed by.
    Null and empty texts have no pieces. Positions count code points from 0, the end
    exclusive. Rows with the same key are cut each by itself.
    """
    if overlap * 2 >= limit:
        raise ValueError("the overlap must be less than half the limit")
    shared = share(docs.sparkSession, vocabulary)
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32())]))

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared)
        for b in batches:
            rows = (pieces(enc, t.as_py(), limit, overlap) for t in b)
            yield pa.array([[{"start": s, "end": e, "n_tokens": n} for s, e, n in r] if len(r) > 1 else [] for r in rows], struct)

    cut_udf = F.arrow_udf(cut, "array<struct<start:int,end:int,n_tokens:int>>")
    large = docs.select(key, text).filter(has_over(F.col(text), limit))
    return large.withColumn("pieces", cut_udf(F.col(text))).filter(F.size("pieces") > 1)


def piece_rows(split: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_no, start, end, n_tokens, piece): a row per piece with its text."""
    flat = split.select(key, text, F.posexplode("pieces").alias("piece_no", "p"))
    piece = F.substring(F.col(text), F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    return flat.select(key, (F.col("piece_no") + 1).alias("piece_no"), "p.start", "p.end", "p.n_tokens", piece.alias("piece"))
