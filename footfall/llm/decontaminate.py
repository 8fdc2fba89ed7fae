"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Benchmark items are cut into overlapping pieces of two sizes: long ones, and short ones at a small stride, so that any passage of ``SHORT + STEP - 1``
characters of an item holds a whole piece, wherever it begins. A piece of m characters that occurs in a text with at most k edits shares at least m - q + 1 - k q
of its q-grams with it, on diagonals that lie within k of each other. Every place of a text is looked up in the table of q-grams; a text's hits are counted for each piece in
overlapping bands of diagonals, and the bands that reach the bound are aligned. Items too short for that are found exactly, all of them in one pass of an automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import blocks, map_rows

Q = 12
#: Characters of a piece, and from one piece to the next.
PIECE, STRIDE = 100, 50
#: The same for the short pieces: any 69 characters of an item in a row hold a whole one.
SHORT, STEP = 60, 10
#: Edits allowed for each character of a piece.
RATE = 0.06
#: Items with fewer characters, after normalising, are looked for as they are, as whole words; their q-grams are too few to allow an edit.
LEAST = 24
#: Characters of benchmark items that tasks get at once; about 120 bytes each. A larger benchmark goes in several blocks.
BLOCK_CHARS = 700_000
#: Alignments done at once.
BATCH = 2048

#: A code that equals no character.
NOTHING = 0xFFFFFFFF

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
MATCHES = "doc_id long, item_id long, start int, end int, edits int, pieces int"


def normalise(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Grams:
    """Rolling hashes of all q-grams of an array of code points."""

    def __init__(self, q: int):
        self.q, self.up, self.down = q, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n < self.q:
            return np.empty(0, np.uint64)
        if len(self.up) <= n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                powers = np.full(n + n // 2 + 1, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        values = (codes.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        values ^= values >> np.uint64(29)
        values *= self.up[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return (sums[self.q :] - sums[: -self.q]) * self.down[: n - self.q + 1]


@dataclass
class Pieces:
    """The pieces of some items and the table of their q-grams; short items are pieces without any, behind the others."""

    item: list[int | None]
    codes: list[np.ndarray]
    short: dict[str, range]  # a text, and the pieces of the items that have it
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray  # sorted
    piece: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # by the leading bits of a hash, whether any q-gram has them


def allowed(m: int, q: int, rate: float) -> int:
    """Edits for m characters: no more than leave a shared q-gram for certain."""
    return min(int(rate * m), (m - q) // q)


def _starts(size: int, piece: int, stride: int) -> list[int]:
    return list(dict.fromkeys(max(0, min(s, size - piece)) for s in range(0, max(1, size - piece + stride), stride)))


def cut(items: list[tuple[int | None, str]], q: int, piece: int, stride: int, rate: float, short: int = 0, step: int = 0, least: int = LEAST) -> Pieces:
    """Pieces of ``piece`` characters every ``stride``, and, if ``short`` is given, of ``short`` every ``step``; an item that has no more is one piece.

    Items of fewer than ``least`` characters, or too few for a q-gram, are not cut.
    """
    item, codes, exact = [], [], {}
    for number, text in items:
        text = normalise(text)
        if len(text) < max(least, q):
            exact.setdefault(text, []).append(number)
            continue
        whole = _codes(text)
        spans = [(start, piece) for start in _starts(len(whole), piece, stride)]
        if 0 < short < min(piece, len(whole)):
            spans += [(start, short) for start in _starts(len(whole), short, step)]
        for start, length in spans:
            item.append(number)
            codes.append(whole[start : start + length])
    grams = Grams(q)
    found = [grams(c) for c in codes]
    sizes = [len(f) for f in found]
    all_ = np.concatenate([*found, np.empty(0, np.uint64)])
    order = np.argsort(all_, kind="stable")
    bits = max(16, min(26, int(np.ceil(np.log2(len(all_) + 1))) + 5))
    maybe = np.zeros(1 << bits, bool)
    maybe[(all_ >> np.uint64(64 - bits)).astype(np.int64)] = True
    edits = np.array([allowed(len(c), q, rate) for c in codes], np.int64)
    bound = np.array(sizes, np.int64) - edits * q
    place = np.concatenate([*(np.arange(n, dtype=np.int32) for n in sizes), np.empty(0, np.int32)])
    known = {}
    for text, numbers in exact.items():
        known[text] = range(len(item), len(item) + len(numbers))
        item += numbers
    return Pieces(item, codes, known, edits, bound, all_[order], np.repeat(np.arange(len(codes), dtype=np.int32), sizes)[order], place[order], maybe)


def align(pieces: list[np.ndarray], texts: list[np.ndarray], edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits to turn each piece into a stretch of its text, and the stretch's start and end; over the budget: edits + 1 or more.

    Only the cells of a band are computed: the text is given from the first diagonal of the band on, so that piece place i meets text places i to i +
    ``width``. All pairs go through their rows together.
    """
    n, rows = len(pieces), max(map(len, pieces))
    width = max(len(t) - len(p) for p, t in zip(pieces, texts)) + 1
    lengths = np.array([len(p) for p in pieces])
    a = np.full((n, rows), 0xFFFFFFFE, np.uint32)
    b = np.full((n, rows + width), NOTHING, np.uint32)
    for k, (p, t) in enumerate(zip(pieces, texts)):
        a[k, : len(p)] = p
        b[k, : len(t)] = t
    far = 1 << 20
    steps = np.arange(width, dtype=np.int64)
    # Cost and start travel together: cost * far + start, so that the least cost, then the first start wins.
    cost = np.tile(steps, (n, 1))
    result = np.full((n, width), far * far, np.int64)
    for i in range(rows):
        same = b[:, i : i + width] == a[:, i : i + 1]
        now = np.where(same, cost, cost + far)
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + far)  # a character of the piece is left out
        now = np.minimum.accumulate(now - steps * far, axis=1) + steps * far  # characters of the text are left out
        cost = now
        done = lengths == i + 1
        result[done] = cost[done]
    best = result.argmin(1)
    value = result[np.arange(n), best]
    return value // far, value % far, best + lengths


def candidates(codes: np.ndarray, ends: np.ndarray, pieces: Pieces, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text (place in ``ends``), piece and first diagonal of each band with as many shared q-grams as the bound asks for.

    ``codes`` are texts one behind the other, ``ends`` where each ends. A band has twice the width that edits can spread over, and the next begins
    in its middle, so one of them holds all shared q-grams of an occurrence.
    """
    none = np.empty(0, np.int64)
    hashes = grams(codes)
    bits = len(pieces.maybe).bit_length() - 1
    at = np.flatnonzero(pieces.maybe[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
    first = np.searchsorted(pieces.grams, hashes[at], "left")
    many = np.searchsorted(pieces.grams, hashes[at], "right") - first
    at, first, many = at[many > 0], first[many > 0], many[many > 0]
    if not len(at):
        return none, none, none
    entry = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(at, many)
    text = np.searchsorted(ends, at, "right")
    start = np.r_[0, ends[:-1]][text]
    piece = pieces.piece[entry]
    diagonal = at - start - pieces.place[entry]
    step = pieces.edits[piece] + 1
    half = diagonal // step
    order = np.lexsort((half, piece, text))
    text, piece, half, place = text[order], piece[order], half[order], pieces.place[entry][order]
    new = np.r_[True, (text[1:] != text[:-1]) | (piece[1:] != piece[:-1]) | (half[1:] != half[:-1])]
    heads = np.flatnonzero(new)
    count = np.diff(np.r_[heads, len(new)])
    text, piece, half = text[heads], piece[heads], half[heads]
    # Hits in this half band and the next one; a band without hits in its first half is the second half of another.
    follows = np.r_[(text[1:] == text[:-1]) & (piece[1:] == piece[:-1]) & (half[1:] == half[:-1] + 1), False]
    both = count + np.where(follows, np.r_[count[1:], 0], 0)
    good = both >= pieces.bound[piece]
    return text[good], piece[good], half[good] * (pieces.edits[piece[good]] + 1)


def _machine(pieces: Pieces) -> ahocorasick.Automaton | None:
    """Finds the short items of a table."""
    if not pieces.short:
        return None
    machine = ahocorasick.Automaton()
    for text, numbers in pieces.short.items():
        machine.add_word(text, (numbers, len(text)))
    machine.make_automaton()
    return machine


def _whole(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond the ends of the stretch."""
    return not (start and text[start].isalnum() and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def _find(texts: list[str], pieces: Pieces, grams: Grams, machine: ahocorasick.Automaton | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """Text, piece, start, end (of the normalised text) and edits of each verified band, and of each short item."""
    for number, text in enumerate(texts if machine else ()):
        for last, (numbers, size) in machine.iter(text):
            if _whole(text, last + 1 - size, last + 1):
                for piece in numbers:
                    yield number, piece, last + 1 - size, last + 1, 0
    codes = _codes("\0".join(texts) + "\0")
    ends = np.cumsum([len(t) + 1 for t in texts])
    text, piece, diagonal = candidates(codes, ends, pieces, grams)
    for k in range(0, len(text), BATCH):
        part = slice(k, k + BATCH)
        some_pieces = [pieces.codes[p] for p in piece[part]]
        budget = pieces.edits[piece[part]]
        begins, sizes, stretches = [], [], []
        for t, p, d, e in zip(text[part], some_pieces, diagonal[part], budget):
            lo, hi = (ends[t - 1] if t else 0), ends[t] - 1
            begin = lo + d - e  # an edit to either side of the band's diagonals
            # Where the text begins or ends within the band, the stretch is filled up, so that the band has all its diagonals.
            stretch = np.full(len(p) + 4 * e + 2, NOTHING, np.uint32)
            first, last = max(lo, begin), min(hi, begin + len(stretch))
            stretch[first - begin : last - begin] = codes[first:last]
            begins.append(d - e)
            sizes.append(hi - lo)
            stretches.append(stretch)
        cost, start, end = align(some_pieces, stretches, budget)
        for i in np.flatnonzero(cost <= budget):
            yield int(text[k + i]), int(piece[k + i]), int(max(0, begins[i] + start[i])), int(min(sizes[i], begins[i] + end[i])), int(cost[i])


def _matches(batches: Iterator[pa.RecordBatch], sent, q: int) -> Iterator[pa.RecordBatch]:
    pieces, grams = sent.value, Grams(q)
    machine = _machine(pieces)
    for batch in batches:
        for part in blocks(batch):
            ids = part.column("doc_id").to_pylist()
            best: dict[tuple[int, int], list] = {}
            for text, piece, start, end, cost in _find([normalise(t) for t in part.column("text").to_pylist()], pieces, grams, machine):
                key = text, pieces.item[piece]
                old = best.setdefault(key, [start, end, cost, set()])
                old[:3] = min(old[0], start), max(old[1], end), min(old[2], cost)
                old[3].add(piece)
            rows = [(ids[t], item, a, b, cost, len(found)) for (t, item), (a, b, cost, found) in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=[c.split()[0] for c in MATCHES.split(", ")])


def _clean(batches: Iterator[pa.RecordBatch], sent, q: int) -> Iterator[pa.RecordBatch]:
    pieces, grams = sent.value, Grams(q)
    machine = _machine(pieces)
    for batch in batches:
        for part in blocks(batch):
            keep = np.ones(part.num_rows, bool)
            for text, *_ in _find([normalise(t) for t in part.column("text").to_pylist()], pieces, grams, machine):
                keep[text] = False
            yield part.filter(pa.array(keep))


def _blocks(benchmark: DataFrame, q: int, piece: int, stride: int, rate: float, least: int, short: int, step: int) -> Iterator:
    """The benchmark as broadcast tables of at most about ``BLOCK_CHARS`` characters each, by a hash of the item's text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // BLOCK_CHARS
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).distinct().collect()
        rows = sorted(((r.item_id, r.text) for r in rows if normalise(r.text)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield spark.sparkContext.broadcast(cut(rows, q, piece, stride, rate, short, step, least))


def find_matches(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, piece: int = PIECE, stride: int = STRIDE, rate: float = RATE, least: int = LEAST, short: int = SHORT, step: int = STEP
) -> DataFrame:
    """One row for each document and benchmark item that have a piece in common: doc_id, item_id, start, end, edits, pieces.

    Start and end (code points of the normalised text, end exclusive) span all matching pieces of the item, ``pieces`` of them; ``edits`` is the least of
    a piece. Text is compared in lower case with each run of white space one space. A piece has ``piece`` or
    ``short`` characters (no short ones if that is 0), or the whole item if that is shorter, and may differ by ``rate`` edits a character, but by no more than the q-gram bound
    can see. So ``short + step - 1`` characters of an item in a row are found for certain, wherever they begin, with the edits of a short piece. An item shorter than ``least`` characters is found where it
    stands as it is, with no word going on beyond its ends. Null and empty texts match nothing; item_id is null for an item without a
    number, and such items count as one. Repeated rows give repeated results; an empty table on either side gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for sent in _blocks(benchmark, q, piece, stride, rate, least, short, step):
        found = docs.mapInArrow(partial(_matches, sent=sent, q=q), MATCHES)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def remove_matches(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, piece: int = PIECE, stride: int = STRIDE, rate: float = RATE, least: int = LEAST, short: int = SHORT, step: int = STEP
) -> DataFrame:
    """The documents, in all their columns, that :func:`find_matches` finds nothing in. Rows stay where they are: nothing is shuffled."""
    for sent in _blocks(benchmark, q, piece, stride, rate, least, short, step):
        docs = map_rows(docs, partial(_clean, sent=sent, q=q))
    return docs
