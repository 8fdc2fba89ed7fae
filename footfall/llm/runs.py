"""Periodic runs of words: stretches that repeat with some period at least four times, found through a run-length grammar.

Recompression turns the word sequence into levels: blocks of one symbol become a symbol, then symbols are dealt to a left and a right
class and each left-right pair becomes a symbol. Equal symbols of a level stand for equal words, and equal stretches are parsed alike but for their
ends. So the longest common extension of two places goes up the levels while both are at borders of equal symbols, and down again where they differ.

A run of period p that lasts 4p words has 3p places in a row that agree with the one p words on, so every multiple of 3p is tried for each p:
a harmonic grid, n log n pairs in all. What agrees in its neighbourhood is extended both ways by the grammar, exactly. No suffix array is built.
All texts of a block share one grammar; words of different texts are different symbols, and a symbol found once parts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import WORD, blocks, raw

#: A run lasts at least so many periods, and at least so many words.
TIMES, LEAST = 4, 6

#: Pairs of places extended at once.
PAIRS = 1 << 18

#: Words on each side that a pair is compared by before the grammar is asked.
NEAR = 8


class Grammar:
    """The levels of a recompressed sequence: symbols, their starts (and the end), and how many equal symbols follow and precede each, itself included."""

    def __init__(self, sequence: np.ndarray, seed: int = 0):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rng = np.random.default_rng(seed)
        symbols, starts = sequence, np.arange(len(sequence) + 1)
        while True:
            first = np.r_[0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1]
            count = np.diff(first, append=len(symbols))
            place = np.arange(len(symbols))
            self.levels.append((symbols, starts, (np.repeat(first + count, count) - place).astype(np.int32), (place - np.repeat(first, count) + 1).astype(np.int32)))
            names, symbols, seen = np.unique(symbols[first] * (count.max() + 1) + count, return_inverse=True, return_counts=True)
            if seen.max() == 1:
                return
            starts = np.r_[starts[first], starts[-1]]
            left = rng.integers(0, 2, len(names)).astype(bool)[symbols]
            pairs = max(np.flatnonzero(left[:-1] & ~left[1:]), np.flatnonzero(~left[:-1] & left[1:]), key=len)
            if len(pairs):
                _, named = np.unique(symbols[pairs] * len(names) + symbols[pairs + 1], return_inverse=True)
                symbols[pairs] = len(names) + named
                symbols, starts = np.delete(symbols, pairs + 1), np.delete(starts, pairs + 1)

    def _borders(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which symbols of a level begin at the places, and whether both do."""
        starts = self.levels[level][1]
        a, b = np.searchsorted(starts, i), np.searchsorted(starts, j)
        return a, b, (starts[a] == i) & (starts[b] == j)

    def _step(self, level: int, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How far each pair of places agrees by the symbols of one level that begin (or end, going back) there; 0 if one is no border."""
        symbols, starts, ahead, behind = self.levels[level]
        a, b, border = self._borders(level, i, j)
        a, b = (a - 1, b - 1) if back else (np.minimum(a, len(symbols) - 1), np.minimum(b, len(symbols) - 1))
        runs = behind if back else ahead
        same = border & (symbols[a] == symbols[b])
        return np.where(same, np.minimum(runs[a], runs[b]) * (starts[a + 1] - starts[a]), 0)

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from places i and j on, or going back before them. The sequence begins and ends with a word found nowhere else."""
        out = np.zeros(len(i), np.int64)
        active = np.arange(len(i))
        sign, top = -1 if back else 1, len(self.levels)
        while len(active):
            before = out[active]
            # Up: on each level as far as the next level's borders meet. Down: as far as each level agrees.
            for level, rising in [*((k, True) for k in range(top - 1)), *((k, False) for k in reversed(range(top)))]:
                todo = active
                while len(todo):
                    step = self._step(level, i[todo] + sign * out[todo], j[todo] + sign * out[todo], back)
                    out[todo] += step
                    todo = todo[step > 0]
                    if rising and len(todo):
                        todo = todo[~self._borders(level + 1, i[todo] + sign * out[todo], j[todo] + sign * out[todo])[2]]
            active = active[out[active] > before]
        return out


def _near(words: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether a pair may belong to a run, by the words around it. ``words`` has NEAR words found nowhere else at each end."""
    total, full = np.ones(len(i), np.int64), np.zeros(len(i), bool)
    for sign in (1, -1):
        alive = np.ones(len(i), bool)
        for k in range(1, NEAR + 1):
            alive &= words[i + sign * k + NEAR] == words[i + p + sign * k + NEAR]
            total += alive
        full |= alive
    return full | (total >= np.maximum(LEAST - 1, (TIMES - 1) * p))


def _candidates(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods p of the grid whose words i and i + p agree, as do those around them, about PAIRS at a time."""
    padded = np.r_[np.arange(-NEAR, 0), words, np.arange(-2 * NEAR, -NEAR)]
    places, periods, n = [], [], 0
    for p in range(1, longest // TIMES + 1):
        step = (TIMES - 1) * p
        hits = np.flatnonzero(words[: len(words) - p : step] == words[p::step]) * step
        places.append(hits)
        periods.append(np.full(len(hits), p))
        n += len(hits)
        if n >= PAIRS or p == longest // TIMES:
            i, q = np.concatenate(places), np.concatenate(periods)
            near = _near(padded, i, q)
            yield i[near], q[near]
            places, periods, n = [], [], 0


def _sequence(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, no number in two texts, with a number of its own before each text and at the end; and where each text begins."""
    codes, begins, used, at = [], [], len(texts) + 1, 0
    for k, words in enumerate(texts):
        table: dict[bytes, int] = {}
        number = table.setdefault
        codes.append([k, *[number(w, used + len(table)) for w in words]])
        used += len(table)
        begins.append(at + 1)
        at += len(words) + 1
    codes.append([len(texts)])
    return np.concatenate([np.array(c, np.int64) for c in codes]), np.array(begins)


def _extended(words: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs that the pairs lie in."""
    grammar, found = Grammar(words), []
    for k in range(0, len(i), PAIRS):
        a, q = i[k : k + PAIRS], p[k : k + PAIRS]
        behind, ahead = grammar.extend(a, a + q, back=True), grammar.extend(a, a + q)
        length = behind + ahead + q
        real = length >= np.maximum(LEAST, TIMES * q)
        found.append(np.stack([a - behind, length, q], axis=1)[real])
    runs = np.concatenate(found)
    # The same stretch is found again for multiples of its period; the least one counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[fresh]


def find(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text, given as its words, the rows (start, length, period) of its runs by start, then period."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    if not any(texts):
        return out
    words, begins = _sequence(texts)
    pairs = list(_candidates(words, max(map(len, texts))))
    i, p = (np.concatenate(x) if pairs else np.empty(0, np.int64) for x in (tuple(zip(*pairs)) or ((), ())))
    if not len(i):
        return out
    # Only texts with a candidate need a grammar.
    owner = np.searchsorted(begins, i, side="right") - 1
    chosen = np.unique(owner)
    fewer, first = _sequence([texts[k] for k in chosen])
    at = np.searchsorted(chosen, owner)
    runs = _extended(fewer, i - begins[owner] + first[at], p)
    of = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs[:, 0] -= first[of]
    order = np.lexsort((runs[:, 2], runs[:, 0], of))
    runs, of = runs[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(chosen) + 1))
    for k, a, b in zip(chosen.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
        out[k] = runs[a:b]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            texts = [(text or b"").split() for text in raw(part.column("text"))]
            found = find(texts)
            rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            offsets = np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(RUN))
            collapsed = pa.array([collapse(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
            columns = [part.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), collapsed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_words, runs (array of start, length, period) and collapsed, one row for each row of ``docs``.

    A run is a stretch of words whose smallest period is q, at least max(6, 4q) words long, that no neighbouring word extends with that period. Runs come by
    start, then period; starts count words from 0. ``collapsed`` has the words that no run holds after its first q words, joined by one space. A null or empty text has
    no words and no runs. Repeated rows get equal results, an empty table an empty one; other columns are not read. There is no shuffle. A text of n words takes
    about n log n steps and 100 n bytes.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_runs, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The columns doc_id and text, where about a tenth of the texts repeat part of themselves from some word on.

    With h the CRC-32 of the decimal doc_id, g = h // 10 and n words: if h % 10 is 0 and n is positive, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 +
    (n - a) // (3 + g % 8). Such texts have their words joined by one space; others, and those without a doc_id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")

    def repeated(x: Column) -> Column:
        period = lambda i: x["a"] + F.pmod(i - x["a"], x["p"]) + 1
        return F.transform(x["words"], lambda w, i: F.when(i < x["a"], w).otherwise(F.element_at(x["words"], F.least(F.size(x["words"]), period(i).cast("int")))))

    facts = F.struct(words.alias("words"), a.alias("a"), p.alias("p"))
    text = F.array_join(F.element_at(F.transform(F.array(facts), repeated), 1), " ")
    # crc32 is never null for a number; rows without one keep their text.
    chosen = F.col("doc_id").isNotNull() & (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(WORD)
    return docs.select("doc_id", F.when(chosen, text).otherwise(F.col("text")).alias("text"))
