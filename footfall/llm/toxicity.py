"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding lower-cases, undoes look-alike letters and digits in place of letters, and makes all else a space. A lexicon entry is a whole word or the
beginning of a word. Entries and weights are learned from labelled texts, or given; an exception phrase hides the entries inside it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from footfall.llm.common import map_rows, stored

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000

#: Beginnings of words have this many letters; lexicon entries of a whole word end with a space.
SHORTEST, LONGEST = 3, 12

#: An entry must be this much (natural logarithm) likelier in a toxic text, and hold in so many of them.
MIN_WEIGHT, MIN_TEXTS = 1.5, 3

#: Log odds of a text without hits at most: about 0.05, however many toxic texts the sample has that no entry explains.
NO_HIT = -3.0

#: Entries are added until each toxic text of the sample has this many, if it can.
COVER = 4


class _Folded(dict):
    """What a code point becomes; one by one, so that folding keeps places."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full width
            char = chr(code - 0xFEE0)
        char = char.lower()[:1]
        char = LOOKALIKES.get(char, char)
        char = SIGNS.get(char, char)
        value = self[code] = char if char.isalnum() else " "
        return value


_FOLDED = _Folded()


def fold(text: str) -> str:
    """The folded text with a space before and after; "l" and "1" fold alike, since either stands for the other."""
    # A sign stands for a letter only beside one; at the end of a word it is punctuation.
    return " " + " ".join(w.rstrip("!|") for w in text.split()).translate(_FOLDED) + " "


def _outside(found: list[tuple], hidden: list[tuple]) -> list[tuple]:
    """The spans of ``found`` (start, end, weight) that lie within none of ``hidden``, in the order of their ends: one sweep by start."""
    kept, reach, spans = [], -1, iter(sorted(hidden, key=lambda x: x[0]))
    following = next(spans, None)
    for span in sorted(found, key=lambda x: x[0]):
        while following is not None and following[0] <= span[0]:
            reach = max(reach, following[1])
            following = next(spans, None)
        if span[1] > reach:
            kept.append(span)
    return sorted(kept, key=lambda x: x[1])


@dataclass(frozen=True)
class Lexicon:
    """Weights of entries (folded, with a space before; a space behind ends a whole word), and exception phrases (folded words)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    #: Logistic regression on the two measures of :meth:`measures`.
    intercept: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)
    _built: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    def __setstate__(self, state):
        self.__dict__.update(state, _built=[])

    def _matcher(self) -> ahocorasick.Automaton:
        if not self._built:
            machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                machine.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                machine.add_word(" " + phrase + " ", (len(phrase) + 2, None))
            machine.make_automaton()
            self._built.append(machine)
        return self._built[0]

    def hits(self, text: str) -> list[tuple[int, float]]:
        """End and weight of each entry found outside exception phrases."""
        if not self.weights and not self.exceptions:
            return []
        found, hidden = [], []
        for end, (length, weight) in self._matcher().iter(fold(text)):
            (hidden if weight is None else found).append((end - length + 1, end, weight))
        return [(b, w) for _, b, w in (_outside(found, hidden) if hidden else found)]

    def measures(self, text: str) -> tuple[float, float]:
        """The logarithm of the summed weight of hits, and of that sum for 100 words."""
        total = sum(w for _, w in self.hits(text))
        return math.log1p(total), math.log1p(100 * total / max(1, len(text.split())))

    def score(self, text: str) -> float:
        x, y = self.measures(text)
        z = self.intercept + self.slopes[0] * x + self.slopes[1] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(text: str) -> set[str]:
    """Words of a folded text with spaces around them, and their beginnings with a space before."""
    out = set()
    for word in set(fold(text).split()):
        if len(word) >= SHORTEST:
            out.add(f" {word} ")
            out.update(" " + word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


def _count_features(batches: Iterator[pa.RecordBatch], among: dict[str, int] | None) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = features(text or "")
            counts.update(found if among is None else found & among.keys())
            if len(counts) > 500_000:
                yield rows()
    yield rows()


def _counts(texts: DataFrame, among: dict[str, int] | None = None) -> DataFrame:
    return texts.select("text").mapInArrow(partial(_count_features, among=among), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _incidence(batches: Iterator[pa.RecordBatch], among: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(sorted(among[f] for f in features(t or "") if f in among), np.int32).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["entries"])


def choose(weights: dict[str, float], texts: list[np.ndarray], names: list[str]) -> dict[str, float]:
    """The entries that cover toxic texts, best first, until each has ``COVER`` of them or none holds in ``MIN_TEXTS`` texts that still need one.

    ``texts`` has the numbers (places in ``names``) of the entries of each text. Of equally good entries the longer one
    counts, a whole word if it can be; an entry that begins with a chosen one adds nothing and is left out, and so is the beginning of a chosen one that few other texts have.
    """
    holders: dict[int, list[int]] = {}
    for t, entries in enumerate(texts):
        for e in entries.tolist():
            holders.setdefault(e, []).append(t)
    need = np.full(len(texts), COVER)
    chosen: dict[str, float] = {}
    chosen_in: dict[str, int] = {}
    # Gains only fall as texts get covered, so an entry whose gain is still the best after counting anew is the best.
    queue = [(-len(h) * weights[names[e]], -len(names[e]), names[e], e) for e, h in holders.items()]
    heapq.heapify(queue)
    while queue:
        value, _, name, e = heapq.heappop(queue)
        now = int((need[holders[e]] > 0).sum())
        if now < MIN_TEXTS or any(name.startswith(c) or c.startswith(name) and len(holders[e]) <= 1.1 * n for c, n in chosen_in.items()):
            continue
        if -now * weights[name] > value:
            heapq.heappush(queue, (-now * weights[name], -len(name), name, e))
            continue
        chosen[name] = weights[name]
        chosen_in[name] = len(holders[e])
        need[holders[e]] -= 1
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Intercept and slopes, by Newton steps on the mean loss with a small ridge on all of them."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * beta / max(1, len(y)) * 10
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.eye(x.shape[1]) * (ridge * 10 / max(1, len(y)) + 1e-9)
        step = np.linalg.solve(curve, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled documents that are not held out.

    At most ``sample`` labelled rows are used, the first in the order of a hash of doc_id; of rows with the same text one counts. The driver holds the candidate
    entries, those that ``MIN_TEXTS`` toxic texts of the sample share, and which texts have them, never texts: bounded by the sample, with no cap of their own. Without toxic texts, or without clean ones, the lexicon is empty. A label that is null is no label; of
    several labels for a document the highest holds.
    """
    ids = F.col("doc_id").cast("long")
    known = labels.select(ids.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(ids))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by `sample` rows of two numbers.
    rows = docs.select(ids.alias("doc_id"), "text").join(F.broadcast(known), "doc_id").where("text is not null")
    rows = stored(rows.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    toxic = _counts(rows.where("toxic = 1")).where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "entry").collect()
    among = {r.entry: i for i, r in enumerate(toxic)}
    clean = {r.entry: r.n for r in _counts(rows.where("toxic = 0"), among).collect()}
    weights = {r.entry: math.log((r.n + 0.5) / (bad + 1)) - math.log((clean.get(r.entry, 0) + 0.5) / (good + 1)) for r in toxic}
    among = {e: i for e, i in among.items() if weights[e] >= MIN_WEIGHT}
    holders = rows.where("toxic = 1").select("text").mapInArrow(partial(_incidence, among=among), "entries binary").collect()
    entries = choose(weights, [np.frombuffer(r.entries, np.int32) for r in holders], [r.entry for r in toxic])
    lexicon = Lexicon(entries, _exceptions(rows, Lexicon(entries)))
    found = rows.select("toxic", "text").mapInArrow(partial(_measure, lexicon=lexicon), "toxic int, x double, y double").toPandas()
    intercept, *slopes = fit_logistic(found[["x", "y"]].to_numpy(), found["toxic"].to_numpy().astype(float))
    return Lexicon(lexicon.weights, lexicon.exceptions, min(float(intercept), NO_HIT), tuple(map(float, slopes)))


def _around(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    phrases, toxic = [], []
    starts: dict[str, tuple[str, ...]] = {}
    for entry in lexicon.weights:
        starts[entry[1]] = (*starts.get(entry[1], ()), entry[1:])
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words, found = fold(text).split(), set()
            for i, word in enumerate(words):
                if (word + " ").startswith(starts.get(word[0], ())):
                    found.update(" ".join(words[max(0, a) : b]) for a, b in ((i - 1, i + 1), (i, i + 2)) if b - max(0, a) == 2)
            phrases += found
            toxic += [label] * len(found)
    yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())], names=["phrase", "toxic"])


def _exceptions(rows: DataFrame, lexicon: Lexicon, least: int = 10) -> tuple[str, ...]:
    """Pairs of words with an entry in them that at least ``least`` places of the sample have, nine tenths of them in clean texts."""
    if not lexicon.weights:
        return ()
    pairs = rows.select("text", "toxic").mapInArrow(partial(_around, lexicon=lexicon), "phrase string, toxic int")
    counted = pairs.groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("bad") * 10 <= F.col("n")))
    return tuple(sorted(r.phrase for r in counted.collect()))


def _measure(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [lexicon.measures(text or "") for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x for x, _ in both], pa.float64()), pa.array([y for _, y in both], pa.float64())], names=["toxic", "x", "y"])


def _scores(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([lexicon.score(text or "") for text in batch.column("text").to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "extra"])


def score(docs: DataFrame, lexicon: Lexicon, column: str = "toxicity") -> DataFrame:
    """The documents with one more column, 0 to 1 from their text alone; a column of that name is replaced.

    A null text scores like an empty one, as any text without a hit does.
    """
    return map_rows(docs.drop(column), partial(_scores, lexicon=lexicon), T.StructField(column, T.DoubleType()))


def _clean(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([lexicon.score(text or "") < threshold for text in batch.column("text").to_pylist()], pa.bool_()))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float) -> DataFrame:
    """The documents, in all their columns whatever their names, that score below ``threshold``; a null text scores like an empty one."""
    return map_rows(docs, partial(_clean, lexicon=lexicon, threshold=threshold))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Columns doc_id, held_out, score and predicted, one row for each row of ``docs``.

    The lexicon is learned by :func:`learn`. Only doc_id and text are read of the documents; a null doc_id is not held out. Repeated rows get equal scores. An empty
    table gives an empty result; without labels all score alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, learn(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
