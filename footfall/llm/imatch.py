"""Document fingerprints by I-Match: hashes of a document's terms in a band of document frequency, over several random lexicons.

The lexicon holds the terms whose document frequency lies in the band; the members of a large group of copies or near copies count as about one document. A text with few
terms in the lexicon is completed by its rarest terms above the band. Each fingerprint part belongs to a random
subset of the lexicon: a document's distinct terms in the subset are sorted and hashed. Subsets come in levels of density, so that short and long
documents both have parts that a small edit leaves alone. The likeness of two fingerprints is the share of equal parts on the level that agrees best.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import NULL_ID, shuffle_partitions, stored

#: Shares of the documents that hold a term of the lexicon.
BAND = (0.0005, 0.02)

#: Terms that a text is taken by at least: this share of its distinct terms, and this many, if it has them; see :meth:`Reader.terms`.
LEAST_SHARE, LEAST_TERMS = 0.25, 8

#: Sketches of a text, and least terms in each. Texts that share nine tenths of their terms have a sketch in common but for one pair in some thousands.
SKETCHES, SKETCH_TERMS = 8, 4

#: Weight of a document without near copies; whole numbers add up to the same in any order.
UNIT = 1 << 20

#: Densities of the random subsets, and subsets of each density.
LEVELS = tuple(2.0**-k for k in range(1, 11))
SUBSETS = 12

#: Parts that must be filled, in one document or the other, for a level to count.
LEAST_PARTS = 4

KNOWN_WORDS = 400_000
PUNCTUATION = string.punctuation


class Terms(dict):
    """The term number (64-bit hash) of a word as written; 0 for one that is only punctuation."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        term = word.strip(PUNCTUATION).lower()
        value = self[word] = xxhash.xxh3_64_intdigest(term) if term else 0
        return value

    def of(self, text: str) -> set[int]:
        """The distinct terms of a text."""
        found = set(map(self.__getitem__, set(text.split())))
        found.discard(0)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ORDERS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _sketches(terms: set[int]) -> list[int]:
    """The hash of the ``SKETCH_TERMS`` least terms in each of ``SKETCHES`` orders. Texts whose terms are nearly the same have some in common."""
    mixed = _mix(np.fromiter(terms, np.uint64, len(terms))[None, :] ^ _ORDERS[:, None])
    if len(terms) > SKETCH_TERMS:
        mixed = np.partition(mixed, SKETCH_TERMS - 1, axis=1)[:, :SKETCH_TERMS]
    return _mix(_mix(mixed).sum(1, dtype=np.uint64) ^ _ORDERS).view(np.int64).tolist()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sketch, key, n, same): each sketch of each document, ``same`` telling its text, and how many documents hold each term; term 0 stands for the document."""
    known, counts = Terms(), Counter()

    def rows(sketch: bool, keys: np.ndarray, ns: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), sketch)), pa.array(keys.view(np.int64)), pa.array(ns), pa.array(same)], names=["sketch", "key", "n", "same"])

    def counted() -> pa.RecordBatch:
        out = rows(False, np.fromiter(counts, np.uint64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)), np.zeros(len(counts), np.int64))
        counts.clear()
        return out

    for batch in batches:
        sketches = []
        for text in batch.column("text").to_pylist():
            found = known.of(text or "")
            sketches += _sketches(found)
            found.add(0)
            counts.update(found)
            if len(counts) > KNOWN_WORDS:
                yield counted()
        yield rows(True, np.array(sketches, np.int64).view(np.uint64), np.ones(len(sketches), np.int64), np.repeat(batch.column("same").to_numpy(), SKETCHES))
    yield counted()


def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms of texts of large groups (text, docs, copies) count less than one for each document."""
    known, less = Terms(), Counter()
    for batch in batches:
        for text, docs, copies in zip(*(batch.column(c).to_pylist() for c in ("text", "docs", "copies"))):
            change = docs * (max(1, UNIT // copies) - UNIT)
            for term in known.of(text or ""):
                less[term] += change
            if len(less) > KNOWN_WORDS:
                yield _terms(less)
    yield _terms(less)


def _terms(counts: Counter) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(np.fromiter(counts, np.uint64, len(counts)).view(np.int64)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["term", "n"])
    counts.clear()
    return out


def vocabulary(docs: DataFrame, band: tuple[float, float] = BAND) -> tuple[np.ndarray, np.ndarray]:
    """The sorted numbers of the terms in the band, and those of the terms above it, rarest first.

    Documents are weighted: members of a group that has a sketch in common, and holds more than a quarter of the band's upper end of the documents, count
    as one together; smaller groups cannot lift a term out of the band by themselves. There are at most ``SKETCHES`` / that share such groups. One pass reads all texts for
    sketches and counts; then one text of each kind (by a 64-bit hash) in a large group is read again for what it counts less. A document
    of m distinct terms counts m times in the frequencies, so at most (mean of m) / share terms are in at least that share of the documents. That bounds both
    results by the length of the documents, whatever their number: 400,000 terms in the band for a mean of 200 distinct terms, 20 bytes for each in a task.
    """
    texts = docs.select("text", F.xxhash64("text").alias("same"))
    read = stored(texts.mapInArrow(_read, "sketch boolean, key long, n long, same long"), "terms")
    counts = read.where("not sketch").select(F.col("key").alias("term"), (F.col("n") * UNIT).alias("n"))
    total = counts.where("term = 0").agg(F.sum("n")).first()[0] or 0
    large = read.where("sketch").groupBy("key").agg(F.count("*").alias("copies")).where(F.col("copies") >= max(2, band[1] / 4 * (total // UNIT)))
    members = stored(read.where("sketch").join(large, "key").groupBy("same", "key").agg(F.count("*").alias("docs"), F.max("copies").alias("copies")).groupBy("same").agg(F.max("docs").alias("docs"), F.max("copies").alias("copies")), "members")
    n = total + (members.agg(F.sum(F.col("docs") * (F.greatest(F.lit(1), F.floor(UNIT / F.col("copies"))) - UNIT))).first()[0] or 0)
    once = texts.join(members, "same").groupBy("same").agg(F.first("text").alias("text"), F.max("docs").alias("docs"), F.max("copies").alias("copies"))
    less = once.select("text", "docs", "copies").mapInArrow(_correct, "term long, n long")
    counts = stored(counts.unionAll(less).groupBy("term").agg(F.sum("n").alias("n")), "term-counts").where("term != 0")
    low, high = band[0] * n, band[1] * n
    inside = counts.where((F.col("n") >= low) & (F.col("n") <= high)).select("term").toPandas()["term"]
    above = counts.where((F.col("n") >= low) & (F.col("n") > high)).orderBy("n", "term").select("term").toPandas()["term"]
    return np.sort(inside.to_numpy(np.int64).view(np.uint64)), above.to_numpy(np.int64).view(np.uint64)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The sorted numbers of the terms in the band; see :func:`vocabulary`."""
    return vocabulary(docs, band)[0]


PARTS = len(LEVELS) * SUBSETS
_SEEDS = _mix(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LIMITS = np.repeat(np.array([int(level * 2**64) for level in LEVELS], np.uint64), SUBSETS)


class Lexicons:
    """The lexicon's terms, and for each the subsets that hold it, one list behind the other; and the terms above the band, rarest first."""

    def __init__(self, terms: np.ndarray, above: np.ndarray = np.empty(0, np.uint64)):
        self.terms, self.above = terms, above
        # For looking up what may be greater than all terms.
        self.padded = np.r_[terms, np.uint64(0)]
        drawn = [_drawn(terms[k : k + 10_000]) for k in range(0, len(terms), 10_000)]
        counts = [np.bincount(term, minlength=min(10_000, len(terms) - 10_000 * k)) for k, (term, _) in enumerate(drawn)]
        self.subsets = np.concatenate([*(subset.astype(np.uint8) for _, subset in drawn), np.empty(0, np.uint8)])
        self.ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))

    def reader(self) -> "Reader":
        return Reader(self)


def _drawn(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``terms`` and number of each subset that a term is drawn for."""
    return np.nonzero(_mix(terms[:, None] ^ _SEEDS[None, :]) < _LIMITS[None, :])


class Reader:
    """Fingerprints of texts, in one task."""

    def __init__(self, lexicons: Lexicons):
        self.lexicons, self.known = lexicons, Terms()
        self.above = dict(zip(lexicons.above.tolist(), range(len(lexicons.above))))

    def terms(self, every: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The sorted terms of a text with few terms (``inside``) in the lexicon: these and, up to the least number, its rarest above the band, then
        those below it by their number. With one more term in the lexicon it has one of these less, so the choice changes by no more than the text."""
        missing = max(LEAST_TERMS, math.ceil(LEAST_SHARE * len(every))) - len(inside)
        others = set(every.tolist()) - set(inside.tolist())
        rest = heapq.nsmallest(max(0, missing), others, key=lambda term: (self.above.get(term, len(self.above)), term))
        return np.sort(np.array([*inside.tolist(), *rest], np.uint64))

    def members(self, found: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term and subset of each membership of a text with the terms ``found``, in the order of the terms; with few in the lexicon it is completed, see :meth:`terms`."""
        every = np.fromiter(found, np.uint64, len(found))
        every.sort()
        places = self.lexicons.terms.searchsorted(every)
        at = places[self.lexicons.padded[places] == every]
        if len(at) >= max(LEAST_TERMS, LEAST_SHARE * len(every)):
            first, end = self.lexicons.ends[at], self.lexicons.ends[at + 1]
            n = end - first
            before = n.cumsum()
            drawn = np.arange(before[-1]) + np.repeat(end - before, n)
            return np.repeat(self.lexicons.terms[at], n), self.lexicons.subsets[drawn]
        terms = self.terms(every, self.lexicons.terms[at])
        term, subset = _drawn(terms)
        return terms[term], subset

    def parts(self, text: str) -> np.ndarray:
        """A text's fingerprint: a 32-bit hash for each subset, 0 where it has no term."""
        return self.parts_of(self.known.of(text))

    def parts_of(self, found: set[int]) -> np.ndarray:
        """The fingerprint of a text with the terms ``found``."""
        terms, subset = self.members(found)
        out = np.zeros(PARTS, np.uint32)
        if len(subset):
            terms = terms[subset.argsort(kind="stable")]
            counts = np.bincount(subset, minlength=PARTS)
            filled = counts.nonzero()[0]
            counts = counts[filled]
            heads = counts.cumsum() - counts
            # A subset's terms are hashed in order: each with its rank, and then summed up.
            rank = np.arange(len(terms)) - np.repeat(heads, counts)
            hashes = np.add.reduceat(_mix(terms + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), heads)
            out[filled] = np.maximum(hashes >> np.uint64(32), np.uint64(1))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal parts among those filled in either, on the level where it is greatest; 1 for equal fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    filled = ((a > 0) | (b > 0)).reshape(len(LEVELS), SUBSETS).sum(1)
    equal = ((a == b) & (a > 0)).reshape(len(LEVELS), SUBSETS).sum(1)
    use = filled >= min(LEAST_PARTS, filled.max())
    return float((equal[use] / np.maximum(filled[use], 1)).max())


def written(fingerprint: np.ndarray) -> str:
    """Four hexadecimal digits for each part, the lower half of its hash."""
    return fingerprint.astype(">u2").tobytes().hex()


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    reader = sent.value.reader()
    for batch in batches:
        found = [written(reader.parts(text or "")) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, lexicons: Lexicons) -> DataFrame:
    """Columns doc_id and fingerprint (hexadecimal, four digits for each part), one row for each row of ``docs``; a null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_fingerprint_rows, sent=sent), "doc_id long, fingerprint string")


# --- each document with its successor ---------------------------------------------------------------

PACKED = "bucket int, last boolean, id long, tie long, doc_id long, packed binary"


def _pack(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids = batch.column("id").to_numpy()
        packed = [squeeze.compress(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        given = batch.column("bucket").to_pylist()
        bucket = [int(b) if g is None else g for b, g in zip(np.searchsorted(cuts, ids), given)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array([g is not None for g in given]), batch.column("id"), batch.column("tie"), batch.column("doc_id"), pa.array(packed, pa.binary())],
            names=["bucket", "last", "id", "tie", "doc_id", "packed"],
        )


def in_order(docs: DataFrame) -> DataFrame:
    """The documents (columns of ``PACKED``) sorted by doc_id within buckets, each bucket followed by the first document of the next (``last``).

    The first bucket follows the last. Buckets are ranges of doc_id, as many as shuffle partitions, cut by a histogram of the ids; only the
    ids of their first documents come to the driver, one for each bucket. Null ids come first; rows of one id are in the order of a hash of their text.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(ids.alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = shuffle_partitions(docs.sparkSession)
    cuts = np.unique(rows.select("id").approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n)).astype(np.int64)
    found = rows.select("id").mapInArrow(partial(_least_ids, cuts=cuts), "bucket int, id long").groupBy("bucket").agg(F.min("id").alias("id"))
    heads = [(r.id, r.bucket) for r in found.orderBy("bucket").collect()]
    if not heads:
        return docs.sparkSession.createDataFrame([], PACKED)
    # One row for each bucket: the id it begins with, and the bucket before, which that document follows.
    before = docs.sparkSession.createDataFrame([(head, heads[k - 1][1]) for k, (head, _) in enumerate(heads)], "id long, bucket int")
    first = rows.join(F.broadcast(before), "id").groupBy("id", "bucket").agg(F.min_by(F.struct("doc_id", "text", "tie"), "tie").alias("r"))
    first = first.select("id", "r.doc_id", "r.text", "r.tie", "bucket")
    both = rows.withColumn("bucket", F.lit(None).cast("int")).unionByName(first)
    packed = both.select("id", "doc_id", "text", "tie", "bucket").mapInArrow(partial(_pack, cuts=cuts), PACKED)
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket", "last", "id", "tie")


def _least_ids(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.sort(batch.column("id").to_numpy())
        bucket = np.searchsorted(cuts, ids).astype(np.int32)
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(ids) else []
        yield pa.RecordBatch.from_arrays([pa.array(bucket[heads], pa.int32()), pa.array(ids[heads], pa.int64())], names=["bucket", "id"])


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by the beginning of the next."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def whole_words(text: str) -> int:
    """Where the words end that a text and its edited form surely share: before the word that the last quarter begins in or behind."""
    end = len(text) - len(text) // 4
    while end and not text[end - 1].isspace():
        end -= 1
    return end


@dataclass
class Read:
    """A text, the terms of the words that its edited form shares, and its fingerprint."""

    bucket: int
    doc_id: int | None
    text: str
    shared: set[int]
    parts: np.ndarray


def _compare(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    reader = sent.value.reader()
    terms = reader.known.of
    previous = None
    for batch in batches:
        rows = []
        for bucket, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "packed"))):
            text = zstandard.decompress(packed).decode("utf-8") if packed else ""
            # Three quarters of the terms are those of the edited text too, and looked up once for both.
            end = whole_words(text)
            shared = terms(text[:end])
            now = Read(bucket, doc_id, text, shared, reader.parts_of(shared | terms(text[end:])))
            if previous is not None and previous.bucket == bucket:
                before = previous
                other = edited(before.text, text)
                changed = reader.parts_of(before.shared | terms(other[whole_words(before.text) :]))
                rows.append(
                    (before.doc_id, len(before.text), hashlib.sha256(other.encode()).hexdigest(), written(before.parts), written(changed), likeness(before.parts, changed), likeness(before.parts, now.parts))
                )
            previous = now
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in EDITED.split(", ")])


def compare_with_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """For each row of ``docs``: its fingerprint, that of its edited text (see :func:`edited`; the first document follows the last), and how alike they are.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited text and to the next
    document). A null text is empty; rows that share a doc_id follow each other in the order of a hash of their text; null ids come first. A single document follows
    itself; an empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Lexicons(*vocabulary(docs, band)))
    return in_order(docs).mapInArrow(partial(_compare, sent=sent), EDITED)
