"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

A task hashes the windows of its documents and sends each distinct window of a block once, with its
earliest place, to the bucket of its hash. A bucket sees all blocks that hold a window: every place but
the earliest is a repeat. Repeats go on in packed arrays, one for each group of documents, and merge into maximal intervals in their document.

Hashes travel as packed arrays, one row for each block and bucket. A window in very many documents brings
one entry for each block, however many documents of the block hold it. The bucket number comes from a second hash,
so windows are told apart by 64 bits and the bits of the bucket number: more of them as the input grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import NULL_ID, blocks, raw, shuffle_partitions

#: Windows that a bucket holds on average at most; a task holds one bucket at a time, about 40 bytes a window.
BUCKET_WINDOWS = 4_000_000

#: Words whose hashes a task remembers.
KNOWN_WORDS = 400_000

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hash of a word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Rolling:
    """Rabin-Karp hashes modulo 2^64 of all windows of an array, from one running sum."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(max(n, 2 * len(self.up)), base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        hashes = (sums[width:] - sums[:-width]) * self.down[: len(values) - width + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        return hashes


def _pack(docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Places in document order, as runs of documents and differences of starts."""
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    runs = np.diff(np.r_[first, len(docs)])
    head = np.array([len(first)], np.int64).tobytes()
    steps = np.diff(starts, prepend=np.int32(0)).astype(np.int32)
    return zstandard.compress(head + docs[first].tobytes() + runs.astype(np.int32).tobytes() + steps.tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    docs = np.frombuffer(data, np.int64, n, 8)
    runs = np.frombuffer(data, np.int32, n, 8 + 8 * n)
    steps = np.frombuffer(data, np.int32, -1, 8 + 12 * n)
    return np.repeat(docs, runs), np.cumsum(steps, dtype=np.int32)


def _repeats(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which entries have an equal key at an earlier place."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    few = order[same[1:] | same[:-1]]  # entries whose key is not unique
    few = few[np.lexsort((starts[few], docs[few], keys[few]))]
    head = np.flatnonzero(np.r_[True, keys[few][1:] != keys[few][:-1]]) if len(few) else np.empty(0, np.int64)
    first = np.repeat(few[head], np.diff(np.r_[head, len(few)]))
    out = np.zeros(len(keys), bool)
    out[few] = (docs[few] != docs[first]) | (starts[few] != starts[first])
    return out


def _by_document(docs: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(docs):
        return
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(docs)]):
        yield int(docs[a]), starts[a:b].tobytes()


#: Windows for a bucket (its number), or repeats for a group of documents (-1 - its number; no hashes).
SENT = pa.schema([("key", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())])
REPEATS = pa.schema([("dest", pa.int32()), ("places", pa.binary())])
FOUND = pa.schema([("doc", pa.int64()), ("starts", pa.binary())])


def _by_destination(docs: np.ndarray, starts: np.ndarray, groups: int) -> list[tuple[int, bytes]]:
    """The places in packed arrays, one for each group of documents that has any."""
    mixed = docs.view(np.uint64) * np.uint64(BASES[1])
    dest = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(groups)).astype(np.int32)
    order = np.lexsort((starts, docs, dest))
    docs, starts, dest = docs[order], starts[order], dest[order]
    cuts = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]]) if len(dest) else dest
    return [(int(dest[a]), _pack(docs[a:b], starts[a:b])) for a, b in zip(cuts, np.r_[cuts[1:], len(docs)])]


def _hasher(width: int, buckets: int):
    """A task: windows for the buckets, and repeats inside a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolls = WordHashes(), [Rolling(base) for base in BASES]
        for batch in batches:
            for part in blocks(batch):
                ids = np.array([NULL_ID if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)
                texts = raw(part.column("text"))
                hashed = []
                order = np.argsort(ids, kind="stable")
                for i in order:
                    found = (texts[i] or b"").split()
                    hashed.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
                words = np.concatenate(hashed)
                if len(words) < width:
                    continue
                n = np.array([len(x) for x in hashed], np.int64)
                left = np.repeat(np.cumsum(n), n) - np.arange(len(words))
                at = np.flatnonzero(left >= width)
                if not len(at):
                    continue
                hashes, second = (r.windows(words, width)[at] for r in rolls)
                docs = np.repeat(ids[order], n)[at]
                starts = (np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n))[at].astype(np.int32)
                bucket = (second % np.uint64(buckets)).astype(np.int32)
                # Equal places of one document number are sent once; they are never repeats of each other.
                again = _repeats(hashes * np.uint64(BASES[0]) + second, docs, starts)
                if again.any():
                    rows = _by_destination(docs[again], starts[again], buckets)
                    yield pa.RecordBatch.from_pydict({"key": [-1 - x for x, _ in rows], "hashes": [None] * len(rows), "places": [x for _, x in rows]}, SENT)
                    hashes, docs, starts, bucket = hashes[~again], docs[~again], starts[~again], bucket[~again]
                order = np.argsort(bucket, kind="stable")
                hashes, docs, starts, bucket = hashes[order], docs[order], starts[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[cuts[1:], len(bucket)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": bucket[cuts],
                        "hashes": [hashes[a:b].tobytes() for a, b in zip(cuts, ends)],
                        "places": [_pack(docs[a:b], starts[a:b]) for a, b in zip(cuts, ends)],
                    },
                    SENT,
                )

    return run


def _count(table: pa.Table, groups: int) -> pa.Table:
    """One bucket: all places of windows that also start earlier. Repeats that a task has already found pass through."""
    if not table.column("hashes")[0].is_valid:
        return pa.Table.from_pydict({"dest": [-1 - k for k in table.column("key").to_pylist()], "places": table.column("places").to_pylist()}, REPEATS)
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
    docs, starts = _all_places(table)
    again = _repeats(keys, docs, starts)
    rows = _by_destination(docs[again], starts[again], groups)
    return pa.Table.from_pydict({"dest": [x for x, _ in rows], "places": [x for _, x in rows]}, REPEATS)


def _all_places(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    places = [_unpack(x) for x in table.column("places").to_pylist()]
    return np.concatenate([docs for docs, _ in places]), np.concatenate([starts for _, starts in places])


def _merge(table: pa.Table) -> pa.Table:
    """All repeats of a group of documents, one row for each document."""
    rows = list(_by_document(*_all_places(table)))
    return pa.Table.from_pydict({"doc": [x for x, _ in rows], "starts": [x for _, x in rows]}, FOUND)


def _remover(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, removed, spans = [], [], [], []
            for text, found in zip(raw(batch.column("text")), batch.column("starts").to_pylist()):
                words = (text or b"").split()
                cover = np.zeros(len(words) + 1, np.int32)
                if found:
                    starts = np.unique(np.frombuffer(found, np.int32))
                    starts = starts[starts + width <= len(words)]
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + width, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, x in zip(words, gone) if not x] if found else words).decode())
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return run


def dedup_substrings(docs: DataFrame, width: int = 20, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier.

    Earlier is a smaller ``doc_id``, or an earlier start in the same document. Windows are judged on the
    input. Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and spans (the
    maximal removed intervals, in words, end exclusive).

    A null text has no words; a text of fewer than ``width`` words keeps them all. A null doc_id comes before all others. Rows
    that share a doc_id are one document: equal rows get equal results, none is a repeat of the other, and
    what is removed at a place of one is removed at that place of all. Columns besides doc_id and text are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // (6 * bucket_windows)))
    sent = docs.mapInArrow(_hasher(width, buckets), "key int, hashes binary, places binary")
    counted = sent.groupBy("key").applyInArrow(lambda table: _count(table, buckets), "dest int, places binary")
    repeats = counted.groupBy("dest").applyInArrow(_merge, "doc long, starts binary")
    joined = docs.join(repeats, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("doc"), "left")
    return joined.select("doc_id", "text", "starts").mapInArrow(
        _remover(width), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start int, end int>>"
    )
