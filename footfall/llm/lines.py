"""Line dedup that can be undone: cuckoo filters in shards, backed by exact reference counts.

The state has one row for each shard of the line keys: its keys, the number of documents that hold each, and a cuckoo filter of
those in so many documents that their lines are dropped. Documents are added and deleted by changing counts; a key
that passes the limit enters the filter or leaves it. Cleaning brings line keys to their shard, where the filter is asked first and the
exact counts decide on what it lets through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall.llm.common import NULL_ID, raw, stored
from footfall.llm.cuckoo import CuckooFilter

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Keys that a shard holds, about.
SHARD_KEYS = 100_000

#: Line keys that ask a shard's filter in one group, about.
ASKED = 250_000

STATE = "shard int, keys binary, counts binary, filter binary"


@dataclass(frozen=True)
class LineCounts:
    """Reference counts of the lines of some documents, and what makes a line one to drop."""

    shards: int
    state: DataFrame
    min_docs: int
    min_chars: int


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _line_keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
            found = {_key(line, min_chars) for line in (text or b"").split(b"\n")} - {None}
            docs += [NULL_ID if doc is None else doc] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], names=["doc", "key"])


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Columns doc and key: each key of a document's lines, once for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_line_keys, min_chars=min_chars), "doc long, key binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _unpack(data: bytes) -> list[bytes]:
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def _update(left: pa.Table, right: pa.Table, sign: int, min_docs: int) -> pa.Table:
    """The state of one shard after its counts change."""
    old: dict[bytes, int] = {}
    known = CuckooFilter()
    shard = (left if left.num_rows else right).column("shard")[0].as_py()
    if left.num_rows:
        row = left.slice(0, 1).to_pylist()[0]
        old = dict(zip(_unpack(row["keys"]), np.frombuffer(row["counts"], np.int64).tolist()))
        known = CuckooFilter.from_bytes(row["filter"])
    entered, left_out = [], []
    for key, n in zip(right.column("key").to_pylist(), right.column("n").to_pylist()):
        before = old.get(key, 0)
        after = old[key] = before + sign * n
        if after <= 0:
            del old[key]
        if before < min_docs <= after:
            entered.append(key)
        elif after < min_docs <= before:
            left_out.append(key)
    known.remove(left_out)
    if not known.add(entered):
        known = CuckooFilter.of([key for key, n in old.items() if n >= min_docs])
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()),
            "keys": pa.array([b"".join(old)], pa.binary()),
            "counts": pa.array([np.fromiter(old.values(), np.int64, len(old)).tobytes()], pa.binary()),
            "filter": pa.array([known.to_bytes()], pa.binary()),
        }
    )


def _changed(counts: LineCounts, keys: DataFrame, sign: int) -> LineCounts:
    min_docs = counts.min_docs
    per_key = keys.distinct().groupBy("key").agg(F.count("*").alias("n")).withColumn("shard", _shard(counts.shards))
    state = (
        counts.state.groupBy("shard")
        .cogroup(per_key.groupBy("shard"))
        .applyInArrow(lambda left, right: _update(left, right, sign, min_docs), STATE)
    )
    return LineCounts(counts.shards, stored(state, "line-counts"), counts.min_docs, counts.min_chars)


def empty(spark: SparkSession, shards: int, min_docs: int = 10, min_chars: int = 1) -> LineCounts:
    """Counts of no documents. ``shards`` should leave each about ``SHARD_KEYS`` different lines."""
    return LineCounts(shards, spark.createDataFrame([], STATE), min_docs, min_chars)


def insert(counts: LineCounts, docs: DataFrame) -> LineCounts:
    """The counts with these documents added. Rows that share a doc_id are one document; a null doc_id is one, too."""
    return _changed(counts, line_keys(docs, counts.min_chars), 1)


def delete(counts: LineCounts, docs: DataFrame) -> LineCounts:
    """The counts without these documents, which were added before with the same texts."""
    return _changed(counts, line_keys(docs, counts.min_chars), -1)


def references(counts: LineCounts) -> DataFrame:
    """Columns key and n_docs, exactly."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(row["keys"]), pa.binary()), pa.array(np.frombuffer(row["counts"], np.int64))], names=["key", "n_docs"])

    return counts.state.select("keys", "counts").mapInArrow(rows, "key binary, n_docs long")


def _known(keys: DataFrame, counts: LineCounts) -> DataFrame:
    """The rows of ``keys`` (doc, key) whose lines are to be dropped.

    Rows and state meet by shard, where the filter turns most rows away and the exact counts decide on the rest; nothing goes through the driver. The rows of a shard are dealt to
    as many groups as they need, by their document, so a line that a third of all documents hold is many groups' work.
    """
    keys = keys.withColumn("shard", _shard(counts.shards))
    parts = keys.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    asked = keys.join(parts, "shard").select("doc", "key", "shard", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"))
    state = counts.state.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "keys", "counts", "filter")
    together, min_docs = asked.groupBy("shard", "part").cogroup(state.groupBy("shard", "part")), counts.min_docs
    return together.applyInArrow(lambda rows, known: _ask(rows, known, min_docs), "doc long, key binary")


def _ask(rows: pa.Table, known: pa.Table, min_docs: int) -> pa.Table:
    rows = rows.select(["doc", "key"])
    if not known.num_rows or not rows.num_rows:
        return rows.slice(0, 0)
    state = known.slice(0, 1).to_pylist()[0]
    keys = rows.column("key").to_pylist()
    passed = CuckooFilter.from_bytes(state["filter"]).contains(keys)
    # The filter may let others through; the counts do not.
    exact = {key for key, n in zip(_unpack(state["keys"]), np.frombuffer(state["counts"], np.int64).tolist()) if n >= min_docs}
    return rows.filter(pa.array([bool(maybe) and key in exact for maybe, key in zip(passed, keys)], pa.bool_()))


def _clean(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, gone in zip(raw(batch.column("text")), batch.column("gone").to_pylist()):
            lines = (text or b"").split(b"\n")
            keep = lines
            if gone:
                gone = set(gone)
                keep = [line for line in lines if _key(line, min_chars) not in gone]
            texts.append(b"\n".join(keep).decode())
            counts.append(len(lines))
            dropped.append(len(lines) - len(keep))
        names = [n for n in batch.schema.names if n != "gone"]
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])


ADDED = ("n_lines", "n_dropped")


def clean(counts: LineCounts, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The documents, in all their columns, without the lines that the counts say to drop; with the columns n_lines (before) and n_dropped at the end.

    Columns of ``docs`` with one of these two names, in upper or lower case, are replaced. A null or empty text is one empty line; a text that loses all lines is empty. ``keys`` may hold the line keys of the documents, if they are at hand.
    """
    keys = line_keys(docs, counts.min_chars) if keys is None else keys
    gone = _known(keys, counts).groupBy("doc").agg(F.collect_set("key").alias("gone"))
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    doc_id = names[docs.columns.index("doc_id")]
    joined = docs.toDF(*names).join(gone, F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)) == F.col("doc"), "left").select(*names, "gone")
    schema = T.StructType([*[f for f in joined.schema.fields if f.name != "gone"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    out = joined.mapInArrow(partial(_clean, min_chars=counts.min_chars), schema).select(*[names[docs.columns.index(c)] for c in kept], *ADDED)
    return out.toDF(*kept, *ADDED)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents, in all of them.

    A key is the line without white space at both ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code points are never
    dropped. Returns the documents as :func:`clean` does. Documents that share a doc_id count once, so do those without one; equal rows get equal
    results. A null text is one empty line; a text that loses all lines is empty. An empty table gives an empty result.
    """
    keys = stored(line_keys(docs, min_chars), "line-keys")
    shards = 1 + (keys.agg(F.approx_count_distinct("key")).first()[0] or 0) // shard_keys
    counts = _changed(empty(docs.sparkSession, shards, min_docs, min_chars), keys, 1)
    return clean(counts, docs, keys)


def cleaned_documents(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The documents in exactly their columns, whatever the names of the others, with the texts of :func:`dedup_lines`; a column n_chars, a long, follows the text."""
    names = ["doc_id" if c == "doc_id" else "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    out = dedup_lines(docs.toDF(*names), min_docs, min_chars, shard_keys)
    length = F.length("text").cast("long")
    return out.select(*[length.alias(n) if c == "n_chars" else F.col(n) for n, c in zip(names, docs.columns)]).toDF(*docs.columns)
