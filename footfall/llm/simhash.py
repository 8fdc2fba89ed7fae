"""SimHash near-dedup: fingerprints joined by Hamming distance with vantage-point trees.

The distinct fingerprints are dealt to the leaves of a vantage-point tree whose upper part is fitted on a bounded sample.
Each lives in one leaf; one that lies within the distance of a boundary also visits the leaf behind it, so no pair is
lost. Inside a shard the same tree goes on down to small leaves, where all pairs are compared. A shard returns spanning links, not
pairs, so that a large group of near copies brings one link for each of its fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from footfall.llm.common import NULL_ID, blocks, raw, stored
from footfall.llm.components import components

#: Distinct fingerprints that live in a shard, about.
SHARD = 8192

#: Fingerprints that the upper tree is fitted on at most (8 bytes each, collected to the driver).
SAMPLE = 65536

#: Fingerprints that live in a leaf, within a shard.
LEAF = 192

#: Bytes of text that are hashed at once.
BLOCK = 1 << 20

#: Fingerprints that visit a shard in one task; beyond it they are dealt to several tasks, each with all that live there.
GUESTS = 32768

#: Fingerprints compared with a leaf at once.
CHUNK = 4096

LANES = np.uint64(0x0101010101010101)


# --- fingerprints ---------------------------------------------------------------------------------


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The shingle hashes of a text, in one array: 8 bytes for each word."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[k - 1 :] - 1).tolist())), np.uint64, n)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits that are set in over half of them; zero for an empty run.

    Eight bits are counted at a time in the bytes of a 64-bit sum, over at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    parts = -(-counts[full] // 255)
    offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(starts, parts) + 255 * offset
    runs = np.cumsum(parts) - parts
    half = counts[full][:, None]
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = 2 * np.add.reduceat(lanes.astype(np.int64), runs, axis=0) > half
        for byte in range(8):
            out[full] |= bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, limit=BLOCK):
            found = [_hashes(text, shingle) for text in raw(part.column("text"))]
            counts = np.array([len(x) for x in found], np.int64)
            hashes = np.concatenate(found)
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(majority_bits(hashes, counts).view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The columns ``keys`` (long) and fp (64 bits as a long): the bits that over half of the shingle hashes of a text have set.

    A-Z are lower-cased; shingles of ``shingle`` words count as often as they occur; a shorter text is one shingle. A text without words,
    or a null one, has the fingerprint zero. Other columns are not read.
    """
    rows = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], "text")
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), ", ".join(f"{k} long" for k in (*keys, "fp")))


# --- vantage-point tree ---------------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """Points at most ``radius`` from the vantage point are inside."""

    vantage: np.uint64
    radius: int
    inside: "Node | int"
    outside: "Node | int"


def split(points: np.ndarray, tries: int = 4) -> tuple[np.uint64, int] | None:
    """The most even split of points about one of a few vantage points among them, or None if none splits them."""
    best = None
    for i in np.linspace(0, len(points) - 1, tries).astype(int):
        d = distance(points, points[i])
        middle = int(np.median(d))
        for radius in (middle - 1, middle):
            inside = int((d <= radius).sum())
            if 0 < inside < len(points) and (best is None or abs(2 * inside - len(points)) < best[0]):
                best = abs(2 * inside - len(points)), points[i], radius
    return best and best[1:]


def upper_tree(points: np.ndarray, shards: int) -> tuple[Node | int, int]:
    """A tree with at most ``shards`` leaves, numbered from 0, and their number."""
    number = 0

    def grow(points: np.ndarray, leaves: int) -> Node | int:
        nonlocal number
        found = split(points) if leaves > 1 and len(points) > 1 else None
        if found is None:
            number += 1
            return number - 1
        inside = distance(points, found[0]) <= found[1]
        n = min(leaves - 1, max(1, round(leaves * inside.mean())))
        return Node(*found, grow(points[inside], n), grow(points[~inside], leaves - n))

    return grow(points, shards), number


def pass_on(vantage, radius: int, homes: np.ndarray, guests: np.ndarray, reach: int):
    """What goes inside and outside: the points that live there, and those that visit.

    By the triangle inequality two points within ``reach`` differ by at most that in their distance to the vantage point. A point inside
    and one outside need to meet only once, so the inner one goes to visit the outer.
    """
    d = distance(homes, vantage).astype(np.int16)
    e = distance(guests, vantage).astype(np.int16)
    inside = d <= radius
    return (homes[inside], guests[e - reach <= radius]), (homes[~inside], np.r_[guests[e + reach > radius], homes[inside & (d + reach > radius)]])


def _deal(batches: Iterator[pa.RecordBatch], tree: Node | int, reach: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        todo = [(tree, points, points[:0])]
        while todo:
            node, homes, guests = todo.pop()
            if not len(homes) and not len(guests):
                continue
            if isinstance(node, Node):
                inner, outer = pass_on(node.vantage, node.radius, homes, guests, reach)
                todo += [(node.inside, *inner), (node.outside, *outer)]
            else:
                n = len(homes) + len(guests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, node, np.int32)), pa.array(np.r_[homes, guests].view(np.int64)), pa.array(np.arange(n) < len(homes))], names=["shard", "fp", "home"]
                )


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 with links a-b, the least node that each reaches."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for ends in (a, b):
            np.minimum.at(label, label[ends], least)
            np.minimum.at(label, ends, least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u-v as one link for each node but the least of each component."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    label = least_labels(len(nodes), at[: len(u)], at[len(u) :])
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def spanning_links(homes: np.ndarray, guests: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs within ``reach`` connect, of homes with each other and with guests."""
    us, vs = [homes[:0]], [homes[:0]]
    todo = [(homes, guests)]
    while todo:
        homes, guests = todo.pop()
        if not len(homes):
            continue
        found = split(homes) if len(homes) > LEAF else None
        if found:
            todo += pass_on(*found, homes, guests, reach)
            continue
        all_ = np.r_[homes, guests]
        for k in range(0, len(all_), CHUNK):
            some = all_[k : k + CHUNK]
            for j in range(0, len(homes), LEAF):  # one leaf, unless nothing splits these points
                near = homes[j : j + LEAF]
                i, h = np.nonzero(distance(some[:, None], near[None, :]) <= reach)
                real = some[i] != near[h]
                if real.any():
                    u, v = _spanning(some[i[real]], near[h[real]])
                    us.append(u)
                    vs.append(v)
    return _spanning(np.concatenate(us), np.concatenate(vs))


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _shard_links(table: pa.Table, reach: int) -> pa.Table:
    points = table.column("fp").to_numpy().view(np.uint64)
    home = table.column("home").to_numpy(zero_copy_only=False)
    u, v = spanning_links(np.sort(points[home]), np.sort(points[~home]), reach)
    return pa.Table.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=LINKS)


def _deal_out(nodes: DataFrame, reach: int, shard: int, sample: int) -> DataFrame:
    shards = max(1, math.ceil(nodes.count() / shard))
    some = [r.fp for r in nodes.orderBy(F.xxhash64("fp")).select("fp").limit(min(sample, 32 * shards)).collect()]
    tree, _ = upper_tree(np.sort(np.array(some, np.int64).view(np.uint64)), shards)
    return nodes.select("fp").mapInArrow(partial(_deal, tree=tree, reach=reach), "shard int, fp long, home boolean")


def _in_tasks(dealt: DataFrame, guests: int) -> DataFrame:
    """``dealt`` with task: a shard's visitors spread over as many tasks as they need, what lives there in each of them.

    So a task's rows are bounded by those that live in a shard and ``guests``, however many boundaries are near.
    """
    sizes = dealt.groupBy("shard").agg(F.sum(F.when(F.col("home"), 0).otherwise(1)).alias("visitors"))
    large = sizes.where(F.col("visitors") > guests).select("shard", F.ceil(F.col("visitors") / guests).cast("int").alias("tasks"))
    rows = dealt.join(large, "shard", "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("tasks") - 1)
    one = F.array(F.pmod(F.xxhash64("fp"), F.col("tasks")).cast("int"))
    return rows.select("shard", F.explode(F.when(F.col("home"), every).otherwise(one)).alias("task"), "fp", "home")


def _clusters(prints: DataFrame, max_distance: int, shard: int, sample: int, guests: int = GUESTS) -> DataFrame:
    """Columns fp, root (a fingerprint of the component) and component_id, one row for each fingerprint of ``prints`` (doc_id, fp)."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    dealt = _in_tasks(stored(_deal_out(nodes, max_distance, shard, sample), "dealt"), guests)
    links = dealt.groupBy("shard", "task").applyInArrow(lambda table: _shard_links(table, max_distance), "u long, v long")
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Columns doc_id, fingerprint (16 hexadecimal digits) and component_id, one row for each row of ``docs``.

    Fingerprints that differ in at most ``max_distance`` bits are linked, all such pairs; component_id is the least doc_id that a document reaches by
    links, itself included. Texts without words share the fingerprint zero and are linked like any other. Rows with a null doc_id
    link like others; component_id is null only where no document of the component has a number. Repeated rows get equal results.
    """
    prints = stored(fingerprints(docs, shingle=shingle), "fingerprints")
    known = _clusters(prints, max_distance, shard, sample).drop("root")
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """The documents, in all their columns, that come first in their component: by doc_id (null last), then by a hash of their text.

    Of rows equal in both one stays, any. Only what identifies a document is joined to the components; texts are shuffled once, by that identity.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    rows = docs.toDF(*names).withColumn("id", F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))).withColumn("tie", F.xxhash64(text))
    prints = stored(fingerprints(rows.select("id", "tie", F.col(text).alias("text")), ("id", "tie"), shingle), "fingerprints")
    known = _clusters(prints.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "fp"), max_distance, shard, sample)
    first = F.min(F.struct(F.col("id") == NULL_ID, "id", "tie")).alias("first")
    firsts = prints.join(known, "fp").groupBy("root").agg(first).select("first.id", "first.tie")
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "tie").orderBy(F.lit(0)))).where("n = 1")
    return one.join(firsts, ["id", "tie"], "left_semi").select(*names).toDF(*docs.columns)
