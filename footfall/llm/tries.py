"""Prefix tree of conversations, packed in double-array tries.

A conversation is a sequence of turns, each told by a digest of its role and text. Equal sequences are counted first. Then every sequence goes to the
shard of its frontier: the shortest of its prefixes of 1, 2, 4, ... turns that few sequences share. So the tree below a frontier lies in one shard, and a
beginning that a third of all conversations share is cut further down. A shard numbers its turns densely, packs its sequences into BASE and
CHECK arrays, and walks them for the nodes and their aggregates. Nodes above the frontiers may lie in several shards: their parts are merged by the
digest of their prefix, and what lies above the frontiers is added up globally.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import stored

#: Distinct sequences below a frontier, at most.
FAMILY = 20_000

#: Turns of a shard, about.
SHARD = 400_000

#: Conversation numbers written together before the digest of all that end in a node: a power of two.
CHUNK_BITS = 12

SEQUENCE = "array<struct<id:string,size:long>>"


# --- sequences ------------------------------------------------------------------------------------


def sequences(conversations: DataFrame) -> DataFrame:
    """Columns conv_id and turns (array of id, a digest of role and text, and size, the code points of the text), one row for each conversation.

    Turns go by their number, null first, and turns of equal number by their digest; repeated rows are repeated turns. A null role or text is empty. Rows without a
    conv_id belong to no conversation. Only digests are shuffled; the turns of one conversation meet in one row, 60 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("number"), F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("id"), F.length(text).cast("long").alias("size"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def with_shared_starts(rows: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of conversation c - c % ``group`` (all it has if fewer, none if it is absent), h the CRC-32 of the decimal conv_id c modulo ``most``.

    A conversation of h turns or fewer keeps none of its own. Columns as in :func:`sequences`.
    """
    starts = rows.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, most - 1).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = rows.withColumn("h", h).withColumn("of", F.col("conv_id") - F.col("conv_id") % group)
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.array().cast(SEQUENCE))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(starts, "of", "left").select("conv_id", F.concat(start, rest).alias("turns"))


def _digest(turns: Column | str) -> Column:
    return F.md5(F.array_join(F.transform(turns, lambda t: t["id"]), ""))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key from rows (key, turns, n, least, written) in the order of key and number: turns, n, least, and the digest of all that is written.

    The numbers of a key stream through one digest; nothing else is kept of them.
    """
    key, held, state = None, None, None

    def closed() -> pa.RecordBatch:
        turns, n, least = held
        return pa.RecordBatch.from_arrays([turns, pa.array([n], pa.int64()), pa.array([least], pa.int64()), pa.array([state.hexdigest()])], names=["turns", "n", "least", "ends"])

    for batch in batches:
        keys, ns, leasts, written = (batch.column(c).to_pylist() for c in ("key", "n", "least", "written"))
        first, rows = [], []
        for i, (k, n, least, text) in enumerate(zip(keys, ns, leasts, written)):
            if k != key:
                if rows:
                    rows[-1][-1] = state.hexdigest()
                elif held is not None:
                    yield closed()
                    held = None
                key, state = k, hashlib.sha256(text.encode())
                first.append(i)
                rows.append([n, least, None])
            else:
                state.update(b"," + text.encode())
                if rows:
                    rows[-1][0] += n
                else:
                    held[1] += n
        if rows:
            # The last key may go on in the next batch.
            turns = batch.column("turns")
            done = len(rows) - 1
            if done:
                columns = [pa.array([r[c] for r in rows[:done]], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
                yield pa.RecordBatch.from_arrays([turns.take(pa.array(first[:done])), *columns], names=["turns", "n", "least", "ends"])
            held = [turns.take(pa.array(first[done:])), rows[done][0], rows[done][1]]
    if held is not None:
        yield closed()


def _distinct(rows: DataFrame) -> DataFrame:
    """Each distinct sequence of ``rows``: turns, n (conversations), least (conv_id) and ends, the SHA-256 of their numbers, ascending, comma-joined.

    Numbers are written in chunks of 4096 before they meet, so the task with a sequence that many conversations share reads one row for each chunk.
    """
    chunks = rows.withColumn("key", _digest("turns")).withColumn("chunk", F.shiftright("conv_id", CHUNK_BITS)).groupBy("key", "chunk")
    chunks = chunks.agg(F.any_value("turns").alias("turns"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    chunks = chunks.select("key", "chunk", "turns", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("least"), written.alias("written"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_ends, f"turns {SEQUENCE}, n long, least long, ends string")


# --- frontiers ------------------------------------------------------------------------------------


def _frontiers(distinct: DataFrame, family: int) -> DataFrame:
    """``distinct`` with frontier (a number of turns; one more than the sequence has if all its prefixes are shared by many) and of (a digest of that prefix)."""
    done, pending, depth = [], distinct, 1
    while True:
        prefix = F.when(F.size("turns") >= depth, _digest(F.slice("turns", 1, depth)))
        rows = pending.withColumn("of", prefix)
        hot = stored(rows.where("of is not null").groupBy("of").agg(F.count("*").alias("shared")).where(F.col("shared") > family), "hot")
        # A sequence without such a prefix lies above the frontiers as a whole; any shard will do.
        least = F.when(F.col("of").isNotNull(), F.lit(depth)).otherwise(F.size("turns") + 1)
        settled = lambda df: df.withColumn("frontier", least.cast("int")).withColumn("of", F.coalesce("of", _digest("turns")))
        if hot.isEmpty():
            done.append(settled(rows))
            break
        done.append(settled(rows.join(hot, "of", "left_anti")))
        pending, depth = stored(rows.join(hot, "of", "left_semi").drop("of"), "pending"), 2 * depth
    columns = ["turns", "n", "least", "ends", "frontier", "of"]
    out = done[0].select(*columns)
    for more in done[1:]:
        out = out.unionAll(more.select(*columns))
    return out


# --- double-array trie ----------------------------------------------------------------------------


class DoubleArray:
    """A trie whose node s has its child by symbol c at place base[s] + c, which is s's if check[base[s] + c] is s. Node 0 is the root."""

    def __init__(self, room: int):
        self.base = np.zeros(max(room, 16), np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no place before this one is free
        self.end = 1  # all places from this one on are free

    def _reach(self, place: int) -> None:
        if place >= len(self.base):
            more = max(place + 1, 2 * len(self.base)) - len(self.base)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _singles(self, n: int) -> np.ndarray:
        """n free places."""
        self._reach(self.end + n)
        found = self.free + np.flatnonzero(self.check[self.free : self.end + n] < 0)[:n]
        if n:
            self.free = int(found[-1]) + 1
            self.end = max(self.end, self.free)
        return found

    def _fit(self, symbols: np.ndarray, tries: int = 32) -> int:
        """A base at which the places of all symbols (ascending) are free."""
        span = symbols - symbols[0]
        self._reach(self.end + int(span[-1]))
        for place in (self.free + np.flatnonzero(self.check[self.free : self.end] < 0)[:tries]).tolist():
            if place + span[-1] < len(self.check) and (self.check[place + span] < 0).all():
                return place - int(symbols[0])
        return self.end - int(symbols[0])

    def add(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Places of new nodes, for edges sorted by parent and symbol. All children of a parent are added at once."""
        places = np.empty(len(parents), np.int64)
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(first, append=len(parents))
        for a, k in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            some = symbols[a : a + k]
            base = self._fit(some)
            self.base[parents[a]] = base
            places[a : a + k] = base + some
            self.check[base + some] = parents[a]
            self.end = max(self.end, base + int(some[-1]) + 1)
        only = first[count == 1]
        places[only] = self._singles(len(only))
        self.base[parents[only]] = places[only] - symbols[only]
        self.check[places[only]] = parents[only]
        return places

    def walk(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child of each node by a symbol, -1 if it has none."""
        places = self.base[nodes] + symbols
        inside = (places > 0) & (places < len(self.check))
        places = np.where(inside, places, 0)
        return np.where(inside & (self.check[places] == nodes), places, -1)


class Sequences:
    """Sequences of turns, as one array of numbers, longest first."""

    def __init__(self, turns: pa.ListArray):
        flat = turns.flatten()
        encoded = flat.field("id").dictionary_encode()
        self.names, self.codes, self.sizes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64), flat.field("size").to_numpy()
        self.lengths = np.diff(turns.offsets.to_numpy())
        self.order = np.argsort(-self.lengths, kind="stable")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def depth(self) -> int:
        return int(self.lengths.max(initial=0))

    def at(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The sequences with a turn at that depth (from 1), and where it stands."""
        some = self.order[: np.searchsorted(-self.lengths[self.order], -depth, side="right")]
        return some, self.starts[some] + depth - 1


def pack(rows: Sequences) -> tuple[DoubleArray, np.ndarray]:
    """A double array of all sequences, and the dense number of each turn.

    Turns are numbered as the tree meets them, so that the children of a node have near numbers and take little room.
    """
    trie, dense, used = DoubleArray(len(rows.codes)), np.full(len(rows.names), -1, np.int64), 0
    nodes = np.zeros(len(rows.lengths), np.int64)
    for depth in range(1, rows.depth() + 1):
        some, at = rows.at(depth)
        edges, where = np.unique(nodes[some] * len(dense) + rows.codes[at], return_inverse=True)
        parents, codes = edges // len(dense), edges % len(dense)
        fresh, first = np.unique(codes, return_index=True)
        fresh = fresh[np.argsort(first)]
        fresh = fresh[dense[fresh] < 0]
        dense[fresh] = used + np.arange(len(fresh))
        used += len(fresh)
        symbols = dense[codes]
        order = np.lexsort((symbols, parents))
        places = np.empty(len(order), np.int64)
        places[order] = trie.add(parents[order], symbols[order])
        nodes[some] = places[where]
    return trie, dense


NODES = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.string()), ("size", pa.int64()), ("upper", pa.bool_()), ("path", pa.list_(pa.string())),
])
NODES_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, size long, upper boolean, path array<string>"


def _shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of a shard's sequences. Those above the frontiers are parts: their sums are over what lies below the frontiers, and ``path`` tells them from others.

    For a node at a frontier ``path`` is that of its parent, which is not known here.
    """
    turns = table.column("turns").combine_chunks()
    turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
    rows = Sequences(turns)
    n, least, frontier = (table.column(c).to_numpy() for c in ("n", "least", "frontier"))
    trie, dense = pack(rows)
    room = len(trie.check)
    counts, smallest, sizes, upper = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max), np.zeros(room, np.int64), np.zeros(room, bool)
    code = np.full(room, -1, np.int64)
    np.add.at(counts, 0, n.sum())
    smallest[0], upper[0] = least.min(), True
    nodes, levels = np.zeros(len(n), np.int64), [np.zeros(1, np.int64)]
    for depth in range(1, rows.depth() + 1):
        some, at = rows.at(depth)
        nodes[some] = here = trie.walk(nodes[some], dense[rows.codes[at]])
        np.add.at(counts, here, n[some])
        np.minimum.at(smallest, here, least[some])
        sizes[here], code[here] = rows.sizes[at], rows.codes[at]
        upper[here] = frontier[some] > depth
        levels.append(np.unique(here))
    parent = trie.check
    children, leaves, saved = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
    for level in reversed(levels):
        # Deeper levels have been added to this one.
        inner = level[~upper[level]]
        leaves[inner] += children[inner] == 0
        saved[inner] += (counts[inner] - 1) * sizes[inner]
        if level[0] != 0:
            np.add.at(leaves, parent[level], leaves[level])
            np.add.at(saved, parent[level], saved[level])
            np.add.at(children, parent[inner], 1)
    ends = np.full(room, None, object)
    ends[nodes] = table.column("ends").to_pylist()
    paths: dict[int, list[str]] = {}
    for level in levels:
        for node in level[upper[level]].tolist():
            above = paths[int(parent[node])] if node else []
            name = (above[-1] + rows.names[int(code[node])].as_py()) if node else ""
            paths[node] = [*above, hashlib.md5(name.encode()).hexdigest()]
    every = np.concatenate(levels)
    depths = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    border = ~upper[every] & upper[parent[every]]
    known = ~upper[every] & ~border
    path = [paths[node] if is_upper else paths[int(parent[node])] if at_border else None for node, is_upper, at_border in zip(every.tolist(), upper[every].tolist(), border.tolist())]
    columns = [
        pa.array(smallest[every]), pa.array(depths), pa.array(smallest[parent[every]], mask=~known), pa.array(counts[every]), pa.array(children[every]), pa.array(leaves[every]),
        pa.array(saved[every]), pa.array(ends[every].tolist(), pa.string()), pa.array(sizes[every]), pa.array(upper[every]), pa.array(path, pa.list_(pa.string())),
    ]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, NODES)], schema=NODES)


# --- tree -----------------------------------------------------------------------------------------


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes above the frontiers, merged: the columns of the result, and key."""
    total = lambda c: F.sum(c).alias(c)
    merged = parts.withColumn("key", F.element_at("path", -1)).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"),
        F.max("ends").alias("ends"), F.max("size").alias("size"), F.any_value("path").alias("path"),
    )
    merged = stored(merged.withColumn("parent_key", F.when(F.size("path") > 1, F.element_at("path", -2))), "upper")
    below = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("inner"))
    own = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))).drop("inner")
    own = stored(own, "own")
    sums = own.select(F.explode("path").alias("key"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    sums = sums.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    above = own.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = own.join(sums, "key").join(above, "parent_key", "left")
    return out.withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("saved"))


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def prefix_tree(rows: DataFrame, family: int = FAMILY, shard: int = SHARD) -> DataFrame:
    """One row for each node of the prefix tree of ``rows``, sequences as from :func:`sequences` with a conv_id each.

    A node is a distinct sequence of the first turns of a conversation; the root has none. Columns: conv_id, the least member (a conversation that begins with the node); depth, its turns;
    parent_conv_id, the parent's conv_id, null for the root; n_convs, members; n_children; n_leaves, nodes without children in its subtree, itself included;
    saved_tokens, over its subtree the code points of each node's last text times one less than its members; ends_sha256, of the numbers of the
    conversations that end there, ascending, comma-joined (none: of the empty text). conv_id and depth identify a node. No conversations give no nodes.
    """
    distinct = stored(_distinct(rows), "sequences")
    total = distinct.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / shard))
    dealt = _frontiers(distinct, family).withColumn("shard", F.pmod(F.xxhash64("of"), F.lit(shards)))
    nodes = stored(dealt.groupBy("shard").applyInArrow(_shard_nodes, NODES_SQL), "nodes")
    upper = _merged(nodes.where("upper"))
    upper = stored(upper.select(*RESULT, "ends", "key"), "merged")
    border = nodes.where("not upper and path is not null").drop("parent_conv_id").withColumn("key", F.element_at("path", -1))
    border = border.join(upper.select("key", F.col("conv_id").alias("parent_conv_id")), "key")
    columns = [*RESULT, "ends"]
    out = nodes.where("not upper and path is null").select(*columns).unionAll(border.select(*columns)).unionAll(upper.select(*columns))
    return out.select(*RESULT, F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
