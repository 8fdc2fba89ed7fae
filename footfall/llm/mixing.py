"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source queues its documents in a random but fixed order, pass after pass. A copy's virtual finish time is the source's running total of tokens,
this copy included, over the source's target; the mix takes whole copies in the order of finish time, over all sources, until the budget is
spent, and cuts the last one. While all sources have copies left, each is behind its share of virtual time by less than one copy.

Running totals go by two levels, so that no source and no stretch of time is one task's: totals of ranges are added up first, then
each range is summed on its own, beginning at its total. Ranges of time that begin beyond the budget are dropped before they are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.common import NULL_ID, stored

#: Ranges of a source's random order, as leading hexadecimal digits of a hash: 16^3 for each source.
DIGITS = 3

#: Ranges of virtual time until the targets are met at least, and copies in each about, where there are more.
TIMES, RANGE = 4096, 20_000


def tokens(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def shares(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Columns source, number (from 0), source_size, target and budget (the whole size) for each source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the whole size. A target stops at ``max_repeats`` times its source's
    size and the rest is shared again by weight, until none is above. A source is above at some point exactly if its limit over its
    weight is below the level at which the others are filled; so one pass in the order of limit over weight finds all of them.
    One row for each source, whatever the number of documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    ranked = totals.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", max_repeats * F.col("source_size"))
    level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("below", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("others", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.col("limit") * F.col("others") <= (F.col("total") - F.col("below")) * F.col("weight"))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(everything), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    )
    rest = ((F.col("total") - F.col("spent")).cast("double") * F.col("weight").cast("double")) / F.col("open").cast("double")
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(rest)
    return filled.select("source", "number", "source_size", target.alias("target"), F.col("total").alias("budget"))


#: What identifies a row of the documents.
ROW = ("id", "tie", "twin")


def identity(doc_id: str, text: str) -> list[Column]:
    """Columns id (doc_id without nulls) and tie (a hash of the text)."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tie")]


def _twin(source: str) -> Column:
    """Numbers rows that are equal in id and tie, in the order of their source."""
    return F.row_number().over(Window.partitionBy("id", "tie").orderBy(F.col(source).cast("string").asc_nulls_last()))


def _offsets(df: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Columns ``keys``, ``part`` and offset: the sum of ``value`` in the parts before, within ``keys``."""
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("own"))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, part, F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("offset"))


def _running(df: DataFrame, offsets: DataFrame, keys: list[str], part: str, order: list[Column], value: str) -> DataFrame:
    """Column ``total``: the sum of ``value`` up to and including each row, within ``keys``, in the order of ``part`` and then ``order``.

    Rows of parts that ``offsets`` lack are dropped. ``keys`` and ``part`` have no nulls.
    """
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, [*keys, part]).withColumn("within", F.sum(value).over(within))
    return joined.withColumn("total", F.col("within") + F.col("offset")).drop("within", "offset")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """Columns doc_id, source, size, source_size, target, taken (words that the mix takes of the document, repeats counted) and begins (how many words
    the mix has before its first copy, null if it is not taken), one row for each row of ``docs``; and id, tie, twin, which identify the row.

    Size is the number of words (null: none). Targets share the total size by weight, see :func:`shares`. A source's copies queue pass
    after pass, at most ``max_repeats``, each in the order of a hash of doc_id. Whole copies are taken by finish time, ties by source, then place in the queue,
    until their sizes reach the total size; the last one is cut there. So a source differs from its target by about one copy: by less below, and above by its share of
    what others lack. Rows without
    words are never taken. Null sources are one source, the last; a null doc_id queues like the others; repeated rows queue
    one behind the other. An empty table gives an empty result. Other columns are not read. Sources are ranked in one task, one row each; documents never are.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens("text").alias("size")]
    sized = stored(docs.select(*columns, *identity("doc_id", "text")), "sizes")
    facts = shares(sized, weights, max_repeats).withColumnRenamed("source", "of")
    rows = sized.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = stored(rows.withColumn("twin", _twin("source")), "queue")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    queue = rows.where("size > 0").select(*ROW, "number", "size", "source_size", "target", "budget", place.alias("place"), F.substring(place, 1, DIGITS).alias("part"))
    queue = _running(queue, _offsets(queue, ["number"], "part", "size"), ["number"], "part", [F.col(c) for c in ("place", *ROW)], "size")
    copies = queue.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    copies = copies.withColumn("start", F.col("round") * F.col("source_size") + F.col("total") - F.col("size"))
    finish = (F.col("start") + F.col("size")) / F.col("target")
    times = max(TIMES, rows.count() * max_repeats // RANGE)
    copies = stored(copies.select(*ROW, "number", "budget", "start", "size", finish.alias("finish"), F.floor(finish * times).cast("long").alias("time")), "copies")
    budget = copies.agg(F.max("budget")).first()[0] or 0
    offsets = _offsets(copies, [], "time", "size").where(F.col("offset") < budget)
    mixed = _running(copies, offsets, [], "time", [F.col("finish"), F.col("number"), F.col("start")], "size")
    begins = F.col("total") - F.col("size")
    mixed = mixed.select(*ROW, begins.alias("begins"), F.least(F.col("size"), budget - begins).alias("words")).where("words > 0")
    taken = mixed.groupBy(*ROW).agg(F.sum("words").alias("taken"), F.min("begins").alias("begins"))
    out = rows.join(taken, list(ROW), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "begins", *ROW)


MIXED = ("size", "target", "taken", "begins")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The documents that :func:`mix` takes, in all their columns, with the columns size, target, taken and begins at the end.

    Columns of ``docs`` with one of these names, in upper or lower case, are replaced.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    kept = [c for c in docs.columns if c.lower() not in MIXED]
    rows = docs.toDF(*names)
    rows = rows.select(*names, *identity(at["doc_id"], at["text"])).withColumn("twin", _twin(at["source"]))
    facts = mix(docs, weights, max_repeats, seed).where("taken > 0").select(*ROW, *MIXED)
    return rows.join(facts, list(ROW)).select(*[at[c] for c in kept], *MIXED).toDF(*kept, *MIXED)
