"""Nulls, empty and very long texts, ties, repeated rows, empty tables and strange columns, for each operator and stage."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from footfall.llm import decontaminate, html_text, imatch, lines, mixing, quality, runs, secrets, simhash, substrings, tokens, toxicity

from footfall.llm.common import stored

from tests.llm import plain
from tests.llm.conftest import prose

LONG = prose(30_000, 5)
SHARED = prose(40, 1)
TEXTS = [
    (0, None), (1, ""), (2, " \t\n \x0b"), (3, "one"), (4, "one two"), (5, SHARED), (6, SHARED + "\n" + prose(30, 2)), (7, prose(25, 3) + "\n" + SHARED),
    (8, SHARED.upper()), (9, "Ünïcödé 日本語 \U0001f600 " + prose(60, 4)), (10, LONG), (11, LONG + " tail"), (12, "a b " * 200), (13, "é" * 5000), (14, "\n\n\n"), (15, "x\r\n\x0cX\n x "),
]
REPEATED = [*TEXTS, TEXTS[6], TEXTS[6], TEXTS[0], (None, SHARED), (None, None)]


def vocabulary():
    return tokens.Vocabulary.ranked(["▁w", "1", "2", "▁one", "on", "e", "o", "n", "▁", "12", "x"])


OPERATORS = {
    "tokens": lambda d: tokens.count_tokens(d, vocabulary()),
    "substrings": lambda d: substrings.dedup_substrings(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "keep_one": lambda d: simhash.keep_one(d),
    "decontaminate": lambda d: decontaminate.find_matches(d, d.sparkSession.createDataFrame([(1, SHARED), (None, "short"), (3, None), (4, "")], "item_id long, text string")),
    "imatch": lambda d: imatch.compare_with_edits(d),
    "secrets": lambda d: secrets.scan_secrets(d),
    "html": lambda d: html_text.extract_pages(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))),
    "mixing": lambda d: mixing.mix(d),
    "toxicity": lambda d: toxicity.score_documents(d, d.sparkSession.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")),
    "runs": lambda d: runs.find_runs(d),
    "quality": lambda d: quality.judge(d, d.sparkSession.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")),
    "lines": lambda d: lines.dedup_lines(d, min_docs=2),
}
#: Those that return one row for each row of their input.
WHOLE = sorted(set(OPERATORS) - {"keep_one", "decontaminate"})


def result(df):
    return Counter(str(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(frame, name):
    assert OPERATORS[name](frame([])).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_change_nothing(frame, name):
    usual = OPERATORS[name](frame(REPEATED))
    odd = OPERATORS[name](frame(REPEATED, odd=True).repartition(3))
    if name in ("lines", "keep_one"):
        assert set(usual.columns) <= set(odd.columns) and odd.where("`a b.c` = source and c0 = source").count() == odd.count()
        odd = odd.select([f"`{c}`" for c in usual.columns])
    assert result(usual) == result(odd)


@pytest.mark.parametrize("name", WHOLE)
def test_one_row_for_each_row(frame, name):
    assert OPERATORS[name](frame(REPEATED)).count() == len(REPEATED)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_all_texts_missing(frame, name):
    got = OPERATORS[name](frame([None, None, ""]))
    assert got.count() == {"keep_one": 1, "decontaminate": 0}.get(name, 3)


def test_substrings_against_plain(frame):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(frame(TEXTS)).collect()}
    assert got == plain.substrings(TEXTS, 20)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substrings.dedup_substrings(frame(TEXTS)).collect()}
    assert spans[6] == [(0, 40)] and spans[7] == [(25, 65)] and spans[12] == [(2, 400)]


def test_substrings_by_many_buckets_and_widths(frame):
    for width in (1, 3):
        docs = frame([(i, " ".join(f"v{(i * k) % 7}" for k in range(30))) for i in range(40)])
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(docs.repartition(5), width, bucket_windows=10).collect()}
        assert got == plain.substrings([tuple(r) for r in docs.select("doc_id", "text").collect()], width)


def test_equal_rows_are_no_repeats_of_each_other(frame):
    got = substrings.dedup_substrings(frame([(1, SHARED), (1, SHARED)])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_simhash_against_plain(frame):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(frame(TEXTS)).collect()}
    prints = {d: plain.fingerprint(t) for d, t in TEXTS}
    least = plain.components(prints, 2)
    assert got == {d: (prints[d], least[d]) for d in prints}
    assert {got[d][1] for d in (0, 1, 2, 14)} == {0}


def test_keep_one_without_numbers(frame):
    got = simhash.keep_one(frame([(None, SHARED), (None, SHARED), (4, SHARED), (None, "quite another text"), (4, SHARED)])).collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, SHARED), (True, "quite another text")]


def test_tokens_against_all_segmentations(frame):
    v = vocabulary()

    def best(word):
        found = []

        def go(at, score, n):
            if at == len(word):
                found.append((score, -n))
            for end in range(at + 1, len(word) + 1):
                if word[at:end] in v.scores:
                    go(end, score + v.scores[word[at:end]], n + 1)
            if word[at : at + 1] and word[at] not in v.scores:
                size = len(word[at].encode())
                go(at + 1, score + size * v.byte, n + size)

        go(0, 0, 0)
        return -max(found)[1]

    words = ["▁one", "▁on", "▁onone", "▁w1212", "▁w12é2", "▁", "▁日n", "▁xx", "▁one1"]
    assert tokens.count_pieces(words, v) == {w: best(w) for w in words}
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(frame(TEXTS[:9]), v).collect()}
    memo = tokens.count_pieces({"▁" + w for _, t in TEXTS[:9] for w in plain.words(t)}, v)
    assert got == {d: sum(memo["▁" + w] for w in plain.words(t)) for d, t in TEXTS[:9]}


def test_line_keys_and_limits(frame):
    docs = [(1, "A\n b \nc"), (2, "a\x0b\nB\n\nd"), (3, "a\nb"), (3, "a\nz"), (None, "a"), (5, None)]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(frame(docs), min_docs=3).collect())
    assert got == Counter([(1, "c", 3, 2), (2, "\nd", 4, 2), (3, "", 2, 2), (3, "z", 2, 1), (None, "", 1, 1), (5, "", 1, 0)])
    kept = {r.text for r in lines.dedup_lines(frame([(i, "é\nab") for i in range(4)]), min_docs=3, min_chars=2).collect()}
    assert kept == {"é"}


def test_line_counts_are_reversible(spark, frame):
    first, second = frame([(i, f"a\nb{i % 3}\nc{i}") for i in range(12)]), frame([(20 + i, f"a\nb{i}\nd") for i in range(6)])
    exact = lambda c: {bytes(r.key): r.n_docs for r in lines.references(c).collect()}
    texts = lambda c, d: {r.doc_id: r.text for r in lines.clean(c, d).collect()}
    one = lines.insert(lines.empty(spark, 3, min_docs=5), first)
    both = lines.insert(one, second)
    back = lines.delete(both, second)
    assert exact(one) == exact(back) and exact(both) != exact(one)
    assert texts(one, first) == texts(back, first) == {d: x[2] for d, x in plain.lines([(r.doc_id, r.text) for r in first.collect()], 5).items()}
    everything = [(r.doc_id, r.text) for r in first.union(second).collect()]
    assert texts(both, first.union(second)) == {d: x[2] for d, x in plain.lines(everything, 5).items()}
    assert exact(lines.delete(one, first)) == {}


def test_filters_asked_in_many_groups(frame, monkeypatch):
    monkeypatch.setattr(lines, "ASKED", 5)
    docs = [(i, f"a\nb{i % 5}\nc{i}") for i in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(docs), min_docs=8, shard_keys=7).collect()}
    assert got == {d: x[2] for d, x in plain.lines(docs, 8).items()}


def test_exact_counts_decide_what_the_filter_lets_through(frame, monkeypatch):
    monkeypatch.setattr(lines.CuckooFilter, "contains", lambda self, keys: [True] * len(keys))
    docs = [(i, f"a\nb{i % 5}\nc{i}") for i in range(40)]
    rows = lines._ask(
        pa.table({"doc": pa.array([1, 2]), "key": pa.array([b"k" * 16, b"l" * 16], pa.binary())}),
        pa.table({"keys": pa.array([b"k" * 16 + b"l" * 16], pa.binary()), "counts": pa.array([np.array([9, 2]).tobytes()], pa.binary()), "filter": pa.array([lines.CuckooFilter().to_bytes()], pa.binary())}),
        min_docs=3,
    )
    assert rows.column("doc").to_pylist() == [1] and docs


def test_mixture_against_plain(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, prose(1 + i % 13 * 9, i)) for i in range(150)] + [(200, "s0", LONG), (201, "tiny", "one"), (202, "none", ""), (203, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()}
    expected = plain.mixture([(d, s, t) for d, s, t in rows])
    assert got.keys() == expected.keys()
    for d, (size, total, target, taken) in expected.items():
        assert got[d][:2] == (size, total) and abs(got[d][2] - target) < 1e-6 and got[d][3] == taken and taken <= 3 * size
    again = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == got


def test_mixture_is_one_order(spark):
    """Whole copies follow each other without gaps; only the last one is cut."""
    rows = [(i, f"s{i % 3}", prose(5 + i % 7, i)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    taken = [r for r in got if r.taken]
    starts = sorted(r.begins for r in taken)
    assert sum(r.taken for r in taken) == total and starts[0] == 0 and len(set(starts)) == len(starts) and starts[-1] < total
    assert sum(r.taken % r.size > 0 for r in taken) <= 1 and all(r.taken <= 3 * r.size for r in taken)
    by_source = {s: sum(r.taken for r in got if r.source == s) for s in ("s0", "s1", "s2")}
    target = {r.source: r.target for r in got}
    assert all(abs(by_source[s] - target[s]) <= 2 * 11 for s in by_source)


def test_mixed_rows_that_repeat(frame):
    docs = frame([(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "f"), (None, "f")])
    got = mixing.mixed_documents(docs).collect()
    assert sum(r.taken for r in got) == sum(len(r.text.split()) for r in docs.collect())
    assert len(got) == 5


STAGES = dict(pipeline.STAGES)
CLASHES = ("n_lines", "N_Dropped", "size", "Target", "taken", "begins", "_toxicity", "toxicity", "gone", "tick`ed", "a.b", "doc", "c1")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, SHARED), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_with_hard_rows(spark, frame, folder, name):
    for odd in (False, True):
        docs = frame(REPEATED, odd=odd)
        got = STAGES[name](spark, docs, folder)
        added = mixing.MIXED if name == "mixing" else ()
        assert got.columns == [*(c for c in docs.columns if c not in added), *added]
        kept = {r.doc_id for r in got.collect()}
        assert 9 in kept and kept <= {d for d, _ in REPEATED}
        if name == "decontamination":
            assert not kept & {5, 6, 7, 8} and {0, 1, 2, 3, 10, 11} <= kept
        if name in ("line_dedup", "toxicity"):
            assert got.count() == len(REPEATED)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_keeps_columns_of_any_name(frame, folder, spark, name):
    """Stored and read again, as the pipeline does; only mixing replaces the columns that it adds."""
    docs = frame(REPEATED)
    docs = docs.toDF(*docs.columns)
    for c in CLASHES:
        docs = docs.withColumn(c, docs.source)
    got = stored(STAGES[name](spark, docs, folder), "odd")
    added = mixing.MIXED if name == "mixing" else ()
    kept = [c for c in docs.columns if c.lower() not in added]
    assert got.columns == [*kept, *added]
    rows = got.collect()
    assert rows and all(r[k] == "s" for r in rows for k, c in enumerate(kept) if c in CLASHES)


def test_added_columns_replace_those_of_the_same_name(frame):
    docs = frame(["a\nb", "a\nc"]).withColumn("N_LINES", F.lit("x")).withColumn("n_dropped", F.lit("y"))
    got = lines.dedup_lines(docs, min_docs=2)
    assert got.columns == [*frame(["a"]).columns, "n_lines", "n_dropped"] and {(r.n_lines, r.n_dropped) for r in got.collect()} == {(2, 1)}


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_without_rows(spark, frame, folder, name):
    assert STAGES[name](spark, frame([]), folder).collect() == []
