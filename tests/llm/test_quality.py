"""Quality measures and thresholds against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from footfall.llm import quality

from tests.llm import plain
from tests.llm.conftest import prose


def plain_measures(text):
    text = text or ""
    words = plain.words(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if plain.words(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_of_every_document(spark, sf_dir):
    rows = quality.measures(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id", "text")).collect()
    assert len(rows) == 1000
    for r in rows:
        assert tuple(r[c] for c in quality.BASE) == plain_measures(r.text)


def test_measures_of_hard_texts(frame):
    texts = [None, "", "a", "a b c d e", "a b c d e a b c d e", "a " * 9, "a a a a a b a a a a a", "#*$%&|<> é\U0001f600\x0b\n\né\n \n#", "x\ny\nx\nx\n \n \n", prose(30_000, 1) + " " + prose(200, 1), "\x85 "]
    for r in quality.measures(frame(texts), ("doc_id",)).collect():
        assert tuple(r[c] for c in quality.BASE) == plain_measures(texts[r.doc_id]), r.doc_id


def test_binomial_tail(spark):
    cases = [(n, k, p) for p in (0.01, 0.05, 0.3) for n in (0, 1, 3, 59, 100, 1000) for k in (0, 1, 3, 30, 200) if k <= n]
    for p in (0.01, 0.05, 0.3):
        df = spark.createDataFrame([(n, k) for n, k, q in cases if q == p], "n long, k long")
        for n, k, got in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), p)).collect():
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert got == 1 if k >= n * p else math.isclose(got, exact, rel_tol=1e-6)
    large = spark.range(1).select(quality.binomial_tail(F.lit(10**8), F.lit(4_990_000), 0.05)).first()[0]
    assert math.isclose(large, 0.5 * math.erfc(10_000 / math.sqrt(10**8 * 0.05 * 0.95) / math.sqrt(2)), rel_tol=0.02)


def corpus(spark, n, noise, seed=1):
    """Good and bad texts in two languages; of the good ones of language b a share ``noise`` looks bad."""
    rng = random.Random(seed)
    texts, labels = [], []
    for d in range(n):
        lang, good = "ab"[d % 2], rng.random() < 0.8
        shout = not good or (lang == "b" and rng.random() < noise)
        words = prose(30, d)
        texts.append((d, words.upper().replace(" ", "!! ") if shout else words, lang))
        labels.append((d, int(good)))
    return spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_false_rejections_stay_below_the_bound_in_each_stratum(spark):
    for noise, rejects in ((0.0, {"a", "b"}), (0.2, {"a"})):
        docs, labels = corpus(spark, 2000, noise)
        rows = quality.judge(docs, labels).join(labels, "doc_id").collect()
        good, bad = ([r for r in rows if r.quality == q and not r.base_failed] for q in (1, 0))
        for lang in "ab":
            lost = [not r.kept for r in good if r.lang == lang]
            assert sum(lost) <= 0.05 * len(lost)
            caught = [not r.kept for r in bad if r.lang == lang]
            assert (sum(caught) > 0.9 * len(caught)) == (lang in rejects)


def test_too_few_labels_reject_nothing(spark):
    docs, labels = corpus(spark, 60, 0.0)
    assert all(r.kept for r in quality.judge(docs, labels).collect())
    assert all(r.kept != r.base_failed for r in quality.judge(docs, labels.limit(0)).collect())


def test_hard_rows(spark):
    docs, labels = corpus(spark, 1000, 0.0)
    shout = prose(30, 1).upper().replace(" ", "!! ")
    more = spark.createDataFrame([(None, shout, "a"), (None, None, None), (5000, shout, None), (5000, shout, None), (5001, None, "a"), (5002, "", "a")], "doc_id long, text string, lang string")
    odd = labels.union(spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0), (9999, 0)], "doc_id long, quality int"))
    docs = docs.union(more)
    for name in ("stratum", "quality", "level", "n_words", "kept", "a b.c", "of"):
        docs = docs.withColumn(name, F.lit("x"))
    got = quality.judge(docs, odd)
    assert got.count() == 1006
    rows = [r for r in got.collect() if r.doc_id is None or r.doc_id >= 5000]
    assert sorted((r.doc_id is None, r.base_failed, r.kept) for r in rows) == sorted([(True, False, False), (True, True, False), (False, False, True), (False, False, True), (False, True, False), (False, True, False)])
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    from footfall.llm.queries import op12_quality_rules

    op12_quality_rules(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", ["lang", "source"])
def test_any_stratum(spark, sf_dir, name):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels, stratum=name)
    assert name in got.columns and got.count() == docs.count()
