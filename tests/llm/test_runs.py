"""Periodic runs against a plain search of every period, and the query on the whole table."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
from footfall.llm import runs

from tests.llm import plain


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """For each period, the longest stretches that agree with themselves; those of a smaller period left out."""
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w, found = np.array([names[x] for x in words]), {}
    for q in range(1, len(w) // 4 + 1):
        same = np.r_[0, (w[:-q] == w[q:]).astype(int), 0]
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words: list, found: list) -> list:
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def words_with_runs(rng: random.Random) -> list[bytes]:
    n, letters = rng.randrange(120), rng.choice([1, 2, 3, 5, 40])
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        a, p = rng.randrange(n), rng.randrange(1, 9)
        for i in range(a, min(n, a + rng.randrange(3, 60))):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_and_no_others(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(runs, "PAIRS", 7)
    for _ in range(60):
        texts = [words_with_runs(rng) for _ in range(rng.randrange(1, 9))]
        assert [[tuple(r) for r in found.tolist()] for found in runs.find(texts)] == [plain_runs(w) for w in texts]


def test_grammar_extends_exactly():
    rng = np.random.default_rng(5)
    for letters, n in ((1, 300), (2, 500), (4, 500), (400, 500)):
        words = np.r_[-1, np.tile(rng.integers(0, letters, n // 3), 3), -2]
        grammar = runs.Grammar(words - words.min())
        i, j = (np.sort(rng.integers(1, len(words) - 1, (2, 300)), axis=0))
        i, j = i[i < j], j[i < j]
        ahead, behind = grammar.extend(i, j), grammar.extend(i, j, back=True)
        for a, b, f, g in zip(i.tolist(), j.tolist(), ahead.tolist(), behind.tolist()):
            forward = next(k for k in range(len(words)) if words[a + k] != words[b + k])
            backward = next(k for k in range(len(words)) if words[a - k - 1] != words[b - k - 1])
            assert (f, g) == (forward, backward)


def test_long_texts():
    for n, period in ((60_000, 1), (60_000, 2), (60_000, 15_000), (60_000, 9_999)):
        (found,) = runs.find([[b"%d" % (i % period) for i in range(n)]])
        assert found.tolist() == [[0, n, period]]


def test_hard_rows(frame):
    texts = [None, "", " \n", "a", "a " * 5, "a " * 6, "x a b a b a b a b y", "a b a b a b a", "c " * 7 + "d c " * 4]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(frame(texts)).collect()}
    assert [got[k][1] for k in range(8)] == [[], [], [], [], [], [(0, 6, 1)], [(1, 8, 2)], []]
    assert got[5][2] == "a" and got[6][2] == "x a b y" and got[0] == (0, [], "")
    assert got[8][1] == plain_runs(texts[8].split()) and got[8][2] == " ".join(plain_collapse(texts[8].split(), got[8][1]))


def planted(doc_id, text):
    words = plain.words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_against_plain(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in contract.queries()["op11_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        words = planted(d, text)
        found = plain_runs(words)
        start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        milli = 1000 * length // period if found else None
        expected = (d, len(found), start, length, period, milli, plain.sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), plain.sha(" ".join(plain_collapse(words, found))))
        assert tuple(got[d]) == expected
    assert sum(r.n_runs > 0 for r in got.values()) > len(got) // 20


def test_planted_periods_leave_rows_without_number(frame):
    rows = [(None, "a b  c"), (None, None), (3, ""), (3, None)]
    assert sorted(map(tuple, runs.with_planted_periods(frame(rows)).collect()), key=str) == sorted(rows, key=str)
