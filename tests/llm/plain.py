"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import xxhash

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substrings(docs: list[tuple], width: int) -> dict:
    """doc_id -> n_words, n_removed, kept words."""
    first, out = {}, {}
    for doc, text in sorted(docs):
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), (doc, i)) != (doc, i):
                gone |= set(range(i, i + width))
        out[doc] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    w = words((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links: list[tuple], nodes) -> dict:
    """node -> least node it reaches."""
    least = {n: n for n in nodes}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def components(prints: dict, reach: int) -> dict:
    links = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= reach]
    return groups(links, prints)


def line_key(line: str) -> str:
    return line.strip(SPACES).translate(LOWER)


def lines(docs: list[tuple], least: int) -> dict:
    """doc_id -> n_lines, n_dropped, kept text."""
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add(doc)
    out = {}
    for doc, text in docs:
        every = (text or "").split("\n")
        kept = [x for x in every if not line_key(x) or len(holders[line_key(x)]) < least]
        out[doc] = len(every), len(every) - len(kept), "\n".join(kept)
    return out


def edits_within(piece: str, text: str) -> int:
    """Least edits that turn ``piece`` into some stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(piece, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def mixture(docs: list[tuple], weights=(1, 2, 3), most: int = 3, seed: str = "mix") -> dict:
    """doc_id -> size, source_size, target, taken, for (doc_id, source, text) rows with different doc_ids."""
    size = {d: len(words(t)) for d, _, t in docs}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s))
    total_of = {s: sum(size[d] for d, x, _ in docs if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, capped = sum(total_of.values()), {}
    while True:
        rest = [s for s in sources if s not in capped]
        if not rest:
            break
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= most * total_of[s]]
        if not over:
            break
        capped |= {s: most * total_of[s] for s in over}
    target = {s: float(capped.get(s, 0) or (share[s] if s not in capped else 0)) for s in sources}
    copies = []
    for number, s in enumerate(sources):
        queue = sorted(((hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest(), d) for d, x, _ in docs if x == s), key=lambda q: q[0])
        start = 0
        for _ in range(most):
            for _, d in queue:
                if size[d]:
                    copies.append(((start + size[d]) / target[s], number, start, d))
                    start += size[d]
    taken, left = defaultdict(int), total
    for *_, d in sorted(copies, key=lambda c: c[:3]):
        n = min(size[d], left)
        taken[d] += n
        left -= n
    return {d: (size[d], total_of[s], target[s], taken[d]) for d, s, _ in docs}
