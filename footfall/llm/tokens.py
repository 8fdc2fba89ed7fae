"""Token counts: the best unigram segmentation of each pre-token, by dynamic programming shared along a trie.

The distinct new pre-tokens of a block of documents are walked in sorted order, which is the depth-first order of their trie; the trie itself is not kept. The forward score of a
prefix, the best sum of piece scores that spells it, is computed once and held while the words that share it are walked; the end of a word gives its number of pieces. A document's count is the sum over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import blocks, raw

#: Vocabulary of a public tokenizer; its pieces in order of rank.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Stands for the space before a word, as in the vocabulary.
SPACE = "▁"

#: Words whose counts a task remembers.
KNOWN_WORDS = 400_000

#: Scores are whole millionths of natural logarithms, so that sums are exact.
UNIT = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Scores of the pieces, and what a byte costs of a character that no piece has. ``tails`` are the ends of pieces, for stopping early."""

    scores: dict[str, int]
    byte: int
    tails: frozenset[str]

    @classmethod
    def ranked(cls, pieces: Iterable[str], shift: float = 2.7) -> "Vocabulary":
        """Pieces by falling rank, with Zipf-Mandelbrot probabilities 1 / (rank + shift), normalised; a byte costs ten more than the rarest."""
        pieces = list(dict.fromkeys(p for p in pieces if p))
        total = math.log(sum(1 / (r + shift) for r in range(1, len(pieces) + 1)) or 1)
        scores = {p: -round(UNIT * (math.log(r + shift) + total)) for r, p in enumerate(pieces, 1)}
        return cls(scores, min(scores.values(), default=0) - 10 * UNIT, frozenset(p[i:] for p in pieces for i in range(len(p))))


def load(path: str = MODEL) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return Vocabulary.ranked(model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i))


def count_pieces(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, int]:
    """The number of pieces of each word's best segmentation; of equal scores the one with fewer pieces.

    Words come in order, so the trie's nodes on the way to the last word are a prefix of each list here: what the next word shares is kept.
    """
    scores, tails, byte = vocabulary.scores, vocabulary.tails, vocabulary.byte
    best, pieces, last = [0], [0], ""
    out = {}
    for word in sorted(words):
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del best[shared + 1 :], pieces[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top = fewest = None
            for start in range(end - 1, -1, -1):
                tail = word[start:end]
                if tail not in tails:
                    break
                score = scores.get(tail)
                if score is not None:
                    score += best[start]
                    if top is None or score > top or score == top and pieces[start] + 1 < fewest:
                        top, fewest = score, pieces[start] + 1
            if word[end - 1] not in scores:
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                score = best[end - 1] + size * byte
                if top is None or score > top or score == top and pieces[end - 1] + size < fewest:
                    top, fewest = score, pieces[end - 1] + size
            best.append(top)
            pieces.append(fewest)
        out[word] = pieces[len(word)]
        last = word
    return out


def _count(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        for part in blocks(batch):
            words = [(text or b"").split() for text in raw(part.column("text"))]
            new = {w for found in words for w in found if w not in known}
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = {w for found in words for w in found}
            spelled = {SPACE + w.decode(): w for w in new}
            known.update((spelled[s], n) for s, n in count_pieces(spelled, sent.value).items())
            counts = [sum(map(known.__getitem__, found)) for found in words]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_words", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Columns doc_id, n_words and n_tokens, one row for each row of ``docs``; nothing is shuffled.

    A pre-token is a word (a run without ASCII white space) with the space sign before it. A null or empty text has none. Repeated rows give equal rows. Other
    columns are not read. The vocabulary, whose size is the caller's, goes to all tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_count, sent=sent), "doc_id long, n_words long, n_tokens long")
