from __future__ import annotations

import os
import random

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test data not present")
    return SF_DIR


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of the given texts; with ``odd``, with columns whose names an operator might use itself."""

    def build(texts, source="s", odd=False):
        rows = [(i, t, "en", source, len(t) if t is not None else None) for i, t in (texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts)))]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if odd:
            for name in ("key", "doc", "id", "tie", "twin", "n", "fp", "size", "shard", "bucket", "gone", "extra", "starts", "score", "toxicity", "a b.c", "c0"):
                df = df.withColumn(name, df.source)
        return df

    return build


def prose(n: int, seed: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
