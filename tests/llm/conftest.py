import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of texts; ids 0, 1, ... unless (id, text) pairs are given."""

    def make(texts, lang="en", source="s"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def prose():
    def make(n, seed=0, vocabulary=400):
        rng = random.Random(seed)
        words = ["".join(rng.choice(["an", "the", "ou", "er", "st", "li", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
        return " ".join(rng.choice(words) for _ in range(n))

    return make
