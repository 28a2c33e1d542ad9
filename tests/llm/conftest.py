import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def words():
    """A source of texts of made-up words."""
    def make(seed, n, vocabulary=200):
        rng = random.Random(seed)
        known = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
        return " ".join(rng.choice(known) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def awkward(spark, words):
    """Null ids and texts, blanks, one very long text, repeated rows, and columns named like the operators' own."""
    long = words(1, 30_000, 3000)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, long), (5, "one two"), (5, "one two"), (None, "one two"), (None, None),
        (6, "one  two"), (7, words(2, 120)), (8, words(2, 120)), (9, words(2, 120) + " tail"), (10, "a\x0bb\x1cc\u00a0d ▁ é"),
    ]
    data = [(i, t, "x", None if i == 7 else "s", 0, "f", 1, 2.0) for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, size int, shard string, n int, target double"
    )


@pytest.fixture(scope="session")
def stored(spark, awkward, tmp_path_factory):
    """The same, read from files."""
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    awkward.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(stored):
    return stored.limit(0)
