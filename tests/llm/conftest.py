import random

import pytest

DOCS = "doc_id long, text string, score string, predicted string, key int, bucket string, personal int, secrets int, leaks int, kept int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)``, with further columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "s", "p", 1, "b", 2, 3, 4, 5) for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture
def prose():
    """Seeded text of made-up words."""

    def make(words: int, seed: int = 0) -> str:
        r = random.Random(seed)
        syllables = "ba ke li mo nu ra se ti vo wu fa ge".split()
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(words))

    return make


ODD = [(None, "row without an id"), (901, None), (902, ""), (903, " \t\n "), (904, "x"), (905, "é ü 漢字 \U0001f600   end"), (906, "a\x00b\x00c")]


@pytest.fixture
def odd():
    return list(ODD)
