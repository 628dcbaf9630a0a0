import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, a long text; extra columns whose names clash with inner ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, score double, t1 long, h string, n long, bucket long, __id long, __score double, __t1 long, near_id long, toxicity double, text_in string"


def rows_of(texts):
    return [(i, t, "en", s, None if t is None else len(t), 1, "k", 2, 0.5, 3, "h", 4, 5, 6, 0.5, 7, 8, 0.5, "in") for i, t, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    texts = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one", "b"), (6, "one", "b"), (6, "one", "b"),
        (7, prose(1, 300), "a"), (8, prose(1, 300) + " more", "a"), (None, "no id", "c"), (9, prose(2, 30_000), None),
        (10, "Ünïcode words: 東京 😀 é", "c"), (11, prose(1, 300), ""),
    ]
    return spark.createDataFrame(rows_of(texts), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
