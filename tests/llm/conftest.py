import random

import pytest

WORDS = "alpha beta gamma delta omega sigma theta kappa lamda rho tau phi chi psi zeta iota".split()


@pytest.fixture(scope="session")
def prose():
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        """Rows are (doc_id, text) or (doc_id, text, (lang, source))."""
        full = [(r[0], r[1], *(r[2] if len(r) > 2 else ("en", "s"))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string")

    return make
