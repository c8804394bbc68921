import random

import pytest

EXTRA = "text string, doc_id long, lang string, source string, n_chars long, size long, class long, version long, uid long, kept boolean, spans string, _key long, words string, signature string, row string, `group` string, key long, mix string, of long, `range` long, _mix long, _size long, _ranges long, _copy long, _kept_id long, cut string, before long, once string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) as documents with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[1], r[0], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, 2, 3, 4, True, "x", 5, "w", "z", "r", "g", 1, "m", 2, 3, 4, 5, 6, 7, 8, "c", 9, "o") for r in rows]
        return spark.createDataFrame(full, EXTRA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random words from a small vocabulary."""

    def make(n, seed, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts(prose):
    return [None, "", " \t\n", "one", "two words", "é ü ñ 😀", "same " * 40, prose(30_000, 1), prose(120, 2), prose(120, 2)]
