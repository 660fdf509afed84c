import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Small prose with copies, near copies, empty, blank and null texts and one long text."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    out = list(base)
    for t in base[:20]:
        w = t.split()
        if len(w) > 40:
            w[rng.randrange(len(w))] = "zzz"
        out += [t, " ".join(w), t.upper()]
    return out + ["", "   \n", None, None, "a", "é ß", " ".join(rng.choice(vocab) for _ in range(9000))]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows with clashing extra columns, a null id and a repeated row."""
    rows = [(i * 3 % 1009, t, "en", "s", i) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, __id string, __key string, kept long").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
