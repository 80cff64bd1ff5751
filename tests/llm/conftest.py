import random

import pytest

DOCS = "doc_id long, text string, key string, shard string, fp long, n_lines string, starts string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(40)]
    texts += [None, "", " ", "\n", "x", texts[0], texts[0], "a" * 3000, " ".join(r.choice(words) for _ in range(20000)), "tab\there  two\n\nlines   end"]
    rows = [(k, t, "k", "s", 1, "n", "q") for k, t in enumerate(texts)] + [(3, texts[3], "k", "s", 1, "n", "q"), (None, texts[1], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
