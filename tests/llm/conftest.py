import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, key string, n int, place int, fp string, keep string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls anywhere, empty and long texts, repeats, ties, and columns whose names operators use inside."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["The", "é", "ß"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    line = "This very line is long enough to be dropped when repeated."
    texts += [line + "\n" + t for t in texts[:8]] + [t.upper() for t in texts[:3]] + [" ".join(rng.choice(vocab) for _ in range(20000))]
    texts += ["", " \n\t ", "one", "a b c d", "x " * 300, texts[0] + " tail", texts[1], texts[1]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, texts[2], None, None, None), (1000, None, "en", "s1", None), rows[3], rows[3], (2000, texts[4], None, "s0", 5)]
    return spark.createDataFrame([(*r, "r", 1, "k", 2, 3, "f", "b") for r in rows], DOCS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
