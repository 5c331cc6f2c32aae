import random
from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, kept int, "
    "size string, row long, word long, bits_ long, found long, y int, n long, masked string, id_ long, block long"
)
CLASHES = ("s", 0.0, 7, "z", 1, 2, 3, 4, 5, 6, "p", 8, 9)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must survive: nulls in every column, blanks, a very long text, ties, repeats, clashes."""
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Été", "x", "42", "naïve", "the", "of"]
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "two words", "a\nb\na\n\nb", "word " * 60, " ".join(f"w{i}" for i in range(30_000)), "x" * 100_000, *prose]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, ["en", "fr", None][i % 3], ["s1", None, "é", "s0", ""][i % 5], None if i % 4 == 0 else len(t or "")))
    rows += [rows[10], rows[10], (None, prose[0], None, None, None), (None, None, None, None, None), (10, "another text for the same id", "en", "s1", 5)]
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).is_dir():
        pytest.skip("no test tables")
    return SMALL
