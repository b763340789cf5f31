import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from textgen import prose  # noqa: E402

@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


SCHEMA = "doc_id long, text string, lang string, source string, score double, rank int, key string, n long, pos int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, and columns that clash with internal names."""
    r = random.Random(3)
    long = prose(r, 30_000)
    base = prose(r, 120)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, "a"), (3, None, "en", "b"), (4, "", "en", None), (5, "   \n\t ", None, None),
        (6, long, "en", "b"), (7, "12345 67", "de", "b"), (8, base + " tail", "de", "c"), (9, "Öl über Straße\nEine Zeile\n", "de", "c"), (10, "x", None, "c"),
        (None, "no id here", "en", "a"), (11, "😀 \u0000 mixed 漢字 text", "en", "b"),
    ]
    return spark.createDataFrame([(*x, 0.5, 1, "k", 2, 3) for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
