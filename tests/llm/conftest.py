import os
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
# Python workers import the operators too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))

#: Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, id long, digest string, row string, e string, "
          "rate double, copies long, lang_pred string, score double, spans string, n_words long, start long, comp long")
NASTY = [
    (1, "the cat sat on the mat and looked at the dog for a while", "en", "a", 58),
    (2, "the cat sat on the mat and looked at the dog for a while", "en", "a", 58),
    (2, "the cat sat on the mat and looked at the dog for a while", "en", "a", 58),
    (3, None, "en", "a", None),
    (4, "", "fr", "b", 0),
    (5, " \n\t ", None, "b", 4),
    (6, "word", "fr", None, 4),
    (None, "no id here", "en", "a", 10),
    (8, "12345 !!! --- 99", "en", "b", 16),
    (9, LONG, "en", "a", len(LONG)),
    (10, "Grüße aus der Straße, naïve façade ☃ 漢字 á", "de", "a", 44),
    (11, "x" * 50_000, "fr", "b", 50_000),
]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame([r + (0, "d", "r", "e", 0.5, 7, "zz", 0.1, "s", 3, 4, 5) for r in NASTY], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
