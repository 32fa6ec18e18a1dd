import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = os.pathsep.join([HOME, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))

#: Null, empty and blank texts, very long ones, repeated rows, a missing doc_id, short and non-ASCII texts.
ODD = [
    (7, None), (8, ""), (9, " \n\t "), (10, LONG), (11, LONG + " end"), (12, "one two three"), (13, "one two three"),
    (12, "one two three"), (None, "a row without a number of its own"), (14, "ümlaut – naïve 漢字 🙂 x"), (15, "|" * 500),
    (16, "x" * 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with columns that the operators use as names themselves."""
    rows = [(i, t, "en", "src", 1.5, 2, "c") for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, score double, key int, cls string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
