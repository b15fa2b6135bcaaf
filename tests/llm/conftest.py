import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_prose import prose  # noqa: E402


@pytest.fixture(scope="session")
def small(spark):
    """Documents with copies, near copies, nulls, empty, blank and long texts, repeated rows and clashing columns."""
    base = prose(1, 60)
    texts = [
        base,
        base,
        base + " extra",
        base.upper(),
        None,
        "",
        "   \n\t ",
        "one two",
        "one two",
        "Two one\ttwo",
        prose(2, 30) + "\n" + prose(3, 40) + "\n" + prose(4, 30),
        prose(5, 9) + "\n" + prose(3, 40) + "\nother tail",
        prose(6, 5000),
        "ÉCOLE école Straße 𝒳y " * 5,
    ]
    rows = [(k, t, "en" if k % 2 else "fr", "src", k, k, "x") for k, t in enumerate(texts)]
    rows += [rows[2], (None, base, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, words string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
