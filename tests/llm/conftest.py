import os
import sys

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, _row string"

PLAIN = "one two three four five six seven eight nine ten eleven twelve " * 1


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0, 9, "x", "r"), (2, "", "en", "a", 0, 9, "x", "r"), (3, " \t\n ", None, "b", 3, 9, "x", "r"),
        (4, PLAIN, "en", "b", None, 9, "x", "r"), (5, PLAIN, "fr", None, 1, None, None, None), (5, PLAIN, "fr", None, 1, None, None, None),
        (6, PLAIN.upper(), "en", "a", 1, 9, "x", "r"), (7, PLAIN + "thirteen", "en", "c", 1, 9, "x", "r"),
        (8, long_text, "en", "c", 1, 9, "x", "r"), (None, "alone without an id", "en", "c", 1, 9, "x", "r"),
        (None, None, None, None, None, None, None, None), (9, "a<|endoftext|>b  \n\n c's we'll é 日本 🎉", "en", "a", 1, 9, "x", "r"),
        (10, "same line\nsame line\nother\nsame line", "en", "a", 1, 9, "x", "r"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
