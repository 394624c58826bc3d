import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents with columns whose names operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if extra:
            for name in ("hash", "key", "row", "kept", "lines", "node", "score", "spans", "length"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


ODD = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "a"), (None, "no id at all"), (4, "\n\n"),
       (5, "the same"), (5, "the same"), (6, "the  same\n"), (7, "ü𝄞é " * 3), (8, "w " * 30_000)]


@pytest.fixture
def odd(docs):
    return docs(ODD)
