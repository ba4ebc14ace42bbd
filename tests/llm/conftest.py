from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as extra columns of the input.
CLASHES = ["node", "row", "key", "ident", "rank", "spans", "tokens", "canon", "slots", "uid", "component", "label", "part", "h", "cell", "score", "toxic", "_row", "_key", "_ident", "_spans", "_text", "_cut", "spans_", "digest", "output", "ids", "decoded"]


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) or (doc_id, text, lang) as a table of documents with extra columns of clashing names."""

    def build(rows, clashing: bool = True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENT)
        if clashing:
            for name in CLASHES:
                frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return build


@pytest.fixture(scope="session")
def words():
    """Invented words, the same in every run."""
    import random

    draw = random.Random(5)
    return ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(3000)]
