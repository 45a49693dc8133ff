from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)``, or with language and source; further columns carry clashing names."""

    def make(*values, extra: bool = False):
        rows = [(*v, *(["en", "a"][len(v) - 2 :] if len(v) < 4 else [])) for v in values]
        rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            df = df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])
        return df

    return make


#: Names that the operators use for columns of their own.
CLASHING = (
    "id h node key part score predicted shard slot position bucket planned size taken target text_hash extra pii base_pii kept component_id "
    "n_words tokens words counts block lang_pred held_out token_ids decoded wordless rank quota blocks s turn mix_rank n"
).split()


@pytest.fixture
def oddities(docs):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids."""
    long = "word " * 20_000 + "x" * 100_000
    return docs(
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "fr", None),
        (None, "mail me at a.b@c.example or +1 (212) 555-0100 today please do so", "en", "b"),
        (None, None, None, None),
        (5, long, "de", "b"),
        (1, "another text under the same number with words of its own", "en", "a"),
        extra=True,
    )
