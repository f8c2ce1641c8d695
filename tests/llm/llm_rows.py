"""Rows for the tests of this folder."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, label double, w string, row string, band string"


def make(spark, rows):
    full = [(i, t, lang, src, len(t) if t else None, "x", 1.0, "y", "z", "b") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n, stock="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randint(2, 7))) for _ in range(n))
