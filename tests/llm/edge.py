"""Rows that every operator must take: nulls, empty and long texts, repeated rows, columns whose names clash."""

from __future__ import annotations

LONG = " ".join(f"word{k % 911} and{k % 13}" for k in range(12_000))
TEXTS = ["The same line\nand another one here", None, "", "   \n\t", "x", "naïve café ☕ 漢字 and more words than five", LONG, "The same line\nand another one here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, seed string, component_id string"


def rows(texts=None):
    return [(None if t == "null id" else n, None if t == "null id" else t, None, None, None, 7, "s", "c") for n, t in enumerate(TEXTS if texts is None else texts)]


def frame(spark, texts=None):
    """The texts as documents with ids from 0, one repeated row and one without id."""
    own = rows(texts)
    return spark.createDataFrame([*own, *own[:1], (None, "text without an id", None, None, None, 7, "s", "c")], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
