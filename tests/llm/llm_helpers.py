"""Plain-Python forms of the operators, and awkward rows to try them on."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000


def rows(texts: list, first: int = 0) -> list[tuple]:
    return [(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def awkward(spark):
    """Null and empty texts, one word, repeats in capitals, ties, a null id, a null source, a very long text."""
    texts = [None, "", " ", "one", "ONE", "one two three four five", "one two three four five", "Äpfel äpfel", LONG, LONG + "x", "\n\t ", "a  b", "▁"]
    data = rows(texts)
    data += [(None, "no id at all", None, None, None), (3, "one", "en", "src0", 3), (50, "one two three four five six", None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def clashing(df, names: list[str]):
    """The same table with more columns, named as the operator's own."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
