"""Small tables with the awkward cases, and plain versions of shared pieces."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(fold(text))


def docs(spark, rows, extra=True):
    """rows (doc_id, text, source); with columns whose names the operators use too."""
    data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("bucket", "rank", "key", "token", "size", "rid", "k1", "n", "term", "_b", "_part", "target", "kept", "path", "class", "_id", "_key", "_own", "_digest", "_g", "_s", "rep", "found", "text_", "words", "at"):
            df = df.withColumn(name, F.lit("x"))
    return df


def awkward():
    """Null and empty texts, null and repeated ids, no words, long and odd texts, ties."""
    long_text = " ".join(f"word{i % 977} and" for i in range(20_000))
    return [
        (1, None, "a"),
        (2, "", None),
        (3, "!!! ... ???", "b"),
        (4, long_text, "a"),
        (5, "One short text.", "b"),
        (5, "One short text.", "b"),
        (6, "One short text.", ""),
        (None, "no id here", "a"),
        (None, None, None),
        (7, "École élève ÉCOLE 東京 \U0001f600 end", "c"),
        (8, "a" * 5000, "c"),
        (9, "same words " * 300, "a"),
        (10, "tabs\tand\nlines\r\nand\x0bmore\x0c", "a"),
    ]
