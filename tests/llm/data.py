"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators might use themselves.
        T.StructField("key", T.StringType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("fp", T.LongType()),
        T.StructField("row", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("data", T.StringType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("component", T.LongType()),
    ]
)


def documents(spark, texts, first=0):
    """``texts``: (doc_id or None for the next number, text, source)."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text, source = t if isinstance(t, tuple) else (first + i, t, "s")
        rows.append((doc_id, text, "en", source, None if text is None else len(text), "k", 1, 2, "r", 3, "d", 0.5, 4))
    return spark.createDataFrame(rows, SCHEMA)


def words(rng: random.Random, n: int, vocabulary: int = 40) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(spark):
    long = " ".join(words(random.Random(1), 20_000, 3000))
    return documents(
        spark,
        [
            (1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (None, "one two three four", "b"), (None, None, "b"),
            (4, long, "a"), (5, long, "a"), (6, "Hello, World. hello world", "c"), (6, "Hello, World. hello world", "c"),
            (7, "é̀ ß Ｆｕｌｌ  nbsp 日本語 😀", None), (8, "x" * 5000, "a"), (9, "a a a a a a a " * 40, "a"),
        ],
    )
