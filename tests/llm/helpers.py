"""Small awkward tables: nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""

LONG = "word " * 30_000 + "x" * 50_000
EXTRA = ["key", "n", "fp", "label", "score", "ids", "host", "doc", "batch", "keys", "length", "sketch", "tokens", "rule", "blocks", "edited", "part"]
ROWS = [
    (5, "The same text, in five words or more", "en", "s", 1),
    (3, "the SAME text, in five words or more", None, "s", None),
    (5, "The same text, in five words or more", "en", "s", 1),
    (1, None, "en", None, 2),
    (2, "", None, None, None),
    (4, LONG, "en", "s", 3),
    (None, "a row without an id but with text", "en", "s", 4),
    (6, "É  ÉCOLE   çà  \n\n two\tlines 🙂\r\n", "fr", "s", 5),
    (7, "one", "en", "s", 6),
    (8, " \n\t ", "en", "s", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra=True):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in EXTRA})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
