"""Small tables for the operators' tests: odd rows, and documents of the driver's tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))

ODD = [
    (1, None, "en", "web", None),
    (2, "", "en", "web", 0),
    (3, " \t\n\r\x0b\x0c ", "en", None, 7),
    (4, "Alpha beta GAMMA delta epsilon zeta eta theta", "en", "web", 45),
    (5, "alpha BETA gamma delta epsilon zeta eta theta", None, "web", 45),
    (6, "alpha BETA gamma delta epsilon zeta eta theta", None, "web", 45),
    (6, "alpha BETA gamma delta epsilon zeta eta theta", None, "web", 45),
    (7, "one", "en", "book", 3),
    (8, "one", "en", "book", 3),
    (9, "two words", "en", "", 9),
    (10, LONG, "en", "book", len(LONG)),
    (11, LONG + " tail", "en", "book", len(LONG) + 5),
    (12, "naïve café wide space \x1c\x1d sep Ünïcode İstanbul ﬁ ẞ 漢字 😀", "de", "web", 60),
    (None, "a row without an id of its own to stand for", "en", "web", 43),
    (-5, "a negative id with mail me@x.org and +1 (555) 123-4567 and 10.0.0.1", "en", "web", 66),
]


def odd_docs(spark):
    """ODD and columns whose names clash with those that operators add."""
    docs = spark.createDataFrame(ODD, DOCS)
    for name in ("size", "target", "score", "row", "node", "n", "value", "component_id", "kept", "template", "spans", "count", "_h", "token"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def a_to_z_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
