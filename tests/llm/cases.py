"""Small tables with the rows that go wrong: nulls, blanks, ties, repeats, long texts, clashing columns."""

import random

from pyspark.sql import types as T

WORDS = "the of and river stone light over under quick brown fox jumps lazy dog mountain valley green house small large tree".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice([".", ",", ""])) for _ in range(n))


DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("row", T.StringType()),
        T.StructField("spans", T.StringType()), T.StructField("part", T.StringType()), T.StructField("start", T.StringType()),
    ]
)
EXTRA = ("x", "y", None, "z", "p", "s")


def rows() -> list[tuple]:
    out = []

    def add(doc_id, body, lang="en", source="a"):
        out.append((doc_id, body, lang, source, None if body is None else len(body), *EXTRA))

    for i in range(40):
        add(i, text(i, 30 + i * 3), "en" if i % 2 else "fr", "abc"[i % 3])
    base = text(500, 200)
    for i in range(40, 60):  # near copies of one text, and exact ones
        words = base.split()
        if i % 4:
            words[i] = f"changed{i}"
        add(i, " ".join(words), "en", "a")
    add(60, None)
    add(61, "")
    add(62, " \t\n\x0b\x0c\r ")
    add(63, "one two three")
    add(64, "ONE Two thRee")
    add(65, text(900, 30_000), "en", "b")
    add(66, "x" * 100_000, None, None)
    add(67, "mail a.b+c@ex-ample.co.uk+d@e.fr, card 4111 1111 1111 1111, +1 (555) 010-9999, host 10.0.0.255 10.0.0.256 1.2.3.4.5", "en", None)
    add(68, "bank account DE89370400440532013000 and not DE89370400440532013001; social security 123-45-6789, 123-45-6780x", "en", "c")
    add(69, "café  naïve　wide \x1cctl \U0001f600 emoji 4111111111111111 " * 3, "fr", "￿")
    add(70, "  leading and   trailing  ", "en", "\U00010000")
    add(None, text(1, 50), "en", "a")
    add(None, None, None, None)
    add(71, text(7, 80), "en", "b")
    add(71, text(7, 80), "en", "b")  # a repeated row
    add(71, text(8, 80), "en", "c")  # the id again, with another text
    for i in range(80, 96):
        add(i, " ".join(w.upper() + "!!" for w in text(i, 60).split()), "en", "c")
    add(-5, text(3, 40), "de", "b")
    return out


def documents(spark, keep=None):
    return spark.createDataFrame(rows() if keep is None else keep, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark):
    data = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(80, 96)] + [(61, None, 1), (None, 1, None), (5, 0, 0), (9999, 1, 0)]
    return spark.createDataFrame(data, "doc_id bigint, quality int, toxic int")
