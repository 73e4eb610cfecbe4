"""Small tables with awkward rows, and plain brute-force versions."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    T.StructField("value", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("component", T.LongType()),
])
WORDS = [a + b for a in "ka lo mi nu re sa te vo".split() for b in "ban dor fel gim hus jat kor lem".split()]


def docs(spark, rows):
    """Documents from (doc_id, text[, source]) tuples."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1]), "x", 1, 7) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def changed(text, seed, n):
    """The text with n words replaced."""
    rng, words = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)
