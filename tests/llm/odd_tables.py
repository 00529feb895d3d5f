import random

import pytest
from pyspark.sql import types as T

#: documents, with columns whose names the operators use inside
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
    T.StructField("ids", T.StringType()), T.StructField("score", T.StringType()), T.StructField("block", T.IntegerType()),
    T.StructField("kept", T.BooleanType()), T.StructField("__row", T.StringType())])


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    return " ".join(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words) + "é" * (rng.random() < 0.05)
                    for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    base, passage = prose(rng, 80), prose(rng, 60)
    long = " ".join(prose(rng, 500) for _ in range(40))
    texts = {1: base, 2: base, 3: base.replace(base.split()[40], "changed", 1), 4: prose(rng, 30) + " " + passage, 5: passage + " " + prose(rng, 30),
             6: "", 7: None, 8: "  \t\n ", 9: "one", 10: "One", 11: long, 12: long[5000:], 13: "a " * 300, 14: "\x00 ▁ é𓀀 " * 20,
             15: "x" * 400, 16: "x" * 60, -5: passage}
    rows = [(i, t) for i, t in texts.items()]
    rows += [(4, texts[4]), (None, passage), (None, None), (20, base), (20, long)]        # repeated, unnamed, two texts of one id
    return [(i, t, None if (i or 0) % 3 else "en", None, None if t is None else len(t), "r", "i", "s", 7, None, "x") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, (i or 0) % 2, (i or 0) % 3 == 0 and 1 or 0) for i in [*range(1, 17), 4, None]] + [(3, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark, odd):
    words = odd_rows()[4][1].split()
    return spark.createDataFrame([(1, " ".join(words[:20]).upper()), (2, "one"), (3, None), (4, " ,;"), (None, " ".join(words[5:25])),
                                  (1, " ".join(words[:20]))], "item_id long, text string")
