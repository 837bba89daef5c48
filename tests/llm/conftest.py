import random

import pytest
from pyspark.sql import types as T

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "si", "to") for b in ("den", "fal", "gor", "hin", "lus", "mar")]
CLASHING = ("_h", "_key", "h", "ids", "n_tokens", "decoded", "kept", "place", "guest", "score", "code", "block", "n", "_e", "_known", "_quality")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts):
    """(doc_id, text) pairs as rows of documents with clashing extra columns."""
    return [(i, t, "en" if n % 3 else None, None, len(t) if t else None, *["x"] * len(CLASHING)) for n, (i, t) in enumerate(texts)]


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Single"),
    (5, prose(30_000, 1)),
    (6, prose(60, 2)),
    (6, prose(60, 2)),
    (7, prose(60, 2)),
    (None, prose(40, 3)),
    (None, None),
    (8, "naïve É 中文 🎉 <|endoftext|> it's 'street"),
    (9, "x" * 5000),
]


@pytest.fixture(scope="module")
def make(spark):
    from cellclock.llm.common import ready

    ready(spark)
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="module")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="module")
def empty(make):
    return make([])


@pytest.fixture(scope="module")
def documents(spark):
    from conftest import SF_DIR

    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
