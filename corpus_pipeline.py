"""The corpus pipeline: stages applied to ``documents`` one after another.

Each stage gets what its predecessor kept, all rows and columns of it, and leaves rows
out or changes texts; the last one adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellclock.llm.bpe_automaton import encode_decode
from cellclock.llm.common import ready, table, written
from cellclock.llm.decontaminate import drop_contaminated
from cellclock.llm.near_dedup import drop_near_duplicates
from cellclock.llm.pii import replace_entities
from cellclock.llm.quality import keep_good
from cellclock.llm.queries import vocabulary

SURROGATE_KEY = "corpus-2024"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(ready(spark), sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ready(spark)
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return drop_contaminated(docs, table(ready(spark), sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    ready(spark)
    changed = replace_entities(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return changed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the text that they decode to."""
    ready(spark)
    return encode_decode(docs, vocabulary())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", tokens),
]

# A trained classifier decides what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written."""
    docs = table(ready(spark), sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
