"""A corpus pipeline: language, toxicity, exact copies, near copies, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again as the next stage's docs; so a lost executor
never reaches back over a stage. All but the last stage return the columns of documents.

In every stage a null text is treated as an empty one, whole texts are read, rows are documents of their own even if they share an id, extra columns
are carried (but for the last stage), and an empty table stays empty. What else a stage does with odd rows stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.exact_dedup import drop_copies
from skyledger.llm.langid import language_filter
from skyledger.llm.neardups import drop_near_copies
from skyledger.llm.packing import pack
from skyledger.llm.shared import held_out, staged, table
from skyledger.llm.toxicity import drop_toxic
from skyledger.llm.vocabularies import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language. Null texts, and those without a letter, go; repeated rows stay or go together."""
    return language_filter(docs, vocabulary("piece_bpe_32k.model"), ~held_out(F.col("doc_id")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not toxic. Without labels of both kinds all stay; repeated rows stay or go together."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")), threshold=0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of equal texts; rows that repeat it stay, too. Rows without an id lose to any other."""
    return drop_copies(docs, keep="min")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8 or more; repeated rows are copies."""
    return drop_near_copies(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every token of every document in a sequence of a permitted length. Null and empty texts are their end id; repeated rows are placed each."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), cached_words=60_000)  # the executors hold what earlier stages made their heaps grow to


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Models are fitted and bins are filled along the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
