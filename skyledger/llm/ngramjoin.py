"""The n-gram Jaccard join of documents, by vertical partitioning (see `setjoin`), and what its links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.setjoin import Join
from skyledger.llm.shared import hot_keys, salted_join, staged


def ngram_links(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links lead to, its own included.

    Words are runs of anything but ASCII whitespace, A-Z lower-cased; a document's set holds its distinct shingles of so many words, with fewer words the whole
    sequence as one. Two documents link when 100 * intersection >= percent * union. No link is lost; shingles are told apart by 64 bits, sets by 128.
    Null, empty and blank texts have an empty set and are linked with nothing, not even each other. Whole texts are read, however long.
    Rows are documents of their own even if they share an id; repeated rows link. A null id never is a component's id unless it has no other.
    An empty table gives no rows; other columns do not matter.
    """
    join = Join(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), words, percent)
    found = join.components()
    rooted = staged(join.classes.join(found, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "join-roots")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "join-least")
    named = staged(salted_join(rooted.select("digest", "root"), least.drop("n"), "root", "digest", hot_keys(least, "root", "n")).select("digest", "component_id"), "join-named")
    some = join.rows.where("n > 0").select("row", "id", "n", "digest")
    linked = salted_join(some, named, "digest", "row", hot_keys(some, "digest"))
    told = linked.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = join.rows.where("n = 0").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return told.unionByName(alone)
