"""Near-duplicate documents: word-shingle Jaccard similarity at or above a bound, every such pair.

Two kinds of blocks propose pairs, and shingle sets decide about each (see `setjoin`).

* SimHash fingerprints of the shingles, joined on pigeonhole blocks and verified by their Hamming distance (`simhash.links`). They find most copies
  cheaply, but fingerprints of texts at a similarity of 0.8 may lie any number of bits apart, so alone they would lose links.
* Prefixes of the shingle sets, which lose none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.setjoin import Join
from skyledger.llm.shared import hot_keys, salted_join, staged
from skyledger.llm.simhash import links

#: Bits in which fingerprints of a proposed pair may differ.
RADIUS = 2
#: Dropped rows up to this number (a file's name and a row's number each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_GONE = 250_000


def fingerprint_pairs(light: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the smallest of its fingerprint, and those of fingerprints within RADIUS bits. light: (node, fp)."""
    by_fp = staged(light.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")), "near-fps")
    close = staged(links(by_fp.select("fp"), RADIUS), "near-close")
    leads = [by_fp.select(F.col("fp").alias(side), F.col("lead").alias(f"{side}_lead")) for side in ("a", "b")]
    apart = salted_join(salted_join(close, leads[0], "a", "b", hot_keys(close, "a")), leads[1], "b", "a", hot_keys(close, "b"))
    apart = apart.select(F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b"))
    many = by_fp.where("n > 1").select("fp", "lead", "n")
    same = salted_join(light.select("fp", "node"), many.select("fp", "lead"), "fp", "node", hot_keys(many, "fp", "n")).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return apart.unionByName(same)


def named_rows(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a name of their own: file and place where they are read from files, each row once; else a number, for which they are written anew."""
    try:
        named = docs.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))
        if named.groupBy(F.xxhash64(name).alias("h")).count().where("count > 1").isEmpty():  # a join may have repeated rows
            return named
    except AnalysisException:  # no file is under the rows
        pass
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "near-docs")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each group of near-duplicates, that of the smallest id; all columns as they are.

    Each row is a document of its own: rows that share an id are told apart and repeated rows are copies. Rows with a null id take part and
    stay only where their whole group has none. Null, empty and blank texts are alike. Texts with fewer than `words` words are one
    shingle. Whole texts are compared, however long. An empty table stays empty; extra columns of any name are carried.
    """
    name = next(n for n in (f"near_row{i or ''}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    named = named_rows(docs, name)
    join = Join(named.select(F.col(name).alias("id"), "text"), words, percent, blank=True)
    found = join.components(fingerprint_pairs(join.light))
    # every row of a class that is linked or has several rows
    rooted = staged(join.classes.join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "near-roots")
    rows = join.rows.select("id", "digest", "row")
    grouped = salted_join(rows, rooted, "digest", "row", hot_keys(rows, "digest")).select("id", "root")
    sizes = staged(grouped.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    members = staged(salted_join(grouped, sizes.select("root"), "root", "id", hot_keys(sizes, "root", "n")), "near-groups")
    told = members.join(named.select(F.col(name).alias("id"), F.col("doc_id").alias("own")), "id")
    best = F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id")).alias("k")
    kept = told.groupBy("root").agg(best).select(F.col("k.id").alias("id"))
    gone = staged(members.join(kept, "id", "left_anti").select(F.col("id").alias(name)), "near-gone")
    return named.join(F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone, name, "left_anti").drop(name)
