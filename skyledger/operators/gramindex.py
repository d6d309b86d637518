"""An index of folded trigrams beside a part store, for exact substring search that reads few parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.fold import contains_folded, fold
from skyledger.sources.parts import PartStore
from skyledger.sources.tables import small

#: Trigrams of a query that are looked up at most, the rarest first; fewer rows are read for the same hits.
LOOKED_UP = 4
#: Rows of which a posting list is made at most; a list holds no more ids.
LISTED = 4096


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a folded text."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("(?s)(?=(...))"), 1))


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(work, part, gram, ids) of rows (work, part, id, grams): a batch's rows of the same part that hold a gram are one list."""
    for whole in batches:
        for start in range(0, whole.num_rows, LISTED):
            rows = whole.slice(start, LISTED)
            held = rows.column("grams")
            row = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
            told = held.flatten().dictionary_encode()
            work, part = (rows.column(c).dictionary_encode(null_encoding="encode") for c in ("work", "part"))
            place = work.indices.to_numpy().astype(np.int64) * len(part.dictionary) + part.indices.to_numpy()
            gram = told.indices.to_numpy()
            key = place[row] * len(told.dictionary) + gram
            order = np.argsort(key, kind="stable")
            row, gram, first = row[order], gram[order], np.flatnonzero(np.diff(key[order], prepend=-1))
            ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), rows.column("id").take(pa.array(row)))
            at = pa.array(row[first])
            yield pa.RecordBatch.from_pydict({"work": rows.column("work").take(at), "part": rows.column("part").take(at), "gram": told.dictionary.take(pa.array(gram[first])), "ids": ids})


class GramIndex:
    """Posting lists (gram, work, part, ids) in Parquet files by a hash of the gram, sorted within, so that a lookup opens one folder and few row groups.

    Parts are added as they come: each addition is a generation of its own, and of a part that was added again only the last one counts. Searches
    give the rows whose folded text holds the folded query, all of them: the grams only choose which parts and rows are looked at. Queries
    of fewer than three characters scan the store. Texts, works, parts and ids may be null or repeated.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, spread: int = 2):
        self.spark, self.path, self.buckets, self.spread = spark, path, buckets, spread

    def _bucket(self, gram: str | Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", False).parquet(f"{self.path}/{name}")

    def add(self, rows: DataFrame, generation: int) -> None:
        """Index rows (work, part, id, text) of whole parts. Generations are numbered upward; one that is written again replaces itself."""
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("work", "part"))
        lists = rows.select("work", "part", "id", grams(F.col("text")).alias("grams")).mapInArrow(posting_lists, f"{kinds}, gram string, ids array<{rows.schema['id'].dataType.simpleString()}>")
        each = lists.withColumns({"bucket": self._bucket("gram"), "n": F.size("ids")})
        # a bucket is dealt to several tasks, as some grams are in nearly every text
        dealt = each.repartition("bucket", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(self.spread))).sortWithinPartitions("bucket", "gram", "work", "part")
        place = f"generation={generation}"
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{place}")
        written = self.spark.read.parquet(f"{self.path}/postings/{place}")
        written.groupBy("bucket", "gram").agg(F.sum("n").alias("n")).repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/{place}")
        rows.select("work", "part").distinct().write.mode("overwrite").parquet(f"{self.path}/parts/{place}")

    def _rarest(self, wanted: list[tuple[int, str]]) -> list[tuple[int, str]] | None:
        """The wanted (bucket, gram) with the fewest postings; none if one of them is nowhere."""
        found = self._chosen(self._table("counts"), wanted).groupBy("bucket", "gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()  # a query's grams at most
        return [(r["bucket"], r["gram"]) for r in found[:LOOKED_UP]] if len(found) == len(wanted) else None

    def _chosen(self, table: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
        return table.where(F.col("bucket").isin(sorted({b for b, _ in wanted})) & F.col("gram").isin([g for _, g in wanted]))

    def candidates(self, query: str) -> DataFrame | None:
        """(work, part, id) of the rows that hold the query's rarest grams; null for a query of fewer than three characters."""
        one = self.spark.range(1).select(F.explode(grams(F.lit(query))).alias("gram"))
        wanted = [(r["bucket"], r["gram"]) for r in one.select(self._bucket("gram").alias("bucket"), "gram").collect()]  # a query's grams
        if not wanted:
            return None
        rarest = self._rarest(wanted)
        postings = self._chosen(self._table("postings"), rarest or wanted)
        if rarest is None:
            return postings.where(F.lit(False)).select("work", "part", F.explode("ids").alias("id"))
        last = small(self._table("parts").groupBy("work", "part").agg(F.max("generation").alias("_last"))).withColumnsRenamed({"work": "_work", "part": "_part"})
        valid = postings.join(last, F.col("work").eqNullSafe(F.col("_work")) & F.col("part").eqNullSafe(F.col("_part")) & (F.col("generation") == F.col("_last")))
        return valid.select("work", "part", "gram", F.explode("ids").alias("id")).groupBy("work", "part", "id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("work", "part", "id")

    def search(self, store: PartStore, query: str, id_col: str, text_col: str = "text") -> DataFrame:
        """The store's rows whose folded text holds the query."""
        found = self.candidates(query.strip())
        rows = store.table()
        if found is None:
            return rows.where(contains_folded(F.col(text_col), query.strip()))
        ids = small(found.withColumnsRenamed({"work": "_work", "part": "_part", "id": "_id"}))
        # a folder's name stands for a value of either kind; the condition says nothing but lets the list of parts prune folders at run time
        named = ids.select(F.col("_work").alias("work"), F.col("_part").alias("part")).distinct().where((F.length("work") >= 0) & (F.length("part") >= 0))
        near = rows.join(F.broadcast(named), ["work", "part"], "left_semi").unionByName(rows.where("work IS NULL OR part IS NULL"))
        same = F.col("work").eqNullSafe(F.col("_work")) & F.col("part").eqNullSafe(F.col("_part")) & F.col(id_col).eqNullSafe(F.col("_id"))
        return near.join(ids, same, "left_semi").where(contains_folded(F.col(text_col), query.strip()))
