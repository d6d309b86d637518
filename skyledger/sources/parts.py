"""Text parts keyed (work, part): a partitioned Parquet store with pruned bulk reads, a status per part, inventory and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.sources.tables import small

#: What a wanted part turns out to be.
LOADED, EMPTY, MISSING = "loaded", "loaded-but-empty", "offline-or-missing"


class PartStore:
    """Parts under a path, one folder for each (work, part). Reads of a few parts prune to their folders; a file that cannot be read is passed over."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def register(self, rows: DataFrame, work: str = "work", part: str = "part") -> None:
        """Write parts; a part that is there already is written anew, others stay. The first rows settle the store's columns."""
        named = rows.withColumnRenamed(work, "work").withColumnRenamed(part, "part")
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("work", "part").parquet(self.path)
        self.schema = self.schema or named.schema

    def table(self) -> DataFrame:
        """All rows that can be read, of all parts."""
        reader = self.spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        return (reader.schema(self.schema) if self.schema else reader).parquet(self.path)

    def load(self, work: str, part: str) -> DataFrame:
        return self.table().where((F.col("work") == work) & (F.col("part") == part))

    def files(self) -> DataFrame:
        """(work, part, file, bytes) of every file that is held, from the listing alone: no file is opened."""
        listed = self.spark.read.format("binaryFile").load(self.path)
        return listed.select(F.col("work").cast("string").alias("work"), F.col("part").cast("string").alias("part"), F.col("path").alias("file"), F.col("length").alias("bytes"))

    def present(self) -> DataFrame:
        """(work, part) of all parts that files are held of. A folder that stands for null is null."""
        return self.files().select("work", "part").distinct()

    def status(self, wanted: DataFrame) -> DataFrame:
        """work, part, status, files, bytes and rows of every wanted part.

        Without a file a part is missing; with files but no row it is empty, be it that it was written so, cut off, or is no Parquet at all: files that
        cannot be read count as if they held nothing, and do not keep the others from being read. Rows are counted from the files' own counts.
        """
        asked = _asked(wanted)
        held = _only(self.files(), asked).groupBy("work", "part").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
        filled = _only(self.table().select("work", "part"), asked).groupBy("work", "part").agg(F.count("*").alias("rows"))
        told = asked.join(held, ["work", "part"], "left").join(filled, ["work", "part"], "left")
        state = F.when(F.col("files").isNull(), MISSING).when(F.col("rows").isNull(), EMPTY).otherwise(LOADED)
        return told.select("work", "part", state.alias("status"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "bytes", "rows")))

    def load_many(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the wanted parts (columns work, part), and each wanted part's status. The list of parts is sent to the readers, which open only their folders."""
        return _only(self.table(), _asked(wanted)), self.status(wanted)

    def inventory(self) -> DataFrame:
        """Per work: parts, files and bytes held."""
        return self.files().groupBy("work").agg(F.count_distinct(F.coalesce("part", F.lit(""))).alias("have"), F.count("*").alias("files"), F.sum("bytes").alias("held_bytes"))

    def forget(self, work: str) -> int:
        """Drop a work's folder; returns how many parts went."""
        n = self.present().where(F.col("work") == work).count()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/work={work}")
        folder.getFileSystem(conf).delete(folder, True)
        return n


def _asked(wanted: DataFrame) -> DataFrame:
    """The wanted parts, each once, broadcast if their counted number allows. The condition says nothing but that the list is a selection, for which folders are pruned at run time."""
    return small(wanted.select("work", "part").distinct()).where((F.length("work") >= 0) & (F.length("part") >= 0))


def _only(rows: DataFrame, asked: DataFrame) -> DataFrame:
    return rows.join(asked, ["work", "part"], "left_semi")


def residency(store: PartStore, library: DataFrame) -> DataFrame:
    """Per work of the library (work, total, bytes): parts held, total, bytes, whether it is held whole, and the bytes of the files held."""
    joined = library.join(store.inventory(), "work", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("have", "held_bytes")})
    return joined.select("work", "have", "total", "bytes", (F.col("have") >= F.col("total")).alias("whole"), "held_bytes")
