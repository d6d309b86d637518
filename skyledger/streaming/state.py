"""A keyed state in a folder: versions of buckets, written anew where a batch touches them, and one list that tells which version counts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.sources.tables import stored

#: Lists kept, so that a read that began under the last one ends well.
LISTS_KEPT = 2


class StateFolder:
    """One row per key, in `buckets` folders by a hash of the keys. A batch of changes rewrites the buckets that it touches and no others.

    `reduce` brings rows, old state and changes alike, to one row per key; it must not matter in which order or in how many steps. The data of a version is
    written first, then the list that names each bucket's version, by a rename. A crash in between leaves the old list, and the batch is run again. A batch whose
    number is in the list is passed over. A read opens the files of one version per bucket, however many batches there were; versions that the last
    lists do not name are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, reduce: Callable[[DataFrame], DataFrame], buckets: int = 16):
        self.spark, self.path, self.keys, self.schema, self.reduce, self.buckets = spark, path, keys, schema, reduce, buckets
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _lists(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("lists") if n.endswith(".json"))

    def current(self) -> dict:
        """The last list: its version, the last batch in it, and the version of each bucket (by name)."""
        made = self._lists()
        if not made:
            return {"version": 0, "batch": -1, "buckets": {}}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/lists/{made[-1]}.json", wholetext=True).collect())
        return json.loads(text)

    def _read(self, listed: dict[str, int]) -> DataFrame:
        if not listed:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(listed.items())))

    def read(self) -> DataFrame:
        return self._read(self.current()["buckets"])

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Take a batch of rows of the state's columns. Batches are numbered upward; one that was taken before changes nothing."""
        now = self.current()
        if batch <= now["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = stored(self.reduce(changes.select(self.schema.names)).select(*self.schema.names, bucket.alias("bucket")), "changes")
        touched = sorted(str(r[0]) for r in fresh.select("bucket").distinct().collect())  # at most `buckets`
        version = now["version"] + 1
        if touched:
            old = self._read({b: v for b, v in now["buckets"].items() if b in touched})
            whole = self.reduce(old.unionByName(fresh.drop("bucket"))).select(*self.schema.names, bucket.alias("bucket"))
            whole.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        self._switch({"version": version, "batch": batch, "buckets": now["buckets"] | dict.fromkeys(touched, version)})
        self._clean()

    def _switch(self, made: dict) -> None:
        """Make this list the last one: written beside it, then renamed, which is one step."""
        hidden, place = self._place("lists", f"_{made['version']}.tmp"), self._place("lists", f"{made['version']}.json")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not self._fs.rename(hidden, place):
            raise RuntimeError(f"another writer made version {made['version']} of {self.path}")

    def _clean(self) -> None:
        lists = self._lists()
        named = set()
        for n in lists[-LISTS_KEPT:]:
            named |= set(json.loads(self.spark.read.text(f"{self.path}/lists/{n}.json", wholetext=True).first()[0])["buckets"].values())
        for n in lists[:-LISTS_KEPT]:
            self._fs.delete(self._place("lists", f"{n}.json"), False)
        for folder in self._names("data"):
            version = int(folder.partition("=")[2])
            if version < lists[-1] and version not in named:
                self._fs.delete(self._place("data", folder), True)
