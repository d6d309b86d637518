"""Stored records: JSON adopted over defaults by shape, old layouts migrated once, a file's record merged in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shape(value: Column) -> Column:
    """array, object, or anything else in lower case, of a VARIANT; null where there is none."""
    return F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def _members(rows: DataFrame, value: str) -> DataFrame:
    """The rows with a member of their VARIANT each, as (_name, _value): an object's by key, an array's by place. Rows without members are not there."""
    each = rows.sparkSession.tvf.variant_explode(F.col(value).outer())
    return rows.lateralJoin(each).withColumn("_name", F.coalesce("key", F.col("pos").cast("string"))).withColumnRenamed("value", "_value").drop("key", "pos")


def adopted(rows: DataFrame, key: str, blob: str, defaults: dict[str, object]) -> DataFrame:
    """Stored JSON records read over defaults, one row per entry: key, name, value (VARIANT) and source.

    Sources: `default`, `adopted`, `carried` (a name that is not known here) and `aside` (the whole text of a record that cannot be read, without a name). A
    known name takes what is stored, whatever it is, where its default is a scalar; where that is a list, only an array; where it is a dict, only an
    object or an array. A null, empty or unreadable record, a scalar and a JSON null leave the defaults; of a whole record that is an array the places are
    names that are not known. Text that names a member twice cannot be read. Repeated records are each returned.
    """
    filled = F.when(F.col(blob) != "", F.col(blob))
    parsed = rows.select(F.col(key).alias("_key"), filled.alias("_text"), F.try_parse_json(filled).alias("_v"))
    known = []
    for name, default in defaults.items():
        stored = F.when(_shape(F.col("_v")) == "object", F.variant_get("_v", f"$['{name}']", "variant"))
        fits = {list: ["array"], dict: ["object", "array"]}.get(type(default))
        good = stored.isNotNull() if fits is None else F.coalesce(_shape(stored).isin(fits), F.lit(False))
        plain = F.parse_json(F.lit(json.dumps(default)))
        known.append(F.struct(F.lit(name).alias("name"), F.when(good, stored).otherwise(plain).alias("value"), F.when(good, "adopted").otherwise("default").alias("source")))
    own = parsed.select("_key", F.explode(F.array(*known)).alias("e")).select(F.col("_key").alias(key), "e.*")
    whole = parsed.where(_shape(F.col("_v")).isin("object", "array"))
    more = _members(whole.select("_key", "_v"), "_v").where(~F.col("_name").isin(list(defaults)))
    carried = more.select(F.col("_key").alias(key), F.col("_name").alias("name"), F.col("_value").alias("value"), F.lit("carried").alias("source"))
    unread = parsed.where("_text IS NOT NULL AND _v IS NULL")
    aside = unread.select(F.col("_key").alias(key), F.lit(None).cast("string").alias("name"), F.to_variant_object(F.array("_text")).alias("_a"), F.lit("aside").alias("source"))
    aside = aside.select(key, "name", F.variant_get("_a", "$[0]", "variant").alias("value"), "source")
    return own.unionByName(carried).unionByName(aside)


def held(value: Column) -> Column:
    """Whether a stored JSON value counts as there: not missing, null, 0, false or an empty text."""
    return F.coalesce(~F.trim(value).isin("", "null", "0", "-0", "0.0", "false", '""'), F.lit(False))


#: The old layout's names, which bucket each became, and what else changed.
LEGACY = {"kept": "kept", "checks": "checks", "days": "days"}


def migration(state: DataFrame, legacy: DataFrame, ledger: DataFrame, owner: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """What an old layout adds to the state, and which owners are to be marked as done; owners in the ledger are left alone.

    state: (owner, bucket, k, v), values as JSON. legacy: (owner, name, blob), the old records by LEGACY's names. ledger: (owner). Names of `kept` get the prefix and
    are else kept as they are; those of `checks` stay; `days` are an array of y-m-d without padding, which is added; entries that are not made of three
    parts are passed over. An entry goes in only where the state holds none of that name (`held`; a day: where it is absent). A blob that
    cannot be read, or is neither object nor array, adds nothing, the owner's others do. Every owner of the state or the old records who is not in the ledger is
    marked, so that a second run adds nothing. Repeated entries go in once.
    """
    todo = legacy.join(ledger.select(owner), owner, "left_anti").withColumn("_v", F.try_parse_json(F.when(F.col("blob") != "", F.col("blob"))))
    entries = _members(todo.where(_shape(F.col("_v")).isin("object", "array")).select(owner, "name", "_v"), "_v")
    of = lambda name: F.col("name") == name
    part = F.split(F.try_variant_get("_value", "$", "string"), "-")
    padded = lambda i: F.lpad(part[i].cast("int").cast("string"), F.greatest(F.length(part[i].cast("int").cast("string")), F.lit(2)), F.lit("0"))
    number = F.regexp_like(F.try_variant_get("_value", "$", "string"), F.lit("^[^-]*-[0-9]{1,9}-[0-9]{1,9}$"))
    day = F.when(number, F.concat_ws("-", part[0], padded(1), padded(2)))
    listed = _shape(F.col("_v")) == "array"
    k = F.when(of("kept"), F.concat(F.lit(prefix), "_name")).when(of("checks"), F.col("_name")).when(of("days") & listed, day)
    bucket = F.coalesce(*(F.when(of(old), new) for old, new in LEGACY.items()))
    fresh = entries.select(owner, bucket.alias("bucket"), k.alias("k")).where("bucket IS NOT NULL AND k IS NOT NULL").distinct()
    there = state.where((F.col("bucket") == "days") | held(F.col("v"))).select(owner, "bucket", "k")
    added = fresh.join(there, [owner, "bucket", "k"], "left_anti").withColumn("v", F.lit("1"))
    done = state.select(owner).union(legacy.select(owner)).distinct().join(ledger.select(owner), owner, "left_anti")
    return added, done


def with_entries(state: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """The state with the entries put in; an entry of the same keys that was there gives way."""
    return state.join(added.select(*keys), keys, "left_anti").unionByName(added.select(*state.columns))


def imported(mine: DataFrame, theirs: DataFrame, longest: list[str], present: list[str]) -> DataFrame:
    """A record and one that is read in, as rows (bucket, k, v), merged: all keys of both, with column added for those that theirs brought.

    An entry of mine stays where it is `held`; a missing, null, 0, false or empty one gives way to theirs and counts as added. In the buckets `present`
    it is enough that mine is there; in `longest`, too, but the longer value stays, of equal lengths mine. Nothing is dropped.
    """
    both = mine.select("bucket", "k", "v", F.lit(True).alias("_mine")).unionByName(theirs.select("bucket", "k", "v", F.lit(False).alias("_mine")))
    keeps = F.col("bucket").isin(longest + present) | held(F.col("v"))
    weight = F.when(F.col("bucket").isin(longest), F.length(F.coalesce("v", F.lit("")))).when(F.col("_mine"), F.when(keeps, 2).otherwise(0)).otherwise(1)
    grouped = both.groupBy("bucket", "k").agg(F.max_by("v", F.struct(weight, "_mine")).alias("v"), F.bool_or(~F.col("_mine")).alias("_theirs"), F.bool_or(F.col("_mine") & keeps).alias("_kept"))
    return grouped.select("bucket", "k", "v", (F.col("_theirs") & ~F.col("_kept")).alias("added"))
