"""Problem 1: frequency of every distinct term, kept by incremental signed deltas.

Counts are a persistent table per field, partitioned by a hash of the term. A batch of changes is a feed of signed rows: rows
taken away (-1), rows added (1), and the rows that changed records keep (0), which decide whether a record
held a term before and holds it now. Only these are aggregated, into signed changes of occurrences and record counts per
term, and merged into the partitions that hold a changed term; the others stay as they lie. Loading everything is the
delta from nothing.

Defined results: null terms and terms of null keys do not count as records; a key may have any
number of rows, which together are one record; repeated rows add occurrences but no records; an
empty table gives no counts. Terms whose counts fall to zero leave the table.
"""

from __future__ import annotations

import json
from fractions import Fraction
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import list_path, materialize, read_text, remove_path, scratch_path, write_text

#: Partitions of a store, set when it is made. One of them should fit a task.
BUCKETS = 32
#: Versions that a store keeps, the current one included, so that readers of the last can end.
KEPT = 2
RARE_RECORDS = 2
COMMON_SHARE = 0.3


def changed_keys(before: DataFrame, after: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys whose rows differ: added, deleted, or with another multiset of contents.

    A record's fingerprint is the sum of its rows' 64-bit hashes and their number, so rows are
    pre-aggregated before the shuffle and their order does not matter.
    """

    def prints(df: DataFrame, sign: int) -> DataFrame:
        h = F.xxhash64(*[F.to_json(F.struct(c)) for c in content])
        parts = [F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF)]  # halves: their sums cannot overflow
        return df.filter(F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.lit(sign).alias("n"), *[(p * sign).alias(f"h{k}") for k, p in enumerate(parts)]
        )

    both = prints(before, -1).unionByName(prints(after, 1))
    sums = both.groupBy("key").agg(F.sum("n").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
    return sums.filter("n <> 0 OR h0 <> 0 OR h1 <> 0").select("key")


Changes = list[tuple[DataFrame, int]]


def signed_deltas(changes: Changes, key: str, terms: Column) -> DataFrame:
    """(term, d_occurrences bigint, d_records bigint) of a feed of (rows, sign).

    terms: an array column over the content columns. Occurrences count every row; a record counts once
    per term whatever its rows, and is held before if a row of sign -1 or 0 has the term, now if one of 0 or 1 has it.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            x.filter(F.col(key).isNotNull()).select(
                F.col(key).alias("key"), F.explode(terms).alias("term"), F.lit(sign).cast("bigint").alias("sign")
            )
            for x, sign in changes
        ],
    ).filter(F.col("term").isNotNull())
    per_record = rows.groupBy("key", "term").agg(
        F.sum("sign").alias("d"), (F.max("sign") >= 0).cast("bigint").alias("now"), (F.min("sign") <= 0).cast("bigint").alias("was")
    )
    per_term = per_record.groupBy("term").agg(F.sum("d").alias("d_occurrences"), F.sum(F.col("now") - F.col("was")).alias("d_records"))
    return per_term.filter("d_occurrences <> 0 OR d_records <> 0")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, content: list[str]) -> Changes:
    """The feed between two versions of a table, where no feed is delivered: all rows of the keys that differ."""
    keys = changed_keys(before, after, key, content)
    return [(x.join(keys, x[key] == keys["key"], "left_semi"), sign) for x, sign in ((before, -1), (after, 1))]


def arrivals(there: DataFrame, arrived: DataFrame, key: str) -> Changes:
    """The feed of rows that arrive in a table: they, and the rows that their records have already."""
    keys = arrived.select(F.col(key).alias("changed")).distinct()
    return [(arrived, 1), (there.join(keys, F.col(key) == F.col("changed"), "left_semi"), 0)]


class CountStore:
    """Counts of several fields below a path, which a later application may open again.

    A step writes a folder of its own with the partitions it changes, then a manifest naming the folder of every partition
    and the number of records. A version counts from its manifest on and is never changed, so a lost executor or a failed step leaves the last
    version readable, and the step is done again. Folders that the last KEPT manifests don't name are removed. One step at a time may run on a field.
    """

    def __init__(self, spark, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "term-counts")

    def fields(self) -> list[str]:
        return [f for f in list_path(self.spark, self.path) if self._versions(f)]

    def _versions(self, field: str) -> list[int]:
        names = list_path(self.spark, f"{self.path}/{field}/manifests")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, field: str, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/{field}/manifests/{version}.json"))

    def manifest(self, field: str) -> dict | None:
        """The current manifest of a field (version, records, buckets, type, parts: partition to version), or None before its first load."""
        versions = self._versions(field)
        return self._manifest(field, versions[-1]) if versions else None

    def records(self, field: str) -> int:
        now = self.manifest(field)
        return now["records"] if now else 0

    def counts(self, field: str, manifest: dict | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """(term, occurrences, records) of a field or of some of its partitions, or None before its first load."""
        now = manifest or self.manifest(field)
        if now is None:
            return None
        schema = f"term {now['type']}, occurrences bigint, records bigint"
        chosen = [f"{self.path}/{field}/v{v}/bucket={b}" for b, v in now["parts"].items() if parts is None or int(b) in parts]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def load(self, field: str, rows: DataFrame, key: str, terms: Column) -> None:
        """The first load of a field: the delta from nothing."""
        self.apply(field, [(rows, 1)], key, terms)

    def apply(self, field: str, changes: Changes, key: str, terms: Column) -> None:
        """Merges a feed of signed rows, which must follow the version stored, into the counts.

        For every record with an added or removed row the feed must hold all its rows.
        """
        now = self.manifest(field)
        buckets = now["buckets"] if now else self.buckets
        deltas = signed_deltas(changes, key, terms)
        kind = deltas.schema["term"].dataType.simpleString()
        new = deltas.select(
            F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"),
            "term", F.col("d_occurrences").alias("occurrences"), F.col("d_records").alias("records"),
        )
        parts = dict(now["parts"]) if now else {}
        if parts:
            new = materialize(new, "deltas")
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most one per partition of the store
            old = self.counts(field, now, touched).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
            both = new.unionByName(old).repartition("bucket").groupBy("bucket", "term")
            new = both.agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("occurrences <> 0 OR records <> 0")
            parts = {b: v for b, v in parts.items() if int(b) not in touched}
        version = now["version"] + 1 if now else 0
        folder = f"{self.path}/{field}/v{version}"
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        parts |= {n[7:]: version for n in list_path(self.spark, folder) if n.startswith("bucket=")}
        signs = reduce(DataFrame.unionByName, [x.select(F.col(key).alias("key"), F.lit(s).alias("sign")) for x, s in changes]).filter("key IS NOT NULL")
        held = signs.groupBy("key").agg((F.max("sign") >= 0).cast("int").alias("now"), (F.min("sign") <= 0).cast("int").alias("was"))
        grown = held.agg(F.coalesce(F.sum(F.col("now") - F.col("was")), F.lit(0)).alias("n")).first()["n"]
        told = {"version": version, "records": (now["records"] if now else 0) + grown, "buckets": buckets, "type": kind, "parts": parts}
        write_text(self.spark, f"{self.path}/{field}/manifests/{version}.json", json.dumps(told))
        self._remove_old(field)

    def _remove_old(self, field: str) -> None:
        versions = self._versions(field)
        used = {v for k in versions[-KEPT:] for v in self._manifest(field, k)["parts"].values()}
        for k in versions[:-KEPT]:
            remove_path(self.spark, f"{self.path}/{field}/manifests/{k}.json")
        for name in list_path(self.spark, f"{self.path}/{field}"):
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) not in used and int(name[1:]) <= versions[-1]:
                remove_path(self.spark, f"{self.path}/{field}/{name}")

    def marked(self, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
        """(field, term, occurrences, records, band): band is rare, common or null."""
        parts = []
        for field in self.fields():
            now = self.manifest(field)
            most = floor(Fraction(str(common)) * now["records"])  # exact where the share is a whole number
            band = F.when(F.col("records").between(1, rare), "rare").when(F.col("records") > most, "common")
            parts.append(self.counts(field, now).select(F.lit(field).alias("field"), "term", "occurrences", "records", band.alias("band")))
        return reduce(DataFrame.unionByName, parts)
