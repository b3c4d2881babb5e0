"""References to records that do not exist: range-partitioned keys, sorted arrays, binary search.

Parents are reduced to one row per key (first loaded, first removed), range-partitioned by a sample of the keys, and stored as one
row of sorted arrays per range of a bounded number of keys. References are reduced before any shuffle: of all
references of one table, month, referrer and key only the earliest and latest time matter. They are
split, range by range, into batches of bounded size (so a key that a third of all rows refer to is
spread over many batches), and each batch is probed in one vectorised binary search of its
range's sorted keys, as they are stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import materialize

#: Parents per range, and references per batch.
RANGE_KEYS = 50_000
BATCH_REFERENCES = 100_000


def parents(loaded: DataFrame, key: str, at: str, removed: DataFrame, removed_key: str, removed_at: str) -> DataFrame:
    """(key, loaded_us, removed_us): when each key was first there and first taken out, in microseconds; null if never."""
    a = loaded.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("loaded_us"), F.lit(None).cast("bigint").alias("removed_us")
    )
    b = removed.filter(F.col(removed_key).isNotNull() & F.col(removed_at).isNotNull()).select(
        F.col(removed_key).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("loaded_us"), F.unix_micros(F.col(removed_at).cast("timestamp")).alias("removed_us")
    )
    return a.unionByName(b).groupBy("key").agg(F.min("loaded_us").alias("loaded_us"), F.min("removed_us").alias("removed_us"))


def references(name: str, df: DataFrame, ref: Column, key: Column, at: Column) -> DataFrame:
    """(ref_table, period, ref_id, missing_id, first_us, last_us) of one table's references, reduced.

    Rows with a null time, and null or non-positive keys, are no references; a null referrer is kept.
    """
    rows = df.select(ref.cast("bigint").alias("ref_id"), key.cast("bigint").alias("missing_id"), at.alias("at"))
    rows = rows.filter((F.col("missing_id") > 0) & F.col("at").isNotNull())
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    return rows.groupBy(
        F.lit(name).alias("ref_table"), F.date_format("at", "yyyy-MM").alias("period"), "ref_id", "missing_id"
    ).agg(F.min(micros).alias("first_us"), F.max(micros).alias("last_us"))


def store_ranges(every_parent: DataFrame, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(low, keys, loaded_us, removed_us): a row of sorted arrays for each range of parents, written to the shared folder.

    The ranges are those of a range partitioning, which samples the keys as a sort does; keys are unique, so none is hot.
    """
    kept = materialize(every_parent, "parents")
    ranges = max(1, -(-kept.count() // range_keys))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        never = np.iinfo(np.int64).max
        columns = [whole["key"].to_numpy(), *(whole[c].fill_null(never).to_numpy() for c in ("loaded_us", "removed_us"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0][:1]), *(pa.array([c], pa.list_(pa.int64())) for c in columns)], ["low", "keys", "loaded_us", "removed_us"]
        )

    ordered = kept.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    schema = "low bigint, keys array<bigint>, loaded_us array<bigint>, removed_us array<bigint>"
    return materialize(ordered.mapInArrow(arrays, schema), "ranges")


def _numbered(spark: SparkSession, lows: np.ndarray):
    """The number of the range a key lies in, by binary search of the ranges' least keys (one per RANGE_KEYS parents)."""
    sent = spark.sparkContext.broadcast(lows[1:])

    @F.pandas_udf("int")
    def of(keys):  # noqa: ANN001
        import pandas as pd

        return pd.Series(np.searchsorted(sent.value, keys.to_numpy(np.int64), "right").astype(np.int32))

    return of


def orphans(every_parent: DataFrame, refs: list[DataFrame], range_keys: int = RANGE_KEYS, batch: int = BATCH_REFERENCES) -> DataFrame:
    """(ref_table, period, ref_id, missing_id): references of which, at their time, the key was not there.

    A key is there from its first loading until its first removal. Empty parents make every
    reference an orphan; empty references give an empty table.
    """
    spark = every_parent.sparkSession
    store = store_ranges(every_parent, range_keys)
    of = _numbered(spark, np.array(sorted(r["low"] for r in store.select("low").collect()), np.int64))  # a key per range
    told = materialize(reduce(DataFrame.unionByName, refs).withColumn("range", of("missing_id")), "references")
    # a row per range, of two integers: as many as the ranges' least keys above
    parts = told.groupBy("range").agg(F.ceil(F.count("*") / batch).cast("int").alias("parts"))
    left = told.join(F.broadcast(parts), "range")
    left = left.withColumn("part", F.pmod(F.xxhash64("ref_table", "period", "ref_id", "missing_id"), F.col("parts")).cast("int"))
    copies = parts.select(F.col("range").alias("of"), F.col("parts").alias("copies"))
    right = store.withColumn("range", of("low")).join(F.broadcast(copies), F.col("range") == F.col("of"))
    right = right.select("range", "keys", "loaded_us", "removed_us", F.explode(F.expr("sequence(0, copies - 1)")).alias("part"))

    def probe(group: pa.Table, held: pa.Table) -> pa.Table:
        never = np.iinfo(np.int64).max
        k, loaded, removed = (
            np.append(held[c].combine_chunks().flatten().to_numpy() if held.num_rows else np.zeros(0, np.int64), never) for c in ("keys", "loaded_us", "removed_us")
        )
        want = group["missing_id"].to_numpy()
        at = np.searchsorted(k, want)
        missing = (k[at] != want) | (group["first_us"].to_numpy() < loaded[at]) | (group["last_us"].to_numpy() >= removed[at])
        return group.select(["ref_table", "period", "ref_id", "missing_id"]).filter(pa.array(missing))

    return (
        left.groupBy("range", "part")
        .cogroup(right.groupBy("range", "part"))
        .applyInArrow(probe, "ref_table string, period string, ref_id bigint, missing_id bigint")
    )


def per_period(missing: DataFrame) -> DataFrame:
    """(ref_table, period, n_references, n_missing): the report of orphans per table and period."""
    return missing.groupBy("ref_table", "period").agg(
        F.count("*").alias("n_references"), F.countDistinct("missing_id").alias("n_missing")
    )


def patent_references(patents: DataFrame, citations: DataFrame, doc_map: DataFrame, postings: DataFrame) -> list[DataFrame]:
    """The references of the four tables of a patent collection."""
    number = F.regexp_replace(F.col("doc_number"), "[ ,]", "")
    number = F.regexp_replace(number, "^US", "")
    number = F.when(number.rlike("^[0-9]+$"), number.try_cast("bigint"))
    cited = citations.filter(
        (F.col("country") == "US") & F.col("kind").isin("B1", "B2") & (F.col("cited_date") > 20110000) & (F.col("cited_date") < 20160000)
    )
    links = patents.select("doc_id", "loaded_at", F.explode("cites").alias("cited"))
    return [
        references("patents", links, F.col("doc_id"), F.col("cited"), F.col("loaded_at")),
        references("citations", cited, F.col("src"), number, F.col("recorded_at")),
        references("doc_map", doc_map, F.col("doc_id"), F.col("doc_id"), F.col("mapped_at")),
        references("postings", postings, F.col("doc_id"), F.col("doc_id"), F.col("indexed_at")),
    ]
