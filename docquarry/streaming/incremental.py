"""Incremental indexing: new documents of a stream are appended to a stored index's postings and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators import index
from docquarry.session import list_path


def index_stream(docs: DataFrame, path: str, checkpoint: str, stop_words: frozenset[str] = frozenset(), stem: bool = False) -> StreamingQuery:
    """Starts a query that, for each micro-batch of documents, appends postings, doc_len, contents and citations.

    Each batch writes to a folder of its own number and replaces it when it runs again, so a batch
    repeated after a failure adds nothing twice. With its documents a batch writes what it changes in the lexicon: the counts of its own
    cells less those of the cells that its documents had before. ``read`` gives the tables with their statistics.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, one = batch.sparkSession, batch.dropDuplicates(["doc_id"])
        zoned = index.zone_tokens(one)
        doc_len = index.build_doc_len(zoned)
        tables = {
            "postings": index.build_postings(index.occurrences(zoned, stop_words, stem)),
            "doc_len": doc_len,
            "contents": index.build_contents(one),
            "citations": index.build_citations(one),
            "doc_map": index.build_doc_map(one, doc_len),
            "docs": one.select("doc_id", "file_id"),
        }
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        counts = index.build_lexicon(spark.read.parquet(f"{path}/postings/batch={number}"))
        if any(int(name.split("=")[1]) < number for name in list_path(spark, f"{path}/docs") if "=" in name):
            again = spark.read.parquet(f"{path}/docs/batch={number}").select("doc_id")
            former = _current(spark, path, F.col("batch") < number)("postings").join(again, "doc_id", "left_semi")
            less = index.build_lexicon(former).select("token", (-F.col("cf")).alias("cf"), (-F.col("df")).alias("df"))
            counts = counts.unionByName(less).groupBy("token").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
        counts.write.mode("overwrite").parquet(f"{path}/lexicon/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, path: str, batches: Column):
    """Reader of a table's rows of each document's last batch among some."""
    last = spark.read.parquet(f"{path}/docs").filter(batches).groupBy("doc_id").agg(F.max("batch").alias("batch"))

    def current(name: str, key: str = "doc_id") -> DataFrame:
        raw = spark.read.parquet(f"{path}/{name}").filter(batches)
        return raw.join(last.withColumnRenamed("doc_id", key), [key, "batch"], "left_semi").drop("batch")

    return current


def read(spark: SparkSession, path: str, stop_words: frozenset[str] = frozenset(), stem: bool = False) -> index.Index:
    """The index of all batches so far; a document that came again counts with its last batch.

    The lexicon is the sum of what each batch has changed in it, so postings are not counted again.
    """
    current = _current(spark, path, F.lit(True))
    changes = spark.read.parquet(f"{path}/lexicon").groupBy("token").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    lexicon = changes.filter("df > 0")
    return index.Index(
        current("postings"), current("doc_len"), lexicon, index.build_stats(lexicon, current("docs")), current("doc_map"), current("contents"),
        current("citations", "src"), stop_words, stem,
    )
