"""PageRank over the citation graph, as iterated joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import materialize

#: Fixed values.
DAMPING, ITERATIONS = 0.85, 45
#: Iterations between written tables, which cut the lineage.
EVERY = 5


def pagerank(docs: DataFrame, citations: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, page_rank) of all documents.

    A link weighs 1 / the number of all citations of its document, those that leave the collection included; what
    leaves, and what documents without citations hold, is lost. Links are pre-aggregated per pair. Every document also has a link of weight 0 to
    itself, so the sums hold all documents, and an iteration is one join and one aggregation. The sums are combined before
    their shuffle, so a document that a third of all cite is no hot key; sources are spread by their own numbers.
    """
    nodes = docs.select(F.col("doc_id").alias("id")).distinct()
    degree = citations.groupBy("src").agg(F.count("*").alias("degree"))
    inside = citations.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").join(nodes.withColumnRenamed("id", "src"), "src", "left_semi")
    edges = inside.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("w"))
    edges = materialize(edges.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))), "edges")
    nodes = materialize(nodes, "nodes")
    n = nodes.count()
    if not n:
        return nodes.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("page_rank"))
    # kept in the partitioning and order of the join, so an iteration shuffles only the sums
    edges = edges.repartition("src").sortWithinPartitions("src").persist()
    rest = (1 - damping) / n
    ranks = nodes.select("id", F.lit(1.0 / n).alias("r"))
    for k in range(iterations):
        sums = edges.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("w") * F.col("r")).alias("s"))
        ranks = sums.select(F.col("dst").alias("id"), (F.col("s") + rest).alias("r"))
        if k % EVERY == EVERY - 1 or k == iterations - 1:
            ranks = materialize(ranks, "ranks")
    edges.unpersist()
    return ranks.select(F.col("id").alias("doc_id"), F.col("r").alias("page_rank"))
