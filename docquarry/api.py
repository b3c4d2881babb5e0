"""The engine's facade: index, load, search, format, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.snippets import formatted_column
from docquarry.operators import evaluation, feedback, index, pagerank, ranking
from docquarry.operators.index import Index
from docquarry.operators.matching import Hits
from docquarry.plans.ast import Boolean, LinkTo, Query
from docquarry.plans.compiler import Options, compile_query
from docquarry.plans.parser import parse
from docquarry.session import passing_shuffles, remove_path, scratch_path, ship


def corrections(hits: Hits) -> DataFrame:
    """One row: what spelling changed, as (original, corrected), of the tokens that are matched. At most one per token of the query."""
    pairs = [F.struct(F.lit(old).alias("original"), F.lit(new).alias("corrected")) for new, old in sorted(hits.corrections.items())]
    every = F.array(*pairs).cast("array<struct<original:string,corrected:string>>")
    found = hits.cells.filter(F.col("token").isin(list(hits.corrections))).agg(F.collect_set("token").alias("found"))
    return found.select(F.filter(every, lambda p: F.array_contains("found", p["corrected"])).alias("corrections"))


class Engine:
    """A search engine over one index. ``Engine.index`` builds and stores it, ``Engine.load`` opens a stored one."""

    def __init__(self, spark: SparkSession, tables: Index, options: Options = Options()):
        self.spark, self.tables, self.options = ship(spark), tables, options

    @classmethod
    def index(cls, docs: DataFrame, path: str, stop_words: frozenset[str] = frozenset(), stem: bool = True, compress: bool = True, cf_mode: str = "zones", options: Options = Options()) -> Engine:
        """Builds the index of documents with PageRank, stores it below path and opens it."""
        spark = ship(docs.sparkSession)
        with passing_shuffles(spark):
            at = scratch_path(spark, "docs")
            docs.write.parquet(at)
            docs = spark.read.schema(docs.schema).parquet(at)
            ranks = pagerank.pagerank(docs, index.build_citations(docs))
            odd = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
            built = index.build(docs, stop_words, stem, cf_mode, ranks, written=True, local=odd.isEmpty())
            codec = "zstd" if compress else "none"
            index.save(built, path, codec, [x for x in index.KEYS if x != "postings"])
            remove_path(spark, at)  # room for the postings, which come from tables of their own
            index.save(built, path, codec, ["postings"])
        return cls.load(spark, path, stop_words, stem, options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, stop_words: frozenset[str] = frozenset(), stem: bool = True, options: Options = Options()) -> Engine:
        return cls(spark, index.load(spark, path, stop_words, stem), options)

    def parse(self, text: str) -> Query:
        return parse(text, self.tables.stop_words)

    def match(self, query: str | Query) -> Hits:
        """The unranked result, with the spelling corrections."""
        return compile_query(self.parse(query) if isinstance(query, str) else query, self.tables, self.options)

    def rank(self, query: str | Query, k: int) -> tuple[DataFrame, Hits]:
        """(rank, doc_id, score) and the matches they rest on. Boolean and link queries give the most recent documents."""
        query = self.parse(query) if isinstance(query, str) else query
        hits = self.match(query)
        if isinstance(query, Boolean | LinkTo):
            return ranking.most_recent(self.tables, hits, k), hits
        ranked = ranking.top(ranking.score(self.tables, hits, k, None, self.options.nan_empty_zone), k)
        if not query.prf:
            return ranked, hits
        # one round of feedback: only the first results' snippets are gathered, at most prf of them
        shown = feedback.snippets(ranked.filter(F.col("rank") <= query.prf), hits.cells, self.tables.contents)
        terms = feedback.frequent_terms(shown, "snippet", self.tables.stop_words, order=self.options.prf_order)
        more = [r["token"] for r in terms.collect() if not query.contains(r["token"])]
        first = hits.cells.join(ranked.select("doc_id"), "doc_id", "left_semi").select("token").distinct()
        original = [r["token"] for r in first.collect()]  # the query's index tokens
        hits = self.match(query.extended(more))
        return ranking.top(ranking.score(self.tables, hits, k, original, self.options.nan_empty_zone), k), hits

    def search(self, query: str | Query, k: int = 10) -> DataFrame:
        """(rank, doc_id, score, title, abstract, snippet, tokens, corrections), best first; corrections are the same in every row."""
        ranked, hits = self.rank(query, k)
        shown = feedback.snippets(ranked, hits.cells, self.tables.contents)
        return shown.join(F.broadcast(corrections(hits)), F.lit(True)).orderBy("rank")  # one row

    def formatted(self, query: str | Query, k: int = 10) -> DataFrame:
        """(rank, text): the printed results, best first."""
        ranked, hits = self.rank(query, k)
        rows = ranked.join(self.tables.contents, "doc_id", "left")
        rows = rows.join(feedback.grouped_hits(hits.cells, ranked, "Title", "title_hits"), "doc_id", "left")
        rows = rows.join(feedback.grouped_hits(hits.cells, ranked, "Abstract", "hits"), "doc_id", "left")
        return rows.select("rank", formatted_column("doc_id", "title", "abstract", "title_hits", "hits").alias("text")).orderBy("rank")

    def format(self, query: str | Query, k: int = 10) -> list[str]:
        """The printed results, at most k of them (k must not be negative)."""
        if k < 0:
            raise ValueError("printing all results needs formatted()")
        return [r["text"] for r in self.formatted(query, k).collect()]

    def ndcg(self, gold: list[str], results: list[str], p: int) -> float | None:
        """NDCG at p of printed results, whose first seven characters are their numbers, against gold numbers."""
        table = lambda ids: self.spark.createDataFrame([(k, i) for k, i in enumerate(ids, 1)], "rank int, doc_id string")
        return evaluation.ndcg(table([g[:7] for g in gold]), table([r[:7] for r in results]), p).first()["ndcg"]
