"""Matching: the relation a query's parts yield, and its algebra.

``Hits`` holds the matched cells (token, doc_id, ct, tf, len, positions), the documents matched by links, and what
spelling changed. Everything is lazy; positions are read only by the plans that use them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.index import Index

CELLS = ["token", "doc_id", "ct", "tf", "len", "positions"]


@dataclass
class Hits:
    cells: DataFrame
    links: DataFrame
    corrections: dict[str, str] = field(default_factory=dict)

    def docs(self) -> DataFrame:
        """(doc_id) of all matched documents."""
        return self.cells.select("doc_id").unionByName(self.links.select("doc_id")).distinct()


def nothing(index: Index) -> Hits:
    return Hits(index.postings.select(*CELLS).limit(0), _no_links(index))


def _no_links(index: Index) -> DataFrame:
    return index.citations.select(F.col("src").alias("doc_id")).limit(0)


def token_condition(tokens: list[str]):
    """A condition on index tokens: equal to one of the tokens, or beginning as one ending in * does. Pushed to the scan."""
    exact = [t for t in tokens if not t.endswith("*")]
    cond = F.col("token").isin(exact)
    for t in tokens:
        if t.endswith("*"):
            cond = cond | F.col("token").startswith(t[:-1])
    return cond


def match_tokens(index: Index, tokens: list[str]) -> Hits:
    """Documents with any of the tokens: one scan, since equal cells of several tokens are the same cell."""
    if not tokens:
        return nothing(index)
    return Hits(index.postings.filter(token_condition(tokens)).select(*CELLS), _no_links(index))


def match_link(index: Index, doc_id: int) -> Hits:
    """Documents that cite a document."""
    links = index.citations.filter(F.col("dst") == doc_id).select(F.col("src").alias("doc_id")).distinct()
    return Hits(index.postings.select(*CELLS).limit(0), links)


def match_phrase(index: Index, tokens: list[str], strict: bool = False) -> Hits:
    """Documents in which neighbouring tokens follow each other in a zone.

    Each token is checked against the one before it: a cell stays if some position of it is one more than some
    position of the former token's cells that stayed, in the same zone. A cell that stays keeps all its positions
    (strict keeps only those that continue the phrase), and the first token keeps all its zones.
    """
    if not tokens:
        return nothing(index)
    steps = [match_tokens(index, [t]).cells for t in tokens]
    kept = [steps[0]]
    last = steps[0]
    for cells in steps[1:]:
        # one array of positions per document and zone: a prefix may match several tokens
        before = last.groupBy("doc_id", "ct").agg(F.flatten(F.collect_list("positions")).alias("before"))
        both = cells.join(before, ["doc_id", "ct"])
        follow = F.array_intersect(F.transform("before", lambda p: p + 1), "positions")
        if strict:
            last = both.withColumn("positions", F.sort_array(follow)).filter(F.size("positions") > 0).withColumn("tf", F.size("positions")).select(*CELLS)
        else:
            last = both.filter(F.size(follow) > 0).select(*CELLS)
        kept.append(last)
    out = kept[0]
    for cells in kept[1:]:
        out = out.unionByName(cells)
    if len(kept) > 1:
        out = out.join(last.select("doc_id").distinct(), "doc_id", "left_semi")
    return Hits(out.select(*CELLS).distinct(), _no_links(index))


def latest(*parts: DataFrame) -> DataFrame:
    """Cells of all parts; where several hold a (token, document), all its zones come from the last of them."""
    told = None
    for n, cells in enumerate(parts):
        one = cells.withColumn("part", F.lit(n))
        told = one if told is None else told.unionByName(one)
    w = Window.partitionBy("token", "doc_id")
    return told.withColumn("top", F.max("part").over(w)).filter("part = top").select(*CELLS)


def union(*parts: Hits) -> Hits:
    """The cells of all parts, the last winning, and their links."""
    cells = latest(*[p.cells for p in parts])
    links = parts[0].links
    for p in parts[1:]:
        links = links.unionByName(p.links)
    corrections = {k: v for p in parts for k, v in p.corrections.items()}
    return Hits(cells, links.distinct(), corrections)


def _within(hits: Hits, docs: DataFrame, how: str) -> Hits:
    return Hits(hits.cells.join(docs, "doc_id", how), hits.links.join(docs, "doc_id", how), hits.corrections)


def _meeting(left: Hits, right: Hits) -> DataFrame:
    """(doc_id) of the meeting of both sides, in which empty sets are ignored: that of cells, that of links, and then of the two.

    One aggregation tells for each document in which of the four sets it is, and one row over it which sets and meetings are
    empty, so nothing runs while a query is compiled.
    """
    sets = {"cl": left.cells, "cr": right.cells, "ll": left.links, "lr": right.links}
    told = None
    for name, df in sets.items():
        one = df.select("doc_id", *[F.lit(name == x).alias(x) for x in sets])
        told = one if told is None else told.unionByName(one)
    flags = told.groupBy("doc_id").agg(*[F.bool_or(x).alias(x) for x in sets])
    any_of = [F.coalesce(F.bool_or(x), F.lit(False)).alias(f"any_{x}") for x in sets]
    any_of += [F.coalesce(F.bool_or(F.col(f"{x}l") & F.col(f"{x}r")), F.lit(False)).alias(f"any_{x}") for x in ("c", "l")]
    every = flags.join(F.broadcast(flags.agg(*any_of)), F.lit(True))  # one row

    def meet(a: Column, b: Column, any_a: Column, any_b: Column) -> Column:
        return F.when(any_a & any_b, a & b).when(any_a, a).otherwise(b)

    col = F.col
    cells, links = (meet(col(f"{x}l"), col(f"{x}r"), col(f"any_{x}l"), col(f"any_{x}r")) for x in ("c", "l"))
    some = [F.when(col(f"any_{x}l") & col(f"any_{x}r"), col(f"any_{x}")).otherwise(col(f"any_{x}l") | col(f"any_{x}r")) for x in ("c", "l")]
    return every.filter(meet(cells, links, *some)).select("doc_id")


def both(left: Hits, right: Hits, strict: bool = False) -> Hits:
    """Documents of both sides. An empty side is ignored, as is an empty meeting of cells or of links, unless strict."""
    docs = left.docs().join(right.docs(), "doc_id", "left_semi") if strict else _meeting(left, right)
    return _within(union(left, right), docs, "left_semi")


def without(left: Hits, right: Hits) -> Hits:
    """Documents of the left side that the right side does not match."""
    return _within(left, right.docs(), "left_anti")
