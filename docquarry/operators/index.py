"""The index as DataFrames: postings, lengths, lexicon, statistics, document map, contents, citations.

Everything is one pass over the documents plus aggregations keyed finely enough (token, document, zone) that no
stop-like token makes a hot group. Stored tables are range-partitioned and sorted by their key, so a lookup prunes
files and row groups by their minima and maxima, and a prefix reads a contiguous range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.stemmer import stem as stem_of
from docquarry.functions.text import tokens
from docquarry.schemas import ZONE_COLUMNS
from docquarry.session import materialize


@dataclass
class Index:
    """Tables of an index; see the builders below for their columns."""

    postings: DataFrame
    doc_len: DataFrame
    lexicon: DataFrame
    stats: DataFrame
    doc_map: DataFrame
    contents: DataFrame
    citations: DataFrame
    stop_words: frozenset[str] = field(default_factory=frozenset)
    stemmed: bool = False
    packed: DataFrame | None = None  # the postings as ``packed_cells``, where they were made so

    def size(self) -> int:
        """The collection size C; one row is read."""
        return self.stats.first()["c"] or 0


def zone_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ct, tokens): a row per document and zone; null and empty zones have no tokens."""
    zones = F.explode(F.array(*[F.struct(F.lit(z).alias("ct"), F.col(c).alias("text")) for z, c in ZONE_COLUMNS.items()]))
    rows = docs.select("doc_id", zones.alias("z")).select("doc_id", "z.ct", "z.text")
    return rows.select("doc_id", "ct", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("tokens"))


def _index_tokens(found: pa.DictionaryArray, stop_words: frozenset[str], stem: bool) -> tuple[np.ndarray, pa.StringArray]:
    """(codes, words): what becomes of tokens in an index, as codes of distinct words; stop words and tokens without a stem are ''."""
    made = [("" if t in stop_words else stem_of(t) if stem else t) for t in found.dictionary.to_pylist()]
    words = pa.array(made, pa.string()).dictionary_encode()
    return words.indices.to_numpy()[found.indices.to_numpy()], words.dictionary


def stemmed(zoned: DataFrame, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """Zones with stems in place of their tokens, '' for stop words and tokens without a stem, so positions and lengths stay.

    Whole arrays go to Python, where only the distinct tokens of a batch are stemmed. A column function over occurrences would keep
    the array of its zone with each of them while it waits, on disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(2)
            codes, words = _index_tokens(arrays.flatten().dictionary_encode(), stop_words, True)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(arrays).to_numpy())])
            stems = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stems], ["doc_id", "ct", "tokens"])

    return zoned.select("doc_id", "ct", "tokens").mapInArrow(run, "doc_id bigint, ct string, tokens array<string>")


#: Columns of packed cells: of one token and some documents, n cells with occ occurrences, n_docs of them the first of their document.
_PACKED = "token string, doc_id bigint, n int, occ int, n_docs int, cells binary"
#: Tokens that are grouped at once, unless one document has more; cells of a packed row; packed rows that are read at once.
_AT_ONCE, _CELLS, _ROWS = 1_000_000, 64, 2048


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): unsigned numbers as bytes of seven bits, the lowest first, and where each number ends."""
    n, rest = np.ones(len(values), np.int64), values >> np.uint64(7)
    while rest.any():
        n += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(n)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(n.max(initial=0)):
        some = np.flatnonzero(n > k)
        out[ends[some] - n[some] + k] = (values[some] >> np.uint64(7 * k) & np.uint64(127)) | np.where(n[some] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def _numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that ``_varints`` wrote."""
    if not len(data):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(data < 128)
    begins = np.append(0, ends[:-1] + 1)
    shift = (np.arange(len(data)) - np.repeat(begins, ends - begins + 1)) * 7
    return np.add.reduceat((data & 127).astype(np.uint64) << shift.astype(np.uint64), begins)


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some groups of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _pack(ids: np.ndarray, zones: list[pa.ListArray], stop_words: frozenset[str], stem: bool) -> pa.RecordBatch:
    """The packed cells of some documents: their numbers, and per zone their arrays of tokens."""
    sizes = np.stack([pc.list_value_length(z).to_numpy() for z in zones]).astype(np.int64)
    codes, words = _index_tokens(pa.concat_arrays([z.flatten() for z in zones]).dictionary_encode(), stop_words, stem)
    by_id = np.argsort(ids, kind="stable")
    ids, sizes, place = ids[by_id], sizes[:, by_id], np.argsort(by_id, kind="stable")
    row = np.concatenate([np.repeat(place, n[place]) for n in sizes])
    zone = np.repeat(np.arange(len(zones)), sizes.sum(axis=1))
    pos = np.concatenate([_within(n[place]) for n in sizes])
    kept = np.flatnonzero(pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes]) if len(codes) else np.arange(0)
    # cells in the order of their token, document and zone; positions ascend in a zone, and a stable sort leaves them so
    key = (codes[kept].astype(np.int64) * len(ids) + row[kept]) * len(zones) + zone[kept]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[kept[order]]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    tf, cell = np.diff(np.append(begins, len(key))), key[begins]
    doc, token = cell // len(zones) % len(ids), cell // (len(zones) * len(ids))
    # rows: at most so many cells of one token
    per_token = np.diff(np.append(np.flatnonzero(np.diff(token, prepend=-1)), len(token)))
    tops = np.flatnonzero(_within(per_token) % _CELLS == 0)
    n = np.diff(np.append(tops, len(token)))
    cut = lambda x: np.add.reduceat(x, tops) if len(tops) else np.zeros(0, np.int64)
    occ = cut(tf)
    # a row's numbers: documents, lengths and zones, frequencies, positions; documents and positions less the ones before
    steps = np.diff(ids[doc].astype(np.uint64), prepend=np.uint64(0))
    steps[tops] = 0
    moves = np.diff(pos, prepend=0)
    moves[begins] = pos[begins]
    base = np.cumsum(3 * n + occ) - (3 * n + occ)
    values, at, width = np.zeros(3 * len(token) + len(pos), np.uint64), np.repeat(base, n) + _within(n), np.repeat(n, n)
    values[at], values[at + width], values[at + 2 * width] = steps, sizes[cell % len(zones), doc] * len(zones) + cell % len(zones), tf
    values[np.repeat(base + 3 * n, occ) + _within(occ)] = moves
    data, ends = _varints(values)
    ends = np.append(0, ends[base + 3 * n + occ - 1])
    packed = pa.Array.from_buffers(pa.binary(), len(tops), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    new = np.diff(cell // len(zones), prepend=-1) != 0
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(token[tops])), pa.array(ids[doc[tops]], pa.int64()), *[pa.array(x, pa.int32()) for x in (n, occ, cut(new.astype(np.int64)))], packed],
        ["token", "doc_id", "n", "occ", "n_docs", "cells"],
    )


def packed_cells(docs: DataFrame, stop_words: frozenset[str] = frozenset(), stem: bool = False) -> DataFrame:
    """The postings of documents, packed: up to 64 cells of a token in a row of bytes, so that sorting them by token moves little.

    Each document is taken by itself, so nothing is shuffled: its number must not be null, and it must have no other row. Postings of
    documents with several rows are those of ``build_postings``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(sum(pc.list_value_length(z).to_numpy().astype(np.int64) for z in batch.columns[1:])) // _AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    some = batch.slice(a, b - a)
                    yield _pack(some.column(0).to_numpy(), some.columns[1:], stop_words, stem)

    zones = [F.coalesce(tokens(c), F.array().cast("array<string>")).alias(c) for c in ZONE_COLUMNS.values()]
    return docs.select("doc_id", *zones).mapInArrow(run, _PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """The postings that are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zones = pa.array(list(ZONE_COLUMNS))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                n, occ = (part.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                values = _numbers(np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8))
                base = np.cumsum(3 * n + occ) - (3 * n + occ)
                where, width = np.repeat(base, n) + _within(n), np.repeat(n, n)
                steps, told, tf = values[where], values[where + width].astype(np.int64), values[where + 2 * width].astype(np.int64)
                moves = values[np.repeat(base + 3 * n, occ) + _within(occ)].astype(np.int64)
                # sums within rows and cells: running sums less those before
                run_on = lambda x, n: (s := np.cumsum(x)) - np.repeat((s - x)[np.cumsum(n) - n], n)
                ids = np.repeat(part.column(1).to_numpy().astype(np.uint64), n) + run_on(steps, n)
                row = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), pa.array(ids.astype(np.int64)), zones.take(pa.array(told % len(zones))),
                        pa.array(tf, pa.int32()), pa.array(told // len(zones), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(run_on(moves, tf), pa.int32())),
                    ],
                    ["token", "doc_id", "ct", "tf", "len", "positions"],
                )

    return packed.mapInArrow(run, "token string, doc_id bigint, ct string, tf int, len int, positions array<int>")


def occurrences(zoned: DataFrame, stop_words: frozenset[str] = frozenset(), stem: bool = False) -> DataFrame:
    """(token, doc_id, ct, pos, len): occurrences without stop words, which still count in the positions (from 0) and in the
    length of the zone."""
    zoned = stemmed(zoned, stop_words) if stem else zoned
    rows = zoned.select("doc_id", "ct", F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "token"))
    if stem:
        rows = rows.filter("token <> ''")
    elif stop_words:
        rows = rows.filter(~F.col("token").isin(sorted(stop_words)))
    return rows.select("token", "doc_id", "ct", "pos", "len")


def build_postings(occ: DataFrame) -> DataFrame:
    """(token, doc_id, ct, tf int, len int, positions array<int>), positions ascending.

    The length of the zone is kept in each cell, so scoring joins no table of lengths.
    """
    got = occ.groupBy("token", "doc_id", "ct", "len").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return got.select("token", "doc_id", "ct", F.size("positions").alias("tf"), "len", "positions")


def build_doc_len(zoned: DataFrame) -> DataFrame:
    """(doc_id, ct, len int): tokens of each zone, stop words included."""
    return zoned.select("doc_id", "ct", F.size("tokens").alias("len"))


def build_lexicon(postings: DataFrame, cf_mode: str = "zones") -> DataFrame:
    """(token, cf bigint, df bigint). cf counts the document zones that hold the token, or its occurrences."""
    cf = {"zones": F.count("*"), "occurrences": F.sum("tf")}[cf_mode]
    return postings.groupBy("token").agg(cf.alias("cf"), F.countDistinct("doc_id").alias("df"))


def packed_lexicon(packed: DataFrame, cf_mode: str = "zones") -> DataFrame:
    """The lexicon of packed postings, whose rows know their counts."""
    cf = {"zones": "n", "occurrences": "occ"}[cf_mode]
    return packed.groupBy("token").agg(F.sum(cf).alias("cf"), F.sum("n_docs").alias("df"))


def build_stats(lexicon: DataFrame, docs: DataFrame) -> DataFrame:
    """(c bigint, n_docs bigint): one row."""
    return lexicon.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("c")).join(docs.agg(F.count("*").alias("n_docs")), F.lit(True))


def build_doc_map(docs: DataFrame, doc_len: DataFrame, page_ranks: DataFrame | None = None) -> DataFrame:
    """(doc_id, file_id, len_title, len_abstract, len_claims, len_description, page_rank); the rank is -1 where unknown."""
    lens = [F.max(F.when(F.col("ct") == z, F.col("len"))).alias(f"len_{c}") for z, c in ZONE_COLUMNS.items()]
    out = docs.select("doc_id", "file_id").join(doc_len.groupBy("doc_id").agg(*lens), "doc_id", "left")
    if page_ranks is None:
        return out.withColumn("page_rank", F.lit(-1.0))
    return out.join(page_ranks.select("doc_id", "page_rank"), "doc_id", "left").fillna(-1.0, ["page_rank"])


def build_contents(docs: DataFrame) -> DataFrame:
    """(doc_id, title, abstract); empty texts are null."""
    return docs.select("doc_id", *[F.nullif(c, F.lit("")).alias(c) for c in ("title", "abstract")])


def build_citations(docs: DataFrame) -> DataFrame:
    """(src, dst): distinct links to positive numbers."""
    links = docs.select(F.col("doc_id").alias("src"), F.explode("cites").alias("dst"))
    return links.filter("dst > 0").distinct()


def build(docs: DataFrame, stop_words: frozenset[str] = frozenset(), stem: bool = False, cf_mode: str = "zones", page_ranks: DataFrame | None = None, written: bool = False, local: bool = False) -> Index:
    """The index of documents (doc_id, file_id, title, abstract, claims, description, cites).

    written: documents, their tokens and the postings are written to the shared folder on the way, since several tables
    derive from each; without it everything is lazy, and a plan computes what it needs. local: each document has a number and one row, and is
    written already or cheap to compute; then lengths and packed postings are all that is written.
    """
    keep = materialize if written else lambda df, _: df
    if local:
        packed = keep(packed_cells(docs, stop_words, stem), "packed")
        doc_len, lexicon, postings = keep(build_doc_len(zone_tokens(docs)), "lengths"), packed_lexicon(packed, cf_mode), unpacked(packed)
    else:
        packed = None
        docs = keep(docs, "docs")
        zoned = keep(zone_tokens(docs), "zones")
        postings = keep(build_postings(occurrences(zoned, stop_words, stem)), "postings")
        doc_len, lexicon = build_doc_len(zoned), build_lexicon(postings, cf_mode)
    return Index(
        postings, doc_len, lexicon, build_stats(lexicon, docs), build_doc_map(docs, doc_len, page_ranks), build_contents(docs),
        build_citations(docs), stop_words, stem, packed,
    )


#: Sort keys of the stored tables.
KEYS = {"postings": ["token", "doc_id"], "doc_len": ["doc_id"], "lexicon": ["token"], "stats": [], "doc_map": ["doc_id"], "contents": ["doc_id"], "citations": ["dst"]}


def save(index: Index, path: str, codec: str = "zstd", names: Iterable[str] = KEYS) -> None:
    """Writes every table, or some, sorted by its key; codec none writes uncompressed. What was there is replaced. Packed postings are moved as they are."""
    for name in names:
        df, key = getattr(index, name), KEYS[name]
        if name == "postings" and index.packed is not None:
            df = unpacked(index.packed.repartitionByRange(*key)).sortWithinPartitions(*key)
        else:
            df = df.repartitionByRange(*key).sortWithinPartitions(*key) if key else df.coalesce(1)
        df.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, stop_words: frozenset[str] = frozenset(), stemmed: bool = False) -> Index:
    """The stored index of a folder; tables are read lazily."""
    got = {name: spark.read.parquet(f"{path}/{name}") for name in KEYS}
    return Index(**got, stop_words=stop_words, stemmed=stemmed)


def with_tables(index: Index, **tables: DataFrame) -> Index:
    """The index with some tables replaced, as by cached or stored ones."""
    return replace(index, **({"packed": None} if "postings" in tables else {}), **tables)


def entries(index: Index) -> DataFrame:
    """(table, entries bigint): keys of each table, as counted when an index is loaded."""
    parts = [
        ("inverted", index.lexicon.agg(F.count("*").alias("entries"))),
        ("documents", index.doc_map.agg(F.count("*").alias("entries"))),
        ("contents", index.contents.agg(F.count("*").alias("entries"))),
        ("citations", index.citations.agg(F.countDistinct("dst").alias("entries"))),
    ]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("table_name"), "entries")
        out = one if out is None else out.unionByName(one)
    return out


