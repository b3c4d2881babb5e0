"""Documents: adapters from tables and from patent XML files, and stop words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.nested import joined, parse

#: Which citations count.
CITED_AFTER, CITED_BEFORE, CITED_KINDS = 20110000, 20160000, ("B1", "B2")
#: The elements of the zones, below the row element.
ZONE_PATHS = {
    "title": ("us-bibliographic-data-grant", "invention-title"),
    "abstract": ("abstract", "p"),
    "claims": ("claims", "claim", "claim-text"),
    "description": ("description", "p"),
}
ROW = "us-patent-grant"
DOCS = "doc_id bigint, file_id int, title string, abstract string, claims string, description string, cites array<bigint>"


def patent_docs(patents: DataFrame) -> DataFrame:
    """One row per document number: the row loaded last (then the greatest row_id). Rows without a number are left out."""
    cols = ["file_id", "title", "abstract", "claims", "description", "cites"]
    newest = F.max_by(F.struct(*cols), F.struct("loaded_at", "row_id"))
    one = patents.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(newest.alias("d"))
    return one.select("doc_id", *[F.col(f"d.{c}").alias(c) for c in cols])


def stop_words(words: DataFrame, column: str = "word") -> frozenset[str]:
    """The cleaned stop words: blanks trimmed, lower case, nulls and empties dropped. The list is a parameter of the
    engine and small; more than 100,000 words are refused."""
    w = words.select(F.lower(F.trim(column)).alias("w")).filter("w <> ''").distinct()
    got = [r["w"] for r in w.limit(100_001).collect()]
    if len(got) > 100_000:
        raise ValueError("too many stop words")
    return frozenset(got)


def _children(tree, at: int, path: tuple[str, ...], below: list[list[int]]) -> list[int]:
    found = [at]
    for label in path:
        found = [c for k in found for c in below[k] if tree.labels[c] == label]
    return found


def stop_words_file(spark: SparkSession, path: str) -> frozenset[str]:
    """The stop words of a text file, one or more in a line."""
    lines = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word"))
    return stop_words(lines)


def grant_record(payload: str) -> tuple | None:
    """(doc_id, title, abstract, claims, description, cites) of one XML record, or None if it is not well-formed or has
    no numeric document number. All matches of a zone's path are joined without a separator. Entities are those the record's
    declaration names, and the public ones."""
    tree = parse(payload, "xml", True)
    if tree is None:
        return None
    below: list[list[int]] = [[] for _ in tree.labels]
    # the string value of an element holds the texts of all elements in it
    inside = [list(t) for t in tree.texts]
    for k in range(len(tree.labels) - 1, -1, -1):
        up = tree.parents[k]
        if up >= 0:
            below[up].insert(0, k)
            inside[up].extend(inside[k])
    value = lambda k: joined(inside[k])
    root = next((k for k, x in enumerate(tree.labels) if x == ROW), None)
    if root is None:
        return None
    number = _children(tree, root, ("us-bibliographic-data-grant", "publication-reference", "document-id", "doc-number"), below)
    if not number or not value(number[0]).strip().isdigit():
        return None
    zones = [("".join(value(k) for k in _children(tree, root, path, below)) or None) for path in ZONE_PATHS.values()]
    cites = []
    for group in ("references-cited", "us-references-cited"):
        for item in ("citation", "us-citation"):
            for d in _children(tree, root, ("us-bibliographic-data-grant", group, item, "patcit", "document-id"), below):
                f = {tree.labels[c]: value(c).strip() for c in below[d]}
                date, cited = f.get("date", ""), f.get("doc-number", "")
                if f.get("country") == "US" and f.get("kind") in CITED_KINDS and date.isdigit() and cited.isdigit():
                    if CITED_AFTER < int(date) < CITED_BEFORE:
                        cites.append(int(cited))
    return int(value(number[0]).strip()), *zones, cites


_DECLARATION = re.compile(rf"<!DOCTYPE\s+{ROW}\b[^\[>]*(?:\[.*?\]\s*)?>", re.S)


_BEGIN = re.compile(rf"<{ROW}[\s>]")


def whole_record(text: str) -> tuple[str | None, int]:
    """The record in the text before an end tag, with the declaration before it, and how many records begin there. Those before the last
    have no end."""
    begins = [m.start() for m in _BEGIN.finditer(text)]
    if not begins:
        return None, 0
    at = begins[-1]
    declared = _DECLARATION.search(text, text.rfind("</", 0, at) + 1, at)
    return f"{declared.group() if declared else ''}{text[at:]}</{ROW}>", len(begins)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(f, value): the digits of each file's name, and its text up to each end tag of a record."""
    return (
        spark.read.option("lineSep", f"</{ROW}>").option("recursiveFileLookup", "true").option("pathGlobFilter", "ipg*xml").text(path)
        .select(F.regexp_extract(F.input_file_name(), r"ipg(\d+).xml$", 1).alias("f"), "value").filter("f <> ''")
    )


def rejected_patent_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file_id int, n_records bigint, n_rejected bigint): per file, the records and those ill-formed or without a number,
    which ``read_patent_xml`` leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record, begun = whole_record(text)
                told += [(int(f), True)] * (begun - 1)
                if record:
                    told.append((int(f), grant_record(record) is None))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in told], pa.int32()), pa.array([x for _, x in told], pa.bool_())], ["file_id", "bad"])

    told = _records(spark, path).mapInArrow(run, "file_id int, bad boolean")
    return told.groupBy("file_id").agg(F.count("*").alias("n_records"), F.count_if("bad").alias("n_rejected"))


def read_patent_xml(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files ipg<digits>.xml below a folder. ``rejected_patent_xml`` counts what it leaves out.

    A file is many records, often many whole XML documents one after another, so the text source splits it at the
    records' end tags: large files are read by many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DOCS.split(",")]
        for batch in batches:
            rows = []
            for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record, _ = whole_record(text)
                got = grant_record(record) if record else None
                if got:
                    rows.append((got[0], int(f), *got[1:]))
            cols = list(zip(*rows)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return _records(spark, path).mapInArrow(run, DOCS)
