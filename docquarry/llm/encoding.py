"""Problem 7: encoding of the whole corpus with a byte-level BPE tokenizer, and decoding.

One narrow stage without a shuffle: each Arrow batch goes through ``bytebpe`` in slices of bounded
bytes, so a worker's memory depends on neither the batch nor the partition.

Defined results: null and empty texts give the empty list (0 tokens); rows repeat as they come;
a null id stays null; an empty table gives an empty table; other columns are never read, so their
names cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, UTF-8 buffer, byte offsets) with at most SLICE_BYTES each, or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # a null has no bytes of its own after this
        texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to, data[: offsets[to]], offsets[at : to + 1]
        at = to


def send(spark: SparkSession, ranks: str) -> None:
    """Sends the rank file of the driver to the executors, which need no copy of their own. A path that only they have stays theirs."""
    if os.path.exists(ranks):
        spark.sparkContext.addFile(ranks)


def received(ranks: str) -> str:
    """On an executor, where a rank file lies."""
    sent = SparkFiles.get(os.path.basename(ranks))
    return sent if os.path.exists(sent) else ranks


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def encode(df: DataFrame, key: str, text: str, ranks: str = DEFAULT_RANKS, offsets: bool = False) -> DataFrame:
    """(key, ids): the ids of each text. With offsets also (starts): the byte of the text at which each id begins."""
    kind = df.schema[key].dataType.simpleString()
    send(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docquarry.llm.bytebpe import tokenizer

        bpe = tokenizer(received(ranks))
        for batch in batches:
            for a, b, data, off in _slices(batch.column(1)):
                ids, per_text, begin, per_piece = bpe.encode(data, off)
                out = [batch.column(0).slice(a, b - a), _lists(ids, per_text)]
                if offsets:
                    out.append(_lists(bpe.id_starts(ids, per_text, off), per_text))
                yield pa.RecordBatch.from_arrays(out, ["key", "ids", "starts"][: len(out)])

    schema = f"key {kind}, ids array<int>" + ", starts array<int>" * offsets
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(key, n_tokens int): the number of ids of each text, without moving the ids to the JVM."""
    kind = df.schema[key].dataType.simpleString()
    send(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docquarry.llm.bytebpe import tokenizer

        bpe = tokenizer(received(ranks))
        for batch in batches:
            for a, b, data, off in _slices(batch.column(1)):
                _, per_text, _, _ = bpe.encode(data, off, counts_only=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(per_text).astype(np.int32))], ["key", "n_tokens"]
                )

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens int")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, ranks: str = DEFAULT_RANKS, starts: str | None = None) -> DataFrame:
    """(key, text): the texts of id lists; the inverse of ``encode``. A null or empty list gives the empty text.

    starts: the column of the offsets that ``encode`` retained; each id's bytes are laid there.
    """
    kind = df.schema[key].dataType.simpleString()
    send(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docquarry.llm.bytebpe import tokenizer

        bpe = tokenizer(received(ranks))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat, n = zip(*((c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy()) for c in (x.fill_null([]) for x in part.columns[1:])))
                yield pa.RecordBatch.from_arrays([part.column(0), bpe.decode(flat[0], n[0], *flat[1:])], ["key", "text"])

    columns = [F.col(ids).alias("ids"), *([F.col(starts).alias("starts")] if starts else [])]
    out = df.select(F.col(key).alias("key"), *columns).mapInArrow(run, f"key {kind}, text string")
    return out.withColumnRenamed("key", key)
