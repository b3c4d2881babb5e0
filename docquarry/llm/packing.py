"""Problem 8: filling fixed-capacity containers by hierarchical residual packing.

Round 0 runs where the items are: every partition packs its items as they stream by, CHUNK at a time, best-fit decreasing and
closes the bins that are nearly full. The bins left open go up a tree: each round gathers the open
bins of ``fan_in`` partitions, treats each as one item and packs again, until one partition holds
them. Bins too many for one task meet other partners in every round, and rounds end when one closes or joins less than LEAST_GAIN of them: what is
left cannot be joined, as two bins of more than half the capacity cannot. Only open bins move, as (bin, fill, members), and a bin has at most ``capacity`` members, so
no task sees an unbounded group. Round 0 and every later round are written to the shared folder:
a task that is run again cannot number its bins anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import materialize

CAPACITY = 4096
#: A bin is nearly full, and closed, with at most this share of its capacity unused.
SLACK = 1 / 64
FAN_IN = 16
#: Open bins that one task packs in a round.
BINS_PER_TASK = 200_000
#: Items that are packed at once in round 0.
CHUNK = 500_000
#: Rounds go on while they lessen the open bins by this share.
LEAST_GAIN = 0.01


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The bin of each item, items taken by falling size and put where the least room remains; fills of the bins.

    Open bins lie in stacks by room left; a bit mask over the rooms finds the tightest fit.
    """
    bins = np.empty(len(sizes), np.int64)
    fills: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    order = np.argsort(-sizes, kind="stable")
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
            fills[b] += size
        else:
            b, room = len(fills), capacity
            fills.append(size)
        bins[k] = b
        left = room - size
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins, fills


def pack(
    items: DataFrame, key: str, size: str, capacity: int = CAPACITY, slack: float = SLACK, fan_in: int = FAN_IN
) -> DataFrame:
    """(key, piece_no int, first_unit bigint, n_units int, container_id bigint, container_fill int).

    An item larger than the capacity is split: full containers, and a rest that is packed like any
    other item. Items of size 0, and those of null or negative size, need no room: one row each with
    piece_no 0, n_units 0 and a null container. Repeated keys are separate items. An empty table
    gives an empty table.
    """
    kind = items.schema[key].dataType.simpleString()
    floor = capacity - int(capacity * slack)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbered = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < CHUNK:
                    continue
            if held:
                table, bins = placed(pa.Table.from_batches(held), np.int64(part) << 32 | numbered)
                numbered += bins
                held = []
                yield from table.combine_chunks().to_batches(max_chunksize=100_000)

    def placed(table: pa.Table, first_bin: int) -> tuple[pa.Table, int]:
        """The pieces of some items with their bins, numbered from first_bin, and the number of bins."""
        sizes = np.maximum(table.column(1).fill_null(0).to_numpy(), 0)
        whole, rest = sizes // capacity, sizes % capacity
        n = np.where(sizes > 0, -(-sizes // capacity), 1)
        row = np.repeat(np.arange(len(sizes)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        units = np.where(piece < whole[row], capacity, rest[row])
        bins = np.full(len(row), -1, np.int64)
        fill = np.zeros(len(row), np.int64)
        open_ = (units > 0) & (units < capacity)
        where, fills = best_fit(units[open_], capacity)
        bins[open_] = where
        fill[open_] = np.array(fills, np.int64)[where]
        full = units == capacity
        bins[full] = len(fills) + np.arange(full.sum())
        fill[full] = capacity
        columns = {
            "key": table.column(0).take(pa.array(row)),
            "piece_no": pa.array(piece.astype(np.int32)),
            "first_unit": pa.array(piece * capacity),
            "n_units": pa.array(units.astype(np.int32)),
            "bin": pa.array(np.where(bins >= 0, bins + first_bin, -1)),
            "fill": pa.array(fill.astype(np.int32)),
        }
        return pa.table(columns), len(fills) + int(full.sum())

    source = items.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"))
    schema = f"key {kind}, piece_no int, first_unit bigint, n_units int, bin bigint, fill int"
    pieces = materialize(source.mapInArrow(local, schema), "packed")
    is_open = (F.col("bin") >= 0) & (F.col("fill") < floor)
    under = pieces.filter(is_open)
    bins = under.groupBy("bin").agg(F.first("fill").alias("fill")).select("bin", "fill", F.array("bin").alias("members"))
    # only items of open bins are joined; those of closed bins, and those without a bin, stay as they lie
    moved = under.join(_merge_rounds(bins, capacity, floor, fan_in), "bin", "left")
    moved = moved.withColumns({"bin": F.coalesce("new_bin", "bin"), "fill": F.coalesce("new_fill", "fill")})
    rows = pieces.filter(~is_open).unionByName(moved.drop("new_bin", "new_fill"))
    return rows.select(
        F.col("key").alias(key),
        "piece_no",
        "first_unit",
        "n_units",
        F.when(F.col("bin") >= 0, F.col("bin")).alias("container_id"),
        F.when(F.col("bin") >= 0, F.col("fill")).alias("container_fill"),
    )


def _merge_rounds(bins: DataFrame, capacity: int, floor: int, fan_in: int) -> DataFrame:
    """(bin, new_bin, new_fill) of the bins that rounds of the tree have merged; others may be absent."""

    def join_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        f = pd.concat(got, ignore_index=True).sort_values("bin", ignore_index=True)
        where, fills = best_fit(f["fill"].to_numpy(np.int64), capacity)
        g = f.groupby(where)
        yield pd.DataFrame(
            {
                "bin": g["bin"].first().to_numpy(),
                "fill": g["fill"].sum().to_numpy(np.int32),
                "members": [np.concatenate(list(x)) for _, x in g["members"]],
            }
        )

    now = materialize(bins, "open-bins")
    left, tried, done = now.count(), 0, None
    parts = max(1, -(-left // BINS_PER_TASK), now.rdd.getNumPartitions() // fan_in)
    while True:
        packed = now.repartition(parts, F.hash("bin", F.lit(tried))) if parts > 1 else now.coalesce(1)
        now = materialize(packed.mapInPandas(join_up, "bin bigint, fill int, members array<bigint>"), "open-bins")
        if parts == 1:
            return _moved(now if done is None else done.unionByName(now))
        closed = now.filter(F.col("fill") >= floor)
        done = closed if done is None else done.unionByName(closed)
        now = now.filter(F.col("fill") < floor)
        before, left = left, now.count()
        higher = max(1, min(parts, max(parts // fan_in, -(-left // BINS_PER_TASK))))
        if higher == parts and left > (1 - LEAST_GAIN) * before:
            return _moved(done.unionByName(now))
        parts, tried = higher, tried + 1


def _moved(bins: DataFrame) -> DataFrame:
    """(bin, new_bin, new_fill) of the bins of round 0 and those they ended in."""
    return bins.select(F.explode("members").alias("bin"), F.col("bin").alias("new_bin"), F.col("fill").alias("new_fill"))


def violations(packed: DataFrame, sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(n_items, n_wrong_items, n_wrong_containers): one row that proves a packing.

    An item with a unique key is wrong unless its pieces cover its units once and without a gap, and a container unless its pieces fill it as
    stated and no more than it holds.
    """
    ends = F.col("first_unit") + F.col("n_units")
    cover = packed.groupBy(key).agg(F.sum("n_units").alias("units"), F.max(ends).alias("last"), F.min("first_unit").alias("first"), F.countDistinct("first_unit").alias("starts"), F.count("*").alias("pieces"))
    right = (F.col("units") == F.col("want")) & (F.col("last") == F.col("want")) & (F.col("first") == 0) & (F.col("starts") == F.col("pieces"))
    want = sizes.select(F.col(key).alias("of"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).alias("want"))
    items = want.join(cover, F.col("of").eqNullSafe(F.col(key)), "full")
    items = items.agg(F.count("want").alias("n_items"), F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong_items"))
    holds = packed.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_units").alias("held"), F.min("container_fill").alias("low"), F.max("container_fill").alias("high"))
    fits = (F.col("held") <= capacity) & (F.col("held") == F.col("low")) & (F.col("held") == F.col("high"))
    return items.join(holds.agg(F.count_if(~fits).alias("n_wrong_containers")), F.lit(True))
