"""Uniform shuffle of rows into shards of exact sizes.

Shards are cut into cells, ranges of slots.  How many rows of each input partition go to each cell is a
communication matrix with fixed margins, drawn from the multivariate hypergeometric law: halves of the
partitions share out the cells' room again and again, down to single partitions.  Every halving has a
random stream of its own, so each task draws its own row of the matrix (and where its rows begin in the
cells) from the partitions' sizes alone; the matrix is nowhere held as a whole.  Then rows are permuted
within their partition to fill that row of the matrix, exchanged by cell, and permuted within the cell.
Given the partitions' order, all assignments are equally likely.

Shard sizes differ by one row at most, whatever keys, texts or sources repeat.  The driver holds one
number an input partition; the rows go through one exchange.  Rows are numbered by partition and place, and
written with their numbers first: counts and assignments are of the same partitions, however they are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.shared import fresh, numbered

#: Slots of a cell, as far as MOST_CELLS allows (a task draws that many numbers some twenty times); larger cells only
#: make the sort within a cell spill.
CELL_ROWS = 2_000
MOST_CELLS = 1 << 16
#: Up to so many rows numpy draws the multivariate law.
NUMPY_ROWS = 10**9 - 1
PLACE = (1 << 33) - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of the drawn are good. Exact for any sizes: rejection under a hat for log-concave laws."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    fixed = math.lgamma(good + 1) + math.lgamma(bad + 1) + math.lgamma(drawn + 1) + math.lgamma(good + bad - drawn + 1) - math.lgamma(good + bad + 1)

    def log_p(k: int) -> float:
        return fixed - math.lgamma(k + 1) - math.lgamma(good - k + 1) - math.lgamma(drawn - k + 1) - math.lgamma(bad - drawn + k + 1)

    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    top = math.exp(log_p(mode))
    wide = 1 + top / 2
    while True:
        u, v, w = rng.random(3)
        if u <= wide / (1 + wide):
            y = v * wide / top
        else:
            y = (wide - math.log(1 - v)) / top
        k = mode + (round(y) if rng.random() < 0.5 else -round(y))
        if low <= k <= high and w * min(1.0, math.exp(wide - top * y)) <= math.exp(log_p(k)) / top:
            return k


def share(rng: np.random.Generator, room: np.ndarray, drawn: int) -> np.ndarray:
    """Of each cell's room, how much the drawn rows take."""
    if room.sum() <= NUMPY_ROWS:
        return rng.multivariate_hypergeometric(room, drawn, method="marginals")
    out, left = np.zeros_like(room), int(room.sum())
    for k, cell in enumerate(room.tolist()):
        left -= cell
        out[k] = hypergeometric(rng, cell, left, drawn)
        drawn -= int(out[k])
    return out


def matrix_row(sizes: np.ndarray, room: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Rows of one partition for each cell, as every task would draw them."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        left = share(np.random.default_rng([seed, low, high]), room, int(total[middle] - total[low]))
        low, high, room = (low, middle, left) if partition < middle else (middle, high, room - left)
    return room


def even(rows: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return rows // parts + (np.arange(parts) < rows % parts).astype(np.int64)


def shuffle_to_shards(rows: DataFrame, shards: int, seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All columns and rows, with the shard (from 0) and the slot in it (from 0, without gaps).

    Columns of these names are replaced, others may have any name.  An empty input gives an empty output.  Rows are
    dealt by their places alone, so nulls, ties and long texts make no difference; repeated rows are rows of their own.
    """
    rows = rows.drop(shard, slot)
    place, source, cell = (fresh([*rows.columns, shard, slot], c) for c in ("place", "source", "cell"))
    rows = numbered(rows, place)
    rows = rows.withColumn(source, F.shiftright(place, 33).cast("int"))
    counts = rows.groupBy(F.col(source).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = np.zeros(max((r.p for r in counts), default=0) + 1, np.int64)
    for r in counts:
        sizes[r.p] = r.n
    total = int(sizes.sum())
    per_shard = even(total, shards)
    cells = max(1, min(MOST_CELLS // shards, -(-int(per_shard[0]) // CELL_ROWS)))
    room = np.concatenate([even(int(n), cells) for n in per_shard])

    @F.pandas_udf("int")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, labels = -1, None
        for partition, places in batches:
            source, at = partition.to_numpy(), places.to_numpy() & PLACE
            out = np.empty(len(source), np.int32)
            for own in np.unique(source).tolist():  # a task may read several partitions' rows
                if own != held:
                    labels = np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(sizes, room, own, seed))
                    np.random.default_rng([seed, own]).shuffle(labels)
                    held = own
                mine = source == own
                out[mine] = labels[at[mine]]
            yield pd.Series(out)

    dealt = rows.withColumn(cell, deal(source, place))
    inside = Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed), place), place)
    own, number = F.floor(F.col(cell) / F.lit(cells)).cast("int"), F.col(cell) % F.lit(cells)
    size = F.lit(total // shards) + F.when(own < total % shards, 1).otherwise(0)
    first = number * F.floor(size / F.lit(cells)) + F.least(number, size % F.lit(cells))  # slots of the shard's cells before
    return dealt.withColumns({shard: own, slot: (first + F.row_number().over(inside) - 1).cast("long")}).drop(cell, place, source)
