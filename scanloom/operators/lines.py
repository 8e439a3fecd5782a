"""Filters over scan lines.

Two layouts: lines (row, px ARRAY) take one narrow pass without a shuffle; pixel tables (a row key, order
columns, a value) take one exchange and sort by the key.  Both give packets (row, col, b1, b2): two
neighbouring bits, col that of the first; a line of odd length ends in a packet with b2 = 0.  A line has as
many outputs as pixels, by arrival, whatever its length.  Null pixels count as 0, a null line has none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import kernel as K


def filter_lines(lines: DataFrame, taps: Sequence[str] = K.DEFAULT_TAPS, threshold: int | Column = 0, policy: str = K.REPLICATE, row: str = "row", px: str = "px") -> DataFrame:
    """Packets of a table of lines. The threshold may be a column of the table."""
    taps, policy = K.checked(taps), K.check_policy(policy)
    values = F.transform(F.coalesce(F.col(px), F.array().cast("array<int>")), lambda x: F.coalesce(x, F.lit(0)))
    n, at = F.size(px), F.col("__col")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(2)))
    own = [threshold.alias("__tv")] if isinstance(threshold, Column) else []
    pad = lines.select(F.col(row).cast("long").alias("row"), n.alias("__n"), K.padded(values, len(taps) // 2, policy).alias("__pad"), starts.alias("__at"), *own)
    pairs = pad.select("row", "__n", "__pad", F.explode("__at").alias("__col"), *["__tv"][: len(own)])
    limit = F.col("__tv") if own else threshold
    first = K.above(K.at_place(F.col("__pad"), at, taps), limit)
    second = F.when(at + 1 < F.col("__n"), K.above(K.at_place(F.col("__pad"), at + 1, taps), limit)).otherwise(F.lit(0))
    return pairs.select("row", at.cast("long").alias("col"), first.alias("b1"), second.alias("b2"))


def line_values(lines: DataFrame, taps: Sequence[str] = K.DEFAULT_TAPS, policy: str = K.REPLICATE, row: str = "row", px: str = "px") -> DataFrame:
    """row, col and the weighted sum f of every pixel."""
    taps, policy = K.checked(taps), K.check_policy(policy)
    values = F.transform(F.col(px), lambda x: F.coalesce(x, F.lit(0)))
    pad = lines.select(F.col(row).cast("long").alias("row"), K.padded(values, len(taps) // 2, policy).alias("__pad"), F.when(F.size(px) > 0, F.sequence(F.lit(0), F.size(px) - 1)).alias("__at"))
    return pad.select("row", "__pad", F.explode("__at").alias("__col")).select("row", F.col("__col").cast("long").alias("col"), K.at_place(F.col("__pad"), F.col("__col"), taps).alias("f"))


def pixel_bits(pixels: DataFrame, order: Sequence[str], taps: Sequence[str] = K.DEFAULT_TAPS, threshold: int | Column = 0, policy: str = K.REPLICATE, row: str = "row", value: str = "v") -> DataFrame:
    """row, col (place by arrival) and the bit b of every pixel of a pixel table."""
    taps, policy = K.checked(taps), K.check_policy(policy)
    half = len(taps) // 2
    line = Window.partitionBy(row).orderBy(*order)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.coalesce(F.col(value), F.lit(0))
    first, last = (F.first(v).over(whole), F.last(v).over(whole)) if policy == K.REPLICATE else (F.lit(0), F.lit(0))
    around = [F.coalesce(F.lag(v, half - k).over(line), first) for k in range(half)] + [v] + [F.coalesce(F.lead(v, k).over(line), last) for k in range(1, half + 1)]
    return pixels.select(F.col(row).alias("row"), (F.row_number().over(line) - 1).cast("long").alias("col"), K.above(K.weighted(around, taps), threshold).alias("b"))


def pair_bits(bits: DataFrame) -> DataFrame:
    """Packets of single bits (row, col, b); of an unpaired last bit b2 is 0. The places of a row are 0, 1, 2, ..."""
    col = F.col("col")
    return bits.groupBy("row", (col - col % 2).alias("col")).agg(
        F.max(F.when(F.col("col") % 2 == 0, F.col("b"))).alias("b1"), F.coalesce(F.max(F.when(F.col("col") % 2 == 1, F.col("b"))), F.lit(0)).alias("b2")
    )


def filter_pixels(pixels: DataFrame, order: Sequence[str], taps: Sequence[str] = K.DEFAULT_TAPS, threshold: int | Column = 0, policy: str = K.REPLICATE, row: str = "row", value: str = "v") -> DataFrame:
    return pair_bits(pixel_bits(pixels, order, taps, threshold, policy, row, value))


def threshold_values(values: DataFrame, threshold: int | Column, value: str = "f") -> DataFrame:
    """Adds b: whether the value is at least the threshold."""
    return values.withColumn("b", K.above(F.col(value), threshold))


def to_packets(pixels: DataFrame) -> DataFrame:
    """Raw packets (row, col, v1, v2) of pixels (row, col, v); an unpaired last pixel gets v2 = 0."""
    return pair_bits(pixels.select("row", "col", F.col("v").alias("b"))).withColumnsRenamed({"b1": "v1", "b2": "v2"})


def from_packets(packets: DataFrame, first: str = "b1", second: str = "b2", value: str = "b") -> DataFrame:
    """Two rows (row, col, value) of each packet."""
    both = F.array(F.struct(F.col("col"), F.col(first).alias(value)), F.struct((F.col("col") + 1).alias("col"), F.col(second).alias(value)))
    return packets.select("row", F.inline(both))


def to_lines(pixels: DataFrame, order: Sequence[str] = ("col",), row: str = "row", value: str = "v") -> DataFrame:
    """Lines (row, px) of a pixel table, in the given order; a line is held by one task."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return pixels.groupBy(F.col(row).alias("row")).agg(F.transform(items, lambda x: x["__v"]).alias("px"))


def to_pixels(lines: DataFrame, row: str = "row", px: str = "px") -> DataFrame:
    out = lines.select(F.col(row).alias("row"), F.posexplode(px).alias("col", "v"))
    return out.withColumn("col", F.col("col").cast("long"))


def limit_rows(table: DataFrame, rows: int, leak_packet: bool = False, row: str = "row", col: str | None = None, px: str | None = None) -> DataFrame:
    """The rows before a limit (0: no limit), before any filter.

    leak_packet lets the first packet of the next row through, as a stream does that looks at its limit too late.
    """
    if rows <= 0:
        return table
    if not leak_packet:
        return table.filter(F.col(row) < rows)
    if px:
        return table.filter(F.col(row) <= rows).withColumn(px, F.when(F.col(row) == rows, F.slice(px, 1, 2)).otherwise(F.col(px)))
    return table.filter((F.col(row) < rows) | ((F.col(row) == rows) & (F.col(col or "col") < 2)))


def segment_rows(pixels: DataFrame, order: Sequence[str], source: Sequence[str] = (), row: str = "row") -> DataFrame:
    """Adds segment: rows that come back later are new segments, as in a stream. Ordered within source."""
    w = Window.partitionBy(*source).orderBy(*order)
    change = F.coalesce((F.col(row) != F.lag(row).over(w)).cast("long"), F.lit(1))
    return pixels.withColumn("__change", change).withColumn("segment", F.sum("__change").over(w) - 1).drop("__change")
