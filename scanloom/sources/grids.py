"""Sources of scan lines: seeded random grids, CSV files, embeddings and tables of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.config import Mismatch, Mode, PipelineConfig
from scanloom.functions.csv_lines import pixels, tokens
from scanloom.written import written

Source = Callable[[SparkSession, PipelineConfig], DataFrame]


Pixel = Callable[[int, Column, Column], Column]


def hashed_pixel(seed: int, row: Column, col: Column) -> Column:
    """A pixel from 0 to 255, by the engine's own hash: the fastest."""
    return F.pmod(F.xxhash64(F.lit(seed), row, col), F.lit(256)).cast("int")


def portable_pixel(seed: int, row: Column, col: Column) -> Column:
    """A pixel from 0 to 255, by integer arithmetic that any engine can follow: all values stay below 2**63."""
    word = 1 << 32
    x = F.pmod(F.pmod(row.cast("long"), F.lit(word)) * 1_000_003 + F.lit(seed % word), F.lit(word))
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * 73_244_475, F.lit(word))
    y = x + col * 40_503
    return F.shiftright(y.bitwiseXOR(F.shiftright(y, 15)) * 73_244_475, 20).bitwiseAND(F.lit(255).cast("long")).cast("int")


def random_lines(spark: SparkSession, rows: int, m: int, seed: int = 0, pixel: Pixel = hashed_pixel) -> DataFrame:
    """(row, px): uniform pixels from 0 to 255, the same for the same seed."""
    if m < 2 or m % 2:
        raise ValueError("m must be even and at least 2")
    row = F.col("id")
    px = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda c: pixel(seed, row, c))
    return spark.range(rows).select(row.alias("row"), px.alias("px"))


def random_packets(spark: SparkSession, packets: int, m: int, seed: int = 0, pixel: Pixel = hashed_pixel) -> DataFrame:
    """(row, col, v1, v2): packets of the same grid, in order."""
    if m < 2 or m % 2:
        raise ValueError("m must be even and at least 2")
    at = spark.range(packets).select(F.floor(F.col("id") / (m // 2)).alias("row"), (2 * (F.col("id") % (m // 2))).cast("int").alias("c"))
    return at.select("row", F.col("c").cast("long").alias("col"), pixel(seed, F.col("row"), F.col("c")).alias("v1"), pixel(seed, F.col("row"), F.col("c") + 1).alias("v2"))


def mismatch(m: int) -> Column:
    """What is wrong with a line (row, px) that is not m wide; null if it fits."""
    n = F.size("px")
    return F.when(n != m, F.concat(F.lit("CSV row "), F.col("row").cast("string"), F.lit(" has "), n.cast("string"), F.lit(f" values, expected {m}")))


def fit_lines(lines: DataFrame, m: int, policy: str | Mismatch = Mismatch.REJECT, short_row: str = "stop") -> DataFrame:
    """(row, px of width m) of lines (row, px) of any width.

    REJECT fails on any other width; ZERO_PAD fills short lines and cuts long ones; TRUNCATE cuts long lines and,
    at a short one, ends the data (short_row="stop") or leaves the line out ("skip"). Row numbers stay.
    """
    policy, n = Mismatch(policy), F.size("px")
    if policy is Mismatch.REJECT:
        return lines.select("row", F.when(n == m, F.col("px")).otherwise(F.raise_error(mismatch(m)).cast(lines.schema["px"].dataType)).alias("px"))
    if policy is Mismatch.ZERO_PAD:
        return lines.select("row", F.slice(F.concat("px", F.array_repeat(F.lit(0), m)), 1, m).alias("px"))
    cut = lines.filter(n >= m).select("row", F.slice("px", 1, m).alias("px"))
    if short_row == "skip":
        return cut
    stop = lines.filter(n < m).agg(F.min("row").alias("__stop"))
    return cut.join(F.broadcast(stop)).filter(F.col("__stop").isNull() | (F.col("row") < F.col("__stop"))).select("row", "px")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, line): the lines of a text file, or of a folder's files by name, from 0; blank lines are lines, only the last line break ends none.

    Files are split as usual.  A line's number is its place in its split and the lines of the splits before; the lines
    are written with their places first, since a scan's splits depend on the cores that live when a job is planned.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    at = read.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    at = written(at)
    splits = at.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))  # a row a split
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(splits.select("file", "block", (before - F.col("first")).alias("shift")))
    return at.join(F.broadcast(starts), ["file", "block"]).select((F.col("id") + F.col("shift")).cast("long").alias("row"), "line")


def detect_width(lines: DataFrame) -> int:
    """Values of the first line (row, line), floored to even; none is an error."""
    first = lines.filter("row = 0").select(F.size(tokens(F.col("line")))).first()
    if first is None or first[0] == 0:
        raise ValueError("the first CSV line has no values")
    return first[0] - first[0] % 2


def csv_lines(spark: SparkSession, path: str, policy: str | Mismatch = Mismatch.REJECT, short_row: str = "stop") -> DataFrame:
    """(row, px) of a CSV file without header, one scan line a row. A missing or empty file is an error."""
    lines = numbered_lines(spark, path)
    m = detect_width(lines)
    return fit_lines(lines.select("row", pixels(F.col("line")).alias("px")), m, policy, short_row)


def from_config(spark: SparkSession, config: PipelineConfig, rows: int | None = None, seed: int = 0, source: Source | None = None) -> DataFrame:
    """The configured source, or one's own; a random grid has max_rows rows, or those given."""
    if source is not None:
        return source(spark, config)
    if config.mode is Mode.CSV:
        return csv_lines(spark, config.input_file, config.csv_mismatch_policy)
    n = rows if rows is not None else config.max_rows
    if n <= 0:
        raise ValueError("a random grid needs a number of rows: max_rows or rows")
    return random_lines(spark, n, config.m, seed)


def quantised(x: Column) -> Column:
    """A number from -1 to 1 as a pixel."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5).cast("int")))


def embedding_lines(embeddings: DataFrame, *keep: str) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("row"), F.transform("embedding", quantised).alias("px"), *keep)


def event_pixels(events: DataFrame) -> DataFrame:
    """(row, ts, event_id, v): a line for each user, ordered by time."""
    v = F.pmod(F.floor(F.coalesce("value", F.lit(0.0))), F.lit(256)).cast("int")
    return events.select(F.col("user_id").alias("row"), "ts", "event_id", v.alias("v"))
