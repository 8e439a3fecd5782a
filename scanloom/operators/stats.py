"""Counts, gaps, exact-rank percentiles, verdicts and queue occupancy.

What needs a total order (gaps, ranks, running sums, queues) is done in ranges of that order: rows are dealt by range and
written once, worked on within their range, and joined up by one summary row a range.  No task gets all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.written import written

ROWS_A_RANGE = 1_000_000
MOST_RANGES = 1 << 15


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds __range: ascending ranges of the order, of about ROWS_A_RANGE rows; rows that are equal in it share a range."""
    ranges = max(1, min(MOST_RANGES, rows.count() // ROWS_A_RANGE))
    if ranges == 1:
        return rows.withColumn("__range", F.lit(0))
    return written(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))


def _before(summary: DataFrame, value: Column, name: str) -> DataFrame:
    """Per range, the aggregate of all ranges before it; there are MOST_RANGES at most."""
    w = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(summary.select("__range", value.over(w).alias(name)))


def with_previous(rows: DataFrame, value: str, order: Sequence[str], name: str = "previous") -> DataFrame:
    """Adds the value of the row before, in that order; the first row has none."""
    dealt = in_ranges(rows, order)
    w = Window.partitionBy("__range").orderBy(*order)
    ends = dealt.groupBy("__range").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__v"))
    last = _before(ends, F.last("__v"), "__last")
    return dealt.join(last, "__range").withColumn(name, F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(w), F.col("__last"))["v"]).drop("__range", "__last")


def running_sum(rows: DataFrame, value: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds the sum of value over all rows up to this one, in that order."""
    dealt = in_ranges(rows, order)
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = _before(dealt.groupBy("__range").agg(F.sum(value).alias("__v")), F.sum("__v"), "__sum")
    return dealt.join(sums, "__range").withColumn(name, F.sum(value).over(w) + F.coalesce("__sum", F.lit(0))).drop("__range", "__sum")


def gaps(rows: DataFrame, ts: str, order: Sequence[str], keep_negative: bool = True) -> DataFrame:
    """gap: differences of successive times in the order of arrival; zero stays, negative ones unless told. The first row has none."""
    out = with_previous(rows, ts, order).select((F.col(ts) - F.col("previous")).alias("gap")).filter("gap IS NOT NULL")
    return out if keep_negative else out.filter("gap >= 0")


def exact_percentiles(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at 0-based rank floor(share * n), n - 1 at most; null without values."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    up_to = running_sum(counts, "__n", ["__value"], "__up_to")
    total = counts.agg(F.sum("__n").alias("__total"))
    both = up_to.join(F.broadcast(total))
    at = lambda q: F.least(F.floor(F.lit(float(q)) * F.col("__total")), F.col("__total") - 1)
    return both.agg(*[F.min(F.when(F.col("__up_to") > at(q), F.col("__value"))).alias(name) for name, q in shares.items()])


def gap_stats(found: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """samples, min_gap, max_gap, avg_gap and percentiles, one row. The gaps are written once: they are read several times."""
    found = written(found.select("gap"))
    plain = found.agg(F.count("gap").alias("samples"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.avg("gap").alias("avg_gap"))
    return plain.join(F.broadcast(exact_percentiles(found, "gap", shares or {"p99_gap": 0.99})))


def verdict(max_gap: Column, avg_gap: Column | None, budget: int) -> Column:
    """PASS if the largest gap is within the budget; with an average, a middle verdict."""
    out = F.when(max_gap <= budget, F.lit("PASS"))
    return (out if avg_gap is None else out.when(avg_gap <= budget, F.lit("AVG PASS / MAX FAIL"))).otherwise(F.lit("FAIL"))


def bit_counts(packets: DataFrame) -> DataFrame:
    """packets, pixels, ones, zeros, rows, and rows_emitted: the row changes that a stream sees."""
    ones, n = F.coalesce(F.sum(F.col("b1") + F.col("b2")), F.lit(0)).cast("long"), F.count(F.lit(1))
    rows = F.count_distinct("row")
    return packets.agg(n.alias("packets"), (2 * n).alias("pixels"), ones.alias("ones"), (2 * n - ones).alias("zeros"), rows.alias("rows"), F.greatest(rows - 1, F.lit(0)).alias("rows_emitted"))


def row_counts(packets: DataFrame) -> DataFrame:
    ones = F.sum(F.col("b1") + F.col("b2")).cast("long")
    return packets.groupBy("row").agg(F.count(F.lit(1)).alias("packets"), ones.alias("ones"), (2 * F.count(F.lit(1)) - ones).alias("zeros"))


def peak_occupancy(moves: DataFrame, t: str, change: str, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """peak: the most items in a queue, from a log of changes (+1, -1); with a limit, memory_ok."""
    out = running_sum(moves, change, [t, *order], "__level").agg(F.greatest(F.coalesce(F.max("__level"), F.lit(0)), F.lit(0)).cast("long").alias("peak"))
    return out if limit is None else out.withColumn("memory_ok", F.col("peak") <= limit)


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is n or more, and 2 at least."""
    up = F.lit(1).cast("long")
    below = F.greatest(n.cast("long"), F.lit(2)) - 1
    for k in (1, 2, 4, 8, 16, 32):
        below = below.bitwiseOR(F.shiftright(below, k))
    return below + up


def ring_capacity(hint: Column, logical_max: Column | None = None) -> Column:
    """How many items a ring holds: one slot of a power of two stays free, and a logical limit (0: the hint) may be lower."""
    most = hint if logical_max is None else F.when(logical_max > 0, logical_max).otherwise(hint)
    slots = next_power_of_two(hint) - 1
    return F.when(most > 0, F.least(slots, most.cast("long"))).otherwise(slots)


def _clamped(x: Column, capacity: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(capacity))


def bounded_queue(moves: DataFrame, capacity: int) -> DataFrame:
    """source, dropped, peak: drops of a bounded queue, by a log (source, seq, change); at one seq, items leave before others come.

    A push that finds the queue full is lost, a pop of an empty one does nothing.  A stretch of the log maps the level
    before it to that after it by x -> min(max(x + a, low), high), whatever it holds, and such maps compose: a source's
    log is worked through in ranges, each from the level that the maps of the ranges before it lead to.
    """
    whole = in_ranges(moves.select("source", "seq", F.col("change").cast("int").alias("change")), ["source", "seq", "change"])
    log = whole.groupBy("source", "__range").agg(F.sort_array(F.collect_list(F.struct("seq", "change"))).alias("log"))

    def compose(f: Column, m: Column) -> Column:
        return F.struct((f.a + m.change).alias("a"), _clamped(f.low + m.change, capacity).alias("low"), _clamped(f.high + m.change, capacity).alias("high"))

    def step(s: Column, m: Column) -> Column:
        full = (m.change > 0) & (s.level >= capacity)
        level = _clamped(s.level + m.change, capacity)
        return F.struct(level.alias("level"), (s.dropped + full.cast("long")).alias("dropped"), F.greatest(s.peak, level).alias("peak"))

    start = F.lit(0)
    if whole.agg(F.max("__range")).first()[0]:
        log = written(log)
        one = F.aggregate("log", F.struct(F.lit(0).alias("a"), F.lit(0).alias("low"), F.lit(capacity).alias("high")), compose)
        maps = log.select("source", "__range", one.alias("map")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("__range", "map"))).alias("maps"))  # a row a range
        lead = lambda level, m: F.least(F.greatest(level + m["map"].a, m["map"].low), m["map"].high)
        starts = maps.select("source", F.explode(F.transform("maps", lambda m, i: F.struct(m["__range"].alias("__range"), F.aggregate(F.slice("maps", F.lit(1), i), F.lit(0), lead).alias("__start")))).alias("s"))
        log = log.join(starts.select("source", "s.*"), ["source", "__range"])
        start = F.col("__start")
    zero = F.lit(0).cast("long")
    done = log.select("source", F.aggregate("log", F.struct(start.alias("level"), zero.alias("dropped"), start.alias("peak")), step).alias("s"))
    return done.groupBy("source").agg(F.sum("s.dropped").alias("dropped"), F.max("s.peak").cast("long").alias("peak"))
