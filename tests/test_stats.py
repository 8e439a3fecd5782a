import random

import pytest

from scanloom.operators import stats as S


@pytest.fixture(params=[1_000_000, 7])
def ranges(request, monkeypatch):
    monkeypatch.setattr(S, "ROWS_A_RANGE", request.param)


def test_percentiles(spark, ranges):
    df = spark.createDataFrame([(g,) for g in range(100)], "gap long")
    row = S.gap_stats(df, {"p50": 0.5, "p99": 0.99}).first()
    assert (row.samples, row.min_gap, row.max_gap, row.p50, row.p99, row.avg_gap) == (100, 0, 99, 50, 99, 49.5)


def test_no_gaps(spark):
    row = S.gap_stats(spark.createDataFrame([], "gap long")).first()
    assert row.samples == 0 and row.p99_gap is None


def test_gaps_keep_zero(spark, ranges):
    rng = random.Random(1)
    ts = sorted(rng.choices(range(500), k=200))
    rows = list(enumerate(ts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, t long")
    got = sorted(r.gap for r in S.gaps(df, "t", ["id"]).collect())
    assert got == sorted(b - a for a, b in zip(ts, ts[1:])) and 0 in got


def test_gaps_in_order_of_arrival(spark, ranges):
    ts = [10, 30, 20, 25, 25, 3, 90, 80, 81, 7, 7, 0, 100, 99, 4]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ts)], "seq long, t long").repartition(4)
    want = [b - a for a, b in zip(ts, ts[1:])]
    assert sorted(r.gap for r in S.gaps(df, "t", ["seq"]).collect()) == sorted(want) and min(want) < 0
    assert sorted(r.gap for r in S.gaps(df, "t", ["seq"], keep_negative=False).collect()) == sorted(g for g in want if g >= 0)


@pytest.mark.parametrize("gap, avg, threaded, linear", [(5, 3.0, "PASS", "PASS"), (9, 3.0, "FAIL", "AVG PASS / MAX FAIL"), (9, 6.0, "FAIL", "FAIL")])
def test_verdicts(spark, gap, avg, threaded, linear):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(gap, avg)], "m long, a double").select(S.verdict(F.col("m"), None, 5).alias("t"), S.verdict(F.col("m"), F.col("a"), 5).alias("l")).first()
    assert (row.t, row.l) == (threaded, linear)


def test_occupancy(spark, ranges):
    rng = random.Random(2)
    moves, level, peak = [], 0, 0
    for t in range(300):
        change = 1 if level == 0 or rng.random() < 0.55 else -1
        level += change
        peak = max(peak, level)
        moves.append((t, change))
    df = spark.createDataFrame(moves, "t long, change int")
    row = S.peak_occupancy(df, "t", "change", [], limit=peak).first()
    assert (row.peak, row.memory_ok) == (peak, True)


@pytest.mark.parametrize("capacity", [1, 3])
def test_bounded_queue(spark, ranges, capacity):
    rng = random.Random(7)
    moves = [(s, t, c) for s in range(3) for t in range(40) for c in rng.choices([1, -1], [0.6, 0.4], k=rng.randint(0, 2))]
    want = {}
    for s in {m[0] for m in moves}:
        level = dropped = peak = 0
        for _, _, c in sorted(m for m in moves if m[0] == s):
            if c > 0 and level == capacity:
                dropped += 1
            level = min(capacity, max(0, level + c))
            peak = max(peak, level)
        want[s] = (dropped, peak)
    rng.shuffle(moves)
    df = spark.createDataFrame(moves, "source long, seq long, change int")
    assert {r.source: (r.dropped, r.peak) for r in S.bounded_queue(df, capacity).collect()} == want


def test_ring_capacity(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (65, 65), (64, 100), (1 << 33, 7)], "hint long, logical long")
    got = [tuple(r) for r in df.select(S.next_power_of_two(F.col("hint")), S.ring_capacity(F.col("hint"), F.col("logical"))).collect()]
    assert got == [(2, 1), (2, 1), (2, 1), (4, 3), (4, 3), (8, 5), (128, 65), (64, 63), (1 << 33, 7)]


def test_counts(spark):
    df = spark.createDataFrame([(0, 0, 1, 0), (0, 2, 1, 1), (1, 0, 0, 0)], "row long, col long, b1 int, b2 int")
    row = S.bit_counts(df).first()
    assert (row.packets, row.pixels, row.ones, row.zeros, row.rows, row.rows_emitted) == (3, 6, 3, 3, 2, 1)
    empty = S.bit_counts(df.filter("row > 5")).first()
    assert (empty.packets, empty.ones, empty.rows_emitted) == (0, 0, 0)
