"""Filters over scan lines, against hand-computed bits and a plain float32 version."""

import numpy as np
import pytest

from scanloom.functions import kernel as K
from scanloom.operators import lines as L
from scanloom.streaming.streams import filter_row

SPEC, IDENTITY = K.DEFAULT_TAPS, K.IDENTITY_TAPS
NINTH = tuple(str(float(np.float32(1 / 9))) for _ in range(9))
RAMP = [10, 30, 50, 70, 90, 110, 130, 150, 170, 190]


def plain(values, taps, tv, policy):
    """One pixel at a time, left to right, in float32."""
    half, out = len(taps) // 2, []
    for i in range(len(values)):
        total = np.float32(0)
        for j, tap in enumerate(taps):
            at = i + j - half
            if 0 <= at < len(values):
                v = values[at]
            else:
                v = 0 if policy == K.ZERO_PAD else values[0] if at < 0 else values[-1]
            total = np.float32(total + np.float32(np.float32(v) * np.float32(tap)))
        out.append(int(total >= np.float32(tv)))
    return out


def run(spark, rows, taps, tv, policy):
    df = spark.createDataFrame(list(enumerate(rows)), "row long, px array<int>")
    got = {}
    for r in L.filter_lines(df, taps, tv, policy).orderBy("row", "col").collect():
        got.setdefault(r.row, []).append((r.col, r.b1, r.b2))
    return got


def bits(packets):
    return [b for _, b1, b2 in packets for b in (b1, b2)]


@pytest.mark.parametrize(
    "rows, tv, taps, policy, expected",
    [
        ([[200] * 4] * 2, 100, IDENTITY, K.ZERO_PAD, [[1] * 4] * 2),
        ([[50] * 4], 100, IDENTITY, K.ZERO_PAD, [[0] * 4]),
        ([[50, 200, 50, 200]], 100, IDENTITY, K.ZERO_PAD, [[0, 1, 0, 1]]),
        ([[0] * 4], 0, IDENTITY, K.ZERO_PAD, [[1] * 4]),
        ([[0, 0, 0, 0, 90, 0, 0, 0, 0, 0]], 5, NINTH, K.ZERO_PAD, [[1] * 9 + [0]]),
        ([[100] * 10], 99, SPEC, K.REPLICATE, [[1] * 10]),
        ([[128] * 10], 127, SPEC, K.REPLICATE, [[1] * 10]),
        ([[0] * 10, [255] * 10], 1, SPEC, K.REPLICATE, [[0] * 10, [1] * 10]),
        ([[100, 200]], 50, IDENTITY, K.ZERO_PAD, [[1, 1]]),
        ([[128] * 1000], 127, SPEC, K.REPLICATE, [[1] * 1000]),
        ([[200, 50, 200]], 100, IDENTITY, K.ZERO_PAD, [[1, 0, 1, 0]]),
    ],
)
def test_known_bits(spark, rows, tv, taps, policy, expected):
    got = run(spark, rows, taps, tv, policy)
    assert [bits(got[k]) for k in range(len(rows))] == expected


def test_edges(spark):
    assert bits(run(spark, [[200] * 10], SPEC, 150, K.ZERO_PAD)[0])[0] == 0
    assert bits(run(spark, [[200] * 10], SPEC, 150, K.REPLICATE)[0]) == [1] * 10


def test_mirror(spark):
    got = bits(run(spark, [[10, 50, 100, 200, 255, 255, 200, 100, 50, 10]], SPEC, 100, K.REPLICATE)[0])
    assert got == got[::-1]


def test_coordinates_and_empty(spark):
    got = run(spark, [[100] * 6, [100] * 6, [], None], IDENTITY, 50, K.ZERO_PAD)
    assert {k: [c for c, _, _ in v] for k, v in got.items()} == {0: [0, 2, 4], 1: [0, 2, 4]}


@pytest.mark.parametrize("policy", [K.REPLICATE, K.ZERO_PAD])
@pytest.mark.parametrize("taps", [SPEC, NINTH, ("0.25", "0.5", "0.25"), ("0.1", "0.2", "0.4", "0.2", "0.1"), ("1",)])
def test_layouts_and_stream_agree(spark, policy, taps):
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 256, n).tolist() for n in [*range(1, 14), 64]] + [RAMP]
    got = run(spark, rows, taps, 80, policy)
    pixels = spark.createDataFrame([(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "row long, c long, v int")
    table = {}
    for r in L.filter_pixels(pixels, ["c"], taps, 80, policy).orderBy("row", "col").collect():
        table.setdefault(r.row, []).append((r.col, r.b1, r.b2))
    for k, row in enumerate(rows):
        want = plain(row, taps, 80, policy)
        assert bits(got[k])[: len(row)] == want
        assert filter_row(row, taps, 80, policy).tolist() == want
    assert table == got


@pytest.mark.parametrize("tv, value, bit", [(128, 128.0, 1), (128, 127.9, 0), (0, 0.0, 1), (0, -1.0, 0), (255, 254.9, 0), (255, 255.0, 1), (255, 256.0, 1), (50, 50.0, 1), (50, 49.0, 0)])
def test_threshold(spark, tv, value, bit):
    df = spark.createDataFrame([(value,)], "f float")
    assert L.threshold_values(df, tv).first().b == bit


@pytest.mark.parametrize("taps", [(), ("1",) * 4, ("nan",), ("inf", "1", "1")])
def test_bad_kernels(taps):
    with pytest.raises(ValueError):
        K.checked(taps)


def test_packets_round_trip_and_lines(spark):
    pixels = spark.createDataFrame([(0, c, c * 10) for c in range(5)], "row long, col long, v int")
    packets = L.to_packets(pixels).orderBy("col").collect()
    assert [(p.col, p.v1, p.v2) for p in packets] == [(0, 0, 10), (2, 20, 30), (4, 40, 0)]
    back = L.from_packets(L.to_packets(pixels), "v1", "v2", "v").orderBy("col").collect()
    assert [r.v for r in back] == [0, 10, 20, 30, 40, 0]
    assert L.to_lines(pixels).first().px == [0, 10, 20, 30, 40]
    assert sorted(map(tuple, L.to_pixels(L.to_lines(pixels)).collect())) == sorted(map(tuple, pixels.collect()))


def test_row_limit(spark):
    from scanloom.sources.grids import random_lines, random_packets

    lines = random_lines(spark, 12, 10, seed=3)
    assert L.limit_rows(lines, 5).count() == 5
    leaked = L.limit_rows(lines, 5, leak_packet=True, px="px")
    assert sum(len(r.px) for r in leaked.collect()) == 5 * 10 + 2
    assert L.limit_rows(random_packets(spark, 60, 10), 5, leak_packet=True).count() == 26
    assert L.limit_rows(lines, 0).count() == 12


def test_segments(spark):
    df = spark.createDataFrame([(0, 7), (1, 7), (2, 8), (3, 7)], "t long, row long")
    assert [r.segment for r in L.segment_rows(df, ["t"]).orderBy("t").collect()] == [0, 0, 1, 2]


def test_no_shuffle_and_no_python_in_the_line_layout(spark):
    from scanloom.sources.grids import random_lines

    plan = L.filter_lines(random_lines(spark, 10, 8))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_threshold_column_of_the_table(spark):
    from pyspark.sql import functions as F

    from scanloom.functions.kernel import IDENTITY_TAPS
    from scanloom.operators.lines import filter_lines

    df = spark.createDataFrame([(0, [5, 6, 7], 6), (1, [5, 6, 7], 7), (2, [], 1)], "row long, px array<int>, label int")
    got = filter_lines(df, IDENTITY_TAPS, threshold=F.col("label"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 1), (0, 2, 1, 0), (1, 0, 0, 0), (1, 2, 1, 0)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
