import pytest

from scanloom.config import Boundary, ConfigError, Mismatch, Mode, PipelineConfig, load, parse_text
from scanloom.functions.kernel import DEFAULT_TAPS
from scanloom.plans.pipeline import packets, run
from scanloom.sources import grids as G


def read(spark, tmp_path, text, **options):
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    return [tuple(r) for r in G.csv_lines(spark, str(path), **options).orderBy("row").collect()]


@pytest.mark.parametrize(
    "text, rows",
    [
        ("10,20,30,40\n50,60,70,80\n", [[10, 20, 30, 40], [50, 60, 70, 80]]),
        ("  5 , 10 , 15 , 20 \n", [[5, 10, 15, 20]]),
        ("0,255,0,255\n", [[0, 255, 0, 255]]),
        ("10,20,30,40", [[10, 20, 30, 40]]),
        ("10,20,30,40\r\n50,60,70,80\r\n", [[10, 20, 30, 40], [50, 60, 70, 80]]),
        ("100,200\n", [[100, 200]]),
        ("300,-1\n", [[44, 255]]),
        ("1,,2\n3,4\n", [[1, 2], [3, 4]]),
        ("3.7,12abc\n", [[3, 12]]),
    ],
)
def test_csv(spark, tmp_path, text, rows):
    assert read(spark, tmp_path, text) == list(enumerate(rows))


def test_csv_grid_over_several_splits(spark, tmp_path):
    grid = [[(r * 10 + c) % 256 for c in range(6)] for r in range(5000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert read(spark, tmp_path, "".join(",".join(map(str, r)) + "\n" for r in grid)) == list(enumerate(grid))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_mismatch(spark, tmp_path):
    text = "1,2,3,4\n1,2,3\n\n1,2,3,4,5\n"
    assert read(spark, tmp_path, text, policy="zero_pad") == [(0, [1, 2, 3, 4]), (1, [1, 2, 3, 0]), (2, [0, 0, 0, 0]), (3, [1, 2, 3, 4])]
    short = "1,2,3,4\n1,2,3\n9,9,9,9\n"
    assert read(spark, tmp_path, short, policy="truncate") == [(0, [1, 2, 3, 4])]
    assert read(spark, tmp_path, short, policy="truncate", short_row="skip") == [(0, [1, 2, 3, 4]), (2, [9, 9, 9, 9])]
    with pytest.raises(Exception, match="row 1"):
        read(spark, tmp_path, short, policy="reject")
    with pytest.raises(Exception, match="row 0"):
        read(spark, tmp_path, "1,2,3\n")


def test_csv_errors(spark, tmp_path):
    with pytest.raises(Exception):
        G.csv_lines(spark, str(tmp_path / "none.csv"))
    for text in ("", "\n1,2\n"):
        with pytest.raises(ValueError):
            read(spark, tmp_path, text)
    with pytest.raises(Exception):
        read(spark, tmp_path, "1,x\n")


@pytest.mark.parametrize("m", [4, 6, 8])
def test_random(spark, m):
    rows = G.random_packets(spark, 50, m, seed=1).orderBy("row", "col").collect()
    assert [(r.row, r.col) for r in rows] == [(k // (m // 2), 2 * (k % (m // 2))) for k in range(50)]
    values = [v for r in rows for v in (r.v1, r.v2)]
    assert all(0 <= v <= 255 for v in values) and len(set(values)) > 20
    lines = [v for r in G.random_lines(spark, 3, m, seed=1).orderBy("row").collect() for v in r.px]
    assert lines == values[: 3 * m]
    with pytest.raises(ValueError):
        G.random_lines(spark, 1, 0)


def test_config_text():
    c = parse_text("# m=9\nm=4\nT=1000000\nthreshold=384\nmode=random\nunknown=1\nboundary_policy=zero_pad\n").validated()
    assert (c.m, c.T, c.threshold, c.kernel, c.boundary_policy) == (4, 1000000, 128, DEFAULT_TAPS, Boundary.ZERO_PAD)
    c = parse_text("m=8\nT=500000\nthreshold=64\nmode=csv\ninput_file=test.csv\nkernel=0.1,0.2,0.1\nwrite_output=no").validated()
    assert (c.mode, c.input_file, c.kernel, c.write_output) == (Mode.CSV, "test.csv", ("0.1", "0.2", "0.1"), False)
    assert parse_text("mode=what\ncsv_mismatch_policy=what").csv_mismatch_policy is Mismatch.REJECT


@pytest.mark.parametrize("text", ["m=0\nT=1", "m=3\nT=1", "m=4\nT=0", "m=4\nT=1\nkernel=1\nkernel=1", "mode=csv\nT=1\ninput_file=", "m=4\nT=1\nkernel=nan"])
def test_bad_config(text):
    with pytest.raises((ConfigError, ValueError)):
        parse_text(text).validated()


def test_load(tmp_path):
    path = tmp_path / "c.cfg"
    path.write_text("m=4\nT=5\nmax_rows=9\n")
    c = load([f"--config={path}", "--max-rows=3", "--boundary=zero_pad", "--other=1"])
    assert (c.max_rows, c.boundary_policy) == (3, Boundary.ZERO_PAD)
    with pytest.raises(ConfigError):
        load([f"--config={tmp_path}/none.cfg"])
    assert load([], str(tmp_path / "none.cfg"), {"m": "2", "T": "1"}).m == 2


def test_whole_run(spark, tmp_path):
    c = PipelineConfig(m=10, T=1, threshold=128, max_rows=7, output_file=str(tmp_path / "out"))
    s = run(spark, c, seed=2).first()
    assert (s.packets, s.pixels, s.rows, s.rows_emitted, s.cause) == (35, 70, 7, 6, "max_rows")
    assert s.ones + s.zeros == s.pixels
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["row", "col", "b1", "b2"] and back.count() == 35
    assert packets(spark, c, leak_packet=True).count() == 36
    null = PipelineConfig(m=10, T=1, max_rows=2, write_output=False)
    assert run(spark, null).first().packets == 10
