"""Row numbers stay when the splits of a scan change between two plans, as they do when an executor is lost."""

from contextlib import contextmanager

import pytest

from scanloom.llm import minhash, sharding, suffix_dedup, warc_zip
from scanloom.llm.shared import numbered

TEXTS = [" ".join(f"w{k}x{i}" for i in range(120)) for k in range(20)]


@contextmanager
def splits(spark, n):
    """Scans planned inside are cut into about n splits."""
    names = {"spark.sql.files.minPartitionNum": str(n), "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    """Forty rows of twenty texts in eight files: row k and row k + 20 have one text."""
    path = f"{tmp_path_factory.mktemp('scan')}/docs"
    spark.createDataFrame([(k, TEXTS[k % 20]) for k in range(40)], "doc_id long, text string").repartition(8).write.parquet(path)
    return path


def test_numbers_stay(spark, scan):
    with splits(spark, 8):
        rows = numbered(spark.read.parquet(scan))
        one = {r.doc_id: r.rid for r in rows.select("doc_id", "rid").collect()}
    with splits(spark, 1):
        two = {r.doc_id: r.rid for r in rows.select("doc_id", "rid").collect()}
    assert one == two and len({*one.values()}) == 40


def test_types_that_files_do_not_hold(spark):
    df = spark.sql("SELECT id, null AS nothing, interval 1 month AS i FROM range(5)")
    assert sorted(r.id for r in numbered(df).select("id").collect()) == [0, 1, 2, 3, 4]
    assert numbered(df.limit(0)).columns == ["id", "nothing", "i", "rid"]


def test_near_duplicates(spark, scan):
    with splits(spark, 8):
        out = minhash.keep_one(spark.read.parquet(scan))
    with splits(spark, 1):
        assert sorted(r.doc_id for r in out.select("doc_id", "text").collect()) == list(range(20))


def test_shards(spark, scan):
    with splits(spark, 8):
        out = sharding.shuffle_to_shards(spark.read.parquet(scan), 4, seed=1)
    with splits(spark, 1):
        rows = out.select("doc_id", "shard", "slot").collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(10)]


def test_repeats(spark, scan):
    with splits(spark, 8):
        whole = spark.read.parquet(scan).filter("doc_id < 21")
        out = suffix_dedup.remove_repeats(whole, digests=True)
    with splits(spark, 1):
        assert {r.doc_id for r in out.select("doc_id", "n_spans").collect() if r.n_spans} == {0, 20}


def test_equal_pages(spark, scan, monkeypatch):
    """Pages of one id and payload: the splits change after the first holders are found."""

    def cut(df, small=False, own=warc_zip.cut):
        out = own(df, small)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    monkeypatch.setattr(warc_zip, "cut", cut)
    with splits(spark, 8):
        pages = spark.read.parquet(scan).selectExpr("1L AS page_id", "'u' AS url", "text AS html")
        kinds = [r.record_type for r in warc_zip.round_trip(pages).collect()]
    assert sorted(kinds) == ["response"] * 20 + ["revisit"] * 20


@pytest.fixture
def shaken(spark, monkeypatch):
    """After every job the splits of scans change."""
    from pyspark.sql import DataFrame, DataFrameWriter

    turn = [0]

    def then_change(kind, name):
        own = getattr(kind, name)

        def run(*a, **b):
            out = own(*a, **b)
            turn[0] += 1
            spark.conf.set("spark.sql.files.minPartitionNum", str([1, 16, 3, 40][turn[0] % 4]))
            return out

        monkeypatch.setattr(kind, name, run)

    frame = type(spark.range(1))
    assert issubclass(frame, DataFrame)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    for kind, name in ((frame, "checkpoint"), (frame, "collect"), (frame, "count"), (frame, "first"), (frame, "isEmpty"), (type(spark.range(1).write), "parquet")):
        then_change(kind, name)
    assert issubclass(type(spark.range(1).write), DataFrameWriter)
    yield turn
    for name in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def forty_files(spark, tmp_path_factory):
    """documents and benchmark of the smallest tables, in forty files each."""
    top = f"{tmp_path_factory.mktemp('forty')}"
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(40).write.parquet(f"{top}/{name}.parquet")
    return top


@pytest.mark.parametrize("name", ["op5_suffix_dedup", "op6_decontamination", "op8_minhash", "op9_line_dedup"])
def test_results_stay_when_splits_change_between_jobs(spark, shaken, forty_files, name):
    from scanloom.llm import queries

    query = queries.queries()[name]
    want = sorted(map(str, query(spark, "/root/testdata/sf0.001").collect()))
    before = shaken[0]
    got = query(spark, forty_files)
    assert shaken[0] > before
    assert sorted(map(str, got.collect())) == want


def test_shards_stay_when_splits_change_between_jobs(spark, shaken, forty_files):
    from scanloom.llm import queries

    rows = queries.op3_sharding(spark, forty_files).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len({r.doc_id for r in rows}) == len(rows)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 24


def test_line_numbers_stay_when_splits_change_between_jobs(spark, shaken, tmp_path):
    from scanloom.sources.grids import numbered_lines

    spark.range(500).repartitionByRange(9, "id").sortWithinPartitions("id").selectExpr("'line ' || id AS line").write.text(str(tmp_path / "lines"))
    rows = numbered_lines(spark, str(tmp_path / "lines"))
    for n in ("1", "30"):
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        assert sorted((r.row, r.line) for r in rows.collect()) == [(k, f"line {k}") for k in range(500)]
