from pyspark.sql import functions as F

from scanloom.operators.lines import filter_lines
from scanloom.sources.grids import random_lines, random_packets
from scanloom.streaming import streams


def test_whole_lines_stream_as_in_batch(spark, tmp_path):
    random_lines(spark, 40, 10, seed=4).repartition(4).write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("row long, px array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.start(filter_lines(lines, threshold=128), "parquet", str(tmp_path / "cp"), True, path=str(tmp_path / "out"))
    assert streams.run_for(q) == "source exhausted"
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, filter_lines(random_lines(spark, 40, 10, seed=4), threshold=128).collect()))
    assert streams.dropped_and_peak(q)["input"] == 40


def test_packets_stream_with_rows_over_several_batches(spark, tmp_path):
    m, n = 10, 40
    source = random_packets(spark, n, m, seed=4).withColumn("source", F.lit(0)).select("source", "row", "col", "v1", "v2")
    rows = [tuple(r) for r in source.orderBy("row", "col").collect()] + [(0, None, None, None, None)]
    for k in range(0, len(rows), 7):
        spark.createDataFrame(rows[k : k + 7], source.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streams.start(streams.filter_packets(stream, threshold=128), "parquet", str(tmp_path / "cp"), True, path=str(tmp_path / "out"))
    q.awaitTermination()
    got = sorted(tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(map(tuple, filter_lines(random_lines(spark, n * 2 // m, m, seed=4), threshold=128).collect()))


def test_duration_stops_a_paced_stream(spark):
    q = streams.start(streams.paced_packets(spark, 10, 20), "noop")
    assert streams.run_for(q, 3000) == "duration"
    assert not q.isActive and streams.dropped_and_peak(q)["dropped"] == 0
