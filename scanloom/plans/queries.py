"""Named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom import config as C
from scanloom.functions import kernel as K
from scanloom.functions.csv_lines import pixels
from scanloom.operators import lines as L
from scanloom.operators import stats as S
from scanloom.plans import pipeline as P
from scanloom.sinks import writers as W
from scanloom.sources import grids as G
from scanloom.streaming import streams
from scanloom.written import fresh_path

THREE, FIVE = ("0.25", "0.5", "0.25"), ("0.1", "0.2", "0.4", "0.2", "0.1")
EVENT_TV, GRID_TV, SHORT_TV = 100, 128, 25
WIDTH = 4
BUDGET_US = 120_000_000
QUEUE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.embedding_lines(table(spark, sf_dir, "embeddings"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.event_pixels(table(spark, sf_dir, "events"))


def event_packets(spark: SparkSession, sf_dir: str, taps=K.DEFAULT_TAPS, policy: str = K.REPLICATE) -> DataFrame:
    return L.filter_pixels(events(spark, sf_dir), ["ts", "event_id"], taps, EVENT_TV, policy)


def scan_filter_replicate(spark, sf_dir):
    return L.filter_lines(grid(spark, sf_dir), K.DEFAULT_TAPS, GRID_TV, K.REPLICATE)


def scan_filter_zero_pad(spark, sf_dir):
    return L.filter_lines(grid(spark, sf_dir), K.DEFAULT_TAPS, GRID_TV, K.ZERO_PAD)


def filtered_values_f32(spark, sf_dir):
    return L.line_values(grid(spark, sf_dir))


def event_line_filter(spark, sf_dir):
    return event_packets(spark, sf_dir)


def event_line_filter_zero_pad(spark, sf_dir):
    return event_packets(spark, sf_dir, policy=K.ZERO_PAD)


def short_line_filter(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    order = [c for c in items.columns if c != "l_orderkey"]
    return L.filter_pixels(items.withColumn("v", F.col("l_quantity").cast("int")), order, K.DEFAULT_TAPS, SHORT_TV, K.REPLICATE, row="l_orderkey")


def kernel_identity(spark, sf_dir):
    return event_packets(spark, sf_dir, K.IDENTITY_TAPS)


def kernel_uniform(spark, sf_dir):
    return event_packets(spark, sf_dir, K.UNIFORM_TAPS)


def kernel_3tap(spark, sf_dir):
    return event_packets(spark, sf_dir, THREE)


def kernel_5tap(spark, sf_dir):
    return event_packets(spark, sf_dir, FIVE)


def threshold_inclusive(spark, sf_dir):
    return L.filter_lines(grid(spark, sf_dir), K.IDENTITY_TAPS, GRID_TV)


def threshold_zero(spark, sf_dir):
    return L.filter_lines(grid(spark, sf_dir), K.IDENTITY_TAPS, 0)


def threshold_max(spark, sf_dir):
    return L.filter_lines(grid(spark, sf_dir), K.IDENTITY_TAPS, 255)


def threshold_column(spark, sf_dir):
    """The threshold is a column: the label of each vector."""
    lines = G.embedding_lines(table(spark, sf_dir, "embeddings"), "label")
    return L.from_packets(L.filter_lines(lines, threshold=F.col("label") + 120))


def pair_packets(spark, sf_dir):
    numbered = L.pixel_bits(events(spark, sf_dir), ["ts", "event_id"], K.IDENTITY_TAPS, 50)
    return L.pair_bits(numbered)


def unpair_packets(spark, sf_dir):
    return L.from_packets(event_packets(spark, sf_dir))


def raw_packets(spark, sf_dir):
    return L.to_packets(L.to_pixels(grid(spark, sf_dir)))


def lines_round_trip(spark, sf_dir):
    return L.to_pixels(L.to_lines(events(spark, sf_dir), ["ts", "event_id"]))


def row_limit_exact(spark, sf_dir):
    return L.filter_lines(L.limit_rows(grid(spark, sf_dir), 100), threshold=GRID_TV)


def row_limit_leaky(spark, sf_dir):
    return L.filter_lines(L.limit_rows(grid(spark, sf_dir), 100, leak_packet=True, px="px"), threshold=GRID_TV)


def ones_zeros_summary(spark, sf_dir):
    return S.bit_counts(event_packets(spark, sf_dir))


def rows_per_scan(spark, sf_dir):
    return S.row_counts(event_packets(spark, sf_dir))


def ticks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def event_gaps(spark, sf_dir):
    """Events arrive by number."""
    return S.gaps(ticks(spark, sf_dir), "t", ["event_id"])


def arrival_gaps(spark, sf_dir):
    """Events arrive user by user: where the next user's begin, a gap is negative."""
    return S.gaps(ticks(spark, sf_dir), "t", ["user_id", "event_id"])


def arrival_gap_stats(spark, sf_dir):
    return S.gap_stats(arrival_gaps(spark, sf_dir))


def arrival_gap_stats_linear(spark, sf_dir):
    """Negative gaps are left out."""
    return S.gap_stats(S.gaps(ticks(spark, sf_dir), "t", ["user_id", "event_id"], keep_negative=False), {"p50_gap": 0.5, "p99_gap": 0.99})


def gap_stats(spark, sf_dir):
    return S.gap_stats(event_gaps(spark, sf_dir))


def gap_stats_linear(spark, sf_dir):
    return S.gap_stats(S.gaps(ticks(spark, sf_dir), "t", ["event_id"], keep_negative=False), {"p50_gap": 0.5, "p99_gap": 0.99})


def gap_verdict(spark, sf_dir):
    return S.gap_stats(event_gaps(spark, sf_dir)).select(
        S.verdict(F.col("max_gap"), None, BUDGET_US).alias("threaded"), S.verdict(F.col("max_gap"), F.col("avg_gap"), BUDGET_US).alias("linear")
    )


def queue_moves(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    moves = F.array(F.struct(t.alias("t"), F.lit(1).alias("change")), F.struct((t + 3_600_000_000).alias("t"), F.lit(-1).alias("change")))
    return table(spark, sf_dir, "events").select("event_id", F.inline(moves))


def queue_occupancy(spark, sf_dir):
    return S.peak_occupancy(queue_moves(spark, sf_dir), "t", "change", ["change", "event_id"], 65)


def bounded_queue(spark, sf_dir):
    """Each user's events fill a queue of QUEUE places; an item leaves after a day."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    moves = F.array(F.struct(t.alias("seq"), F.lit(1).alias("change")), F.struct((t + 86_400_000_000).alias("seq"), F.lit(-1).alias("change")))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.inline(moves))
    return S.bounded_queue(log, QUEUE)


def ring_capacity(spark, sf_dir):
    """Slots and usable places of rings, by a hint and a logical limit."""
    hints = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ring"), (F.col("o_orderkey") % 300).alias("hint"), (F.col("o_orderkey") % 7 * 20).alias("logical"))
    return hints.select("ring", S.next_power_of_two(F.col("hint")).alias("slots"), S.ring_capacity(F.col("hint")).alias("places"), S.ring_capacity(F.col("hint"), F.col("logical")).alias("limited"))


def order_texts(spark, sf_dir):
    """Text lines of each order's quantities, as a CSV file would have them."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("int"))).alias("q"))
    text = F.concat(F.lit(" "), F.array_join(F.transform("q", lambda x: (x * 7).cast("string")), " , "), F.lit(",\r"))
    return items.select("l_orderkey", text.alias("line"))


def order_lines(spark, sf_dir):
    return order_texts(spark, sf_dir).select(F.col("l_orderkey").alias("row"), pixels(F.col("line")).alias("px"))


def order_file(spark, sf_dir):
    """The same lines in CSV files without header, by order."""
    path = fresh_path(spark, "lines")
    order_texts(spark, sf_dir).orderBy("l_orderkey").select("line").write.text(path)
    return path


def csv_file_zero_pad(spark, sf_dir):
    """A CSV source: lines numbered by their place, as wide as the first line, floored to even."""
    return _pixels(G.csv_lines(spark, order_file(spark, sf_dir), "zero_pad"))


def csv_file_truncate(spark, sf_dir):
    """The first short line ends the data."""
    return _pixels(G.csv_lines(spark, order_file(spark, sf_dir), "truncate"))


def csv_file_skip(spark, sf_dir):
    return _pixels(G.csv_lines(spark, order_file(spark, sf_dir), "truncate", short_row="skip"))


def csv_file_filter(spark, sf_dir):
    """From the file to packets."""
    return L.filter_lines(G.csv_lines(spark, order_file(spark, sf_dir), "zero_pad"), threshold=GRID_TV, policy=K.ZERO_PAD)


def csv_reject_messages(spark, sf_dir):
    """The lines of the file that REJECT fails on, with what it says."""
    lines = G.numbered_lines(spark, order_file(spark, sf_dir))
    m = G.detect_width(lines)
    return lines.select("row", pixels(F.col("line")).alias("px")).select("row", G.mismatch(m).alias("message")).filter("message IS NOT NULL")


def csv_sink(spark, sf_dir):
    """Packets written to CSV, and read back."""
    path = fresh_path(spark, "packets")
    W.write_csv(L.filter_lines(grid(spark, sf_dir), threshold=GRID_TV), path)
    return W.read_csv(spark, path)


def configured_run(spark, sf_dir):
    """A run by a configuration: CSV source, limit, filter, CSV sink, summary."""
    path = fresh_path(spark, "run")
    text = f"# a run\nm=2\nT=100\nthreshold=384\nmode=csv\ninput_file={order_file(spark, sf_dir)}\ncsv_mismatch_policy=zero_pad\nboundary_policy=zero_pad\nkernel=0.25,0.5\nkernel=0.25\noutput_file={path}\n"
    config = C.parse_text(text, C.PipelineConfig(max_rows=50))
    out = P.run(spark, config).withColumn("threshold", F.col("config")["threshold"]).drop("config")
    return out.crossJoin(F.broadcast(W.read_csv(spark, path).agg(F.count(F.lit(1)).alias("packets_written"))))


def configured_run_to_its_end(spark, sf_dir):
    """A source and a sink of one's own, and no limit: the source ends the run."""
    config = C.PipelineConfig(m=64, T=100, threshold=GRID_TV)
    source = lambda s, c: grid(s, sf_dir)
    return P.run(spark, config, source=source, sink=lambda packets, c: W.write_null(packets)).drop("config")


CONFIG_TEXT = """# comment
m = 130
T=500
threshold=300
mode=csv
input_file= scan.csv
 # key=value lines only
kernel=0.25, 0.5
unknown=1
kernel=0.25
boundary_policy=zero_pad
csv_mismatch_policy=whatever
write_output=yes
max_rows=12abc
"""


def config_values(spark, sf_dir):
    """The parameters of a configuration text and of options that override it."""
    found = C.with_options(C.parse_text(CONFIG_TEXT), ["--max-rows=7", "--mode=nothing", "--write-output=no", "--other=1"]).validated()
    return spark.createDataFrame([*found.describe().items()], "key string, value string")


def config_errors(spark, sf_dir):
    """What is wrong with configurations and kernels that cannot run; null if they can."""
    cases = {"odd m": "m=3\nT=1", "small m": "m=0\nT=1", "no T": "m=2", "even kernel": "m=2\nT=1\nkernel=1,2", "no number": "m=x", "infinite tap": "kernel=inf", "no file": "mode=csv\nT=1\ninput_file=", "good": "m=2\nT=1", "good csv": "mode=csv\nT=1\nm=3"}

    def problem(text: str) -> str | None:
        try:
            C.parse_text(text).validated()
        except C.ConfigError as e:
            return str(e)

    return spark.createDataFrame([(k, problem(t)) for k, t in cases.items()], "name string, problem string")


def stream_line_filter(spark, sf_dir):
    """Whole lines as a stream of files, filtered without state, written and read back."""
    out, source = fresh_path(spark, "stream"), grid(spark, sf_dir)
    source.repartition(4).write.parquet(f"{out}/lines")
    lines = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/lines")
    streams.run_for(streams.start(L.filter_lines(lines, threshold=GRID_TV), "parquet", f"{out}/state", True, path=f"{out}/rows"))
    return spark.read.schema(W.PACKETS).parquet(f"{out}/rows")


def stream_packet_filter(spark, sf_dir):
    """Packets of four sources, each line held as state until the next one or the end packet comes."""
    out = fresh_path(spark, "stream")
    packets = L.to_packets(L.to_pixels(grid(spark, sf_dir))).select((F.col("row") % 4).cast("int").alias("source"), "row", "col", "v1", "v2")
    ends = spark.range(4).selectExpr("CAST(id AS INT) AS source", "CAST(null AS LONG) AS row", "CAST(null AS LONG) AS col", "CAST(null AS INT) AS v1", "CAST(null AS INT) AS v2")
    packets.unionByName(ends).write.parquet(f"{out}/packets")
    stream = spark.readStream.schema(packets.schema).parquet(f"{out}/packets")
    streams.run_for(streams.start(streams.filter_packets(stream, threshold=GRID_TV), "parquet", f"{out}/state", True, path=f"{out}/rows"))
    return spark.read.schema("source int, " + W.PACKETS).parquet(f"{out}/rows")


PACED_M, PACED = 10, 60


def stream_paced(spark, sf_dir):
    """The first packets of a paced random stream that is drained and stopped after some batches."""
    out = fresh_path(spark, "stream")
    query = streams.start(streams.paced_packets(spark, PACED_M, 20, seed=3, pixel=G.portable_pixel), "parquet", f"{out}/state", path=f"{out}/rows")
    while query.isActive and (query.lastProgress or {}).get("batchId", -1) < PACED // 20:
        query.awaitTermination(0.1)
    streams.drain(query)
    rows = spark.read.parquet(f"{out}/rows")
    return rows.filter(F.col("row") < PACED * 2 // PACED_M)




def _pixels(lines: DataFrame) -> DataFrame:
    return L.to_pixels(lines)


def csv_mismatch_truncate(spark, sf_dir):
    """Long lines are cut, and the first short one ends the data."""
    return _pixels(G.fit_lines(order_lines(spark, sf_dir), 2, "truncate"))


def csv_mismatch_truncate_all(spark, sf_dir):
    """All orders, cut to a width that every line reaches, so that nothing ends the data."""
    return _pixels(G.fit_lines(order_lines(spark, sf_dir), 1, "truncate"))


def csv_mismatch_skip(spark, sf_dir):
    return _pixels(G.fit_lines(order_lines(spark, sf_dir), WIDTH, "truncate", short_row="skip"))


def csv_mismatch_zero_pad(spark, sf_dir):
    return _pixels(G.fit_lines(order_lines(spark, sf_dir), WIDTH, "zero_pad"))


def csv_mismatch_reject(spark, sf_dir):
    """Lines that fit pass unchanged."""
    return _pixels(G.fit_lines(grid(spark, sf_dir), 64, "reject"))


def segments(spark, sf_dir):
    """Runs of one event type in a user's events."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return L.segment_rows(rows, ["ts", "event_id"], ["user_id"], "event_type").select("user_id", "event_id", "segment")


def random_grid(spark, sf_dir):
    return L.filter_lines(G.random_lines(spark, 1000, 130, seed=1, pixel=G.portable_pixel), threshold=GRID_TV)


def stdout_lines(spark, sf_dir):
    """A line for every packet of the table."""
    return W.as_text(L.filter_lines(grid(spark, sf_dir), threshold=GRID_TV))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    helpers = {"table", "grid", "events", "event_packets", "ticks", "queue_moves", "order_texts", "order_lines", "order_file", "queries"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k not in helpers and not k.startswith("_")}
