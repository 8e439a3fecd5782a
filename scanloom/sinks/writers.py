"""Sinks of packets, and the summary of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.config import PipelineConfig
from scanloom.operators.stats import bit_counts

Sink = Callable[[DataFrame, PipelineConfig], None]
PACKETS = "row long, col long, b1 int, b2 int"


def write_csv(packets: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of CSV parts with the header row,col,b1,b2, ordered by row and col over all parts."""
    out = packets.select("row", "col", "b1", "b2").orderBy("row", "col")
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The packets that write_csv wrote."""
    return spark.read.schema(PACKETS).option("header", True).csv(path)


def write_null(packets: DataFrame) -> None:
    packets.write.format("noop").mode("overwrite").save()


def as_text(packets: DataFrame) -> DataFrame:
    """line: row=.. col=.. b1=.. b2=.."""
    parts = [x for c in ("row", "col", "b1", "b2") for x in (F.lit(f"{' ' if c != 'row' else ''}{c}="), F.col(c).cast("string"))]
    return packets.orderBy("row", "col").select(F.concat(*parts).alias("line"))


def write_stdout(packets: DataFrame) -> None:
    for r in as_text(packets).toLocalIterator():
        print(r["line"])


def write(packets: DataFrame, config: PipelineConfig, sink: Sink | None = None) -> None:
    """To the configured sink, or to one's own."""
    if sink is not None:
        sink(packets, config)
    elif config.write_output:
        write_csv(packets, config.output_file)
    else:
        write_null(packets)


def summary(packets: DataFrame, config: PipelineConfig | None = None, cause: str = "source exhausted") -> DataFrame:
    """One row: counts, why the run ended, and the configuration as a map."""
    out = bit_counts(packets).withColumn("cause", F.lit(cause))
    if config is None:
        return out
    return out.withColumn("config", F.create_map(*[F.lit(x) for kv in config.describe().items() for x in kv]))
