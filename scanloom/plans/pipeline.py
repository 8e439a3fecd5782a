"""Whole runs: source, row limit, filter, sink, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.config import PipelineConfig
from scanloom.operators.lines import filter_lines, limit_rows
from scanloom.sinks.writers import Sink, summary, write
from scanloom.sources.grids import Source, from_config


def _lines(spark: SparkSession, config: PipelineConfig, rows: int | None, seed: int, source: Source | None) -> DataFrame:
    """The source's lines. A random grid has no end: it gets one row more than the limit, if no number of rows is given."""
    return from_config(spark, config, rows or (config.max_rows + 1 if config.max_rows else None), seed, source)


def _filtered(lines: DataFrame, config: PipelineConfig, leak_packet: bool = False) -> DataFrame:
    return filter_lines(limit_rows(lines, config.max_rows, leak_packet, px="px"), config.kernel, config.threshold, config.boundary_policy.value)


def packets(spark: SparkSession, config: PipelineConfig, rows: int | None = None, seed: int = 0, leak_packet: bool = False, source: Source | None = None) -> DataFrame:
    """The packets of a configured run, not yet worked out."""
    config = config.validated()
    return _filtered(_lines(spark, config, rows, seed, source), config, leak_packet)


def run(spark: SparkSession, config: PipelineConfig, rows: int | None = None, seed: int = 0, source: Source | None = None, sink: Sink | None = None) -> DataFrame:
    """Writes the packets as configured and returns the summary. The cause is the limit if the source has that many rows."""
    config = config.validated()
    lines = _lines(spark, config, rows, seed, source)
    out = _filtered(lines, config)
    write(out, config, sink)
    reached = config.max_rows and not lines.filter(F.col("row") >= config.max_rows - 1).isEmpty()
    return summary(out, config, "max_rows" if reached else "source exhausted")
