"""Line-scan filters as Structured Streaming queries.

Whole lines a record need no state.  Packets need the line that is being received: state is kept by source,
since the end of a line shows only when the next one begins; an end packet (row null) or a timeout flushes.
"""

from __future__ import annotations

import signal
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.functions import kernel as K
from scanloom.sources.grids import Pixel, hashed_pixel


def paced_packets(spark: SparkSession, m: int, packets_per_batch: int, advance_ms: int = 1000, seed: int = 0, pixel: Pixel = hashed_pixel) -> DataFrame:
    """Random packets (source, row, col, v1, v2), so many a micro-batch; nothing is dropped under load."""
    at = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", packets_per_batch).option("advanceMillisPerBatch", advance_ms).option("numPartitions", 1).load()
    at = at.select(F.lit(0).alias("source"), F.floor(F.col("value") / (m // 2)).alias("row"), (2 * (F.col("value") % (m // 2))).cast("int").alias("c"))
    return at.select("source", "row", F.col("c").cast("long").alias("col"), pixel(seed, F.col("row"), F.col("c")).alias("v1"), pixel(seed, F.col("row"), F.col("c") + 1).alias("v2"))


def filter_row(values: Sequence[int], taps: Sequence[str], threshold: int, policy: str) -> np.ndarray:
    """Bits of one line."""
    k, half = [np.float32(t) for t in taps], len(taps) // 2
    x = np.array(values, np.float32)
    x = np.pad(x, half, mode="edge") if policy == K.REPLICATE else np.pad(x, half)
    total = None
    for j, tap in enumerate(k):
        if tap != 0:
            term = x[j : j + len(values)] * tap
            total = term if total is None else total + term
    if total is None:
        total = np.zeros(len(values), np.float32)
    return (total >= np.float32(threshold)).astype(np.int32)


OUT = "source int, row long, col long, b1 int, b2 int"


def filter_packets(packets: DataFrame, taps: Sequence[str] = K.DEFAULT_TAPS, threshold: int = 0, policy: str = K.REPLICATE, timeout_ms: int | None = None) -> DataFrame:
    """Packets (source, row, col, v1, v2) to packets of bits, per source in order of (row, col).

    A line comes out when the next begins, at an end packet (row null), or after timeout_ms without input.
    """
    taps, policy = K.checked(taps), K.check_policy(policy)

    def done(source: int, row: int, values: np.ndarray) -> pd.DataFrame:
        bits = filter_row(values, taps, threshold, policy)
        bits = np.append(bits, 0)[: len(bits) + len(bits) % 2]
        return pd.DataFrame({"source": source, "row": row, "col": np.arange(0, len(bits), 2), "b1": bits[::2], "b2": bits[1::2]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, values = (lambda s: (s[0], np.array(s[1], np.int64)))(state.get) if state.exists else (None, np.zeros(0, np.int64))
        if state.hasTimedOut:
            if len(values):
                yield done(key[0], row, values)
            state.remove()
            return
        whole = pd.concat(list(batches), ignore_index=True).sort_values(["row", "col"], na_position="last", kind="stable")
        ends, packets = whole["row"].isna().any(), whole[whole["row"].notna()]
        rows, pixels = packets["row"].to_numpy(np.int64), packets[["v1", "v2"]].to_numpy(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(rows)] if len(rows) else []
        for a, b in zip(edges, edges[1:]):
            if row is not None and row != rows[a]:
                yield done(key[0], row, values)
                values = np.zeros(0, np.int64)
            row, values = int(rows[a]), np.append(values, pixels[a:b].ravel())
        if ends and row is not None:
            yield done(key[0], row, values)
            row = None
        if row is None:
            state.remove()
        else:
            state.update((row, values.tolist()))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return packets.groupBy("source").applyInPandasWithState(step, OUT, "row long, px array<int>", "append", kind)


def start(df: DataFrame, sink: str = "noop", checkpoint: str | None = None, available_now: bool = False, **options: str) -> StreamingQuery:
    out = df.writeStream.format(sink).outputMode("append")
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    for k, v in options.items():
        out = out.option(k, v)
    return (out.trigger(availableNow=True) if available_now else out).start()


def drain(query: StreamingQuery, poll_s: float = 0.02) -> None:
    """Waits until the batch that is being worked on has come out, and stops the query: what was taken in is not lost."""
    done = lambda: (query.lastProgress or {}).get("batchId", -1)
    before = done()
    while query.isActive and query.status["isTriggerActive"] and done() == before:
        time.sleep(poll_s)
    query.stop()


def run_for(query: StreamingQuery, duration_ms: int = 0) -> str:
    """Waits for the end, for the duration (0: none) or for a signal, drains and stops the query. Returns the cause.

    A batch that begins meanwhile is worked on again when the query starts from its checkpoint: nothing is lost.
    """
    asked: list[int] = []
    old = {s: signal.signal(s, lambda n, _: asked.append(n)) for s in (signal.SIGINT, signal.SIGTERM)}
    end = time.monotonic() + duration_ms / 1000
    try:
        while not asked and not (duration_ms and time.monotonic() >= end):
            if query.awaitTermination(0.1 if not duration_ms else max(0.001, min(0.1, end - time.monotonic()))):
                return "source exhausted"
        drain(query)
        return "signal" if asked else "duration"
    finally:
        for s, f in old.items():
            signal.signal(s, f)


def dropped_and_peak(query: StreamingQuery) -> dict[str, int]:
    """From the progress so far: rows in, and the most in one batch. Nothing is ever dropped."""
    rows = [p["numInputRows"] for p in query.recentProgress]
    return {"input": sum(rows), "peak_batch": max(rows, default=0), "dropped": 0}
