"""Lines that many documents share stay in one document only.

Lines are handled as 128-bit hashes of their keys.  All lines long enough are range-partitioned by (hash, document,
place), so that even one hash with a third of all lines spreads over many ranges, sorted in that order, the largest
document first, and streamed: the first document of a hash is its keeper; when the stream has met enough documents of a
hash, the lines of all but the first are marked.  A hash that crosses a border of ranges is joined up from what each
range says of its first and last hash; that is two hashes a range, and no more documents of each than must share a line.
What comes back per document is a compressed bitmap of the lines to keep, not text.

A line's key is the line without white space at its ends, A-Z lower-cased.  Documents count by doc_id
(rows with one doc_id are one document; null is one more); the largest holds the lines that stay, so a null
doc_id never does.  Null and empty texts are one empty line.  Rows that repeat get equal results.  Texts are whole,
however long: a text's lines are rows of their own, only its bitmap is one value.  Empty tables give empty ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.shared import cut, positional

LEAST_CHARS = 40
LEAST_DOCS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _groups(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of rows sorted by hash and document: first rows of the hashes, whether a row is a document's first, codes of documents and their values."""
    h1, h2 = (rows[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
    known = pc.dictionary_encode(rows["doc"], null_encoding="encode")
    codes = known.indices.to_numpy(zero_copy_only=False)
    hash_ = np.ones(len(codes), bool)
    hash_[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    doc = hash_.copy()
    doc[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(hash_), doc, codes, known.dictionary


def _hash(rows: pa.RecordBatch, at: int) -> tuple[int, int]:
    return rows["h1"][int(at)].as_py(), rows["h2"][int(at)].as_py()


def borders(batches: Iterator[pa.RecordBatch], least_docs: int, part: int) -> Iterator[pa.RecordBatch]:
    """Of one sorted range: its first and last hash, with their first least_docs documents."""
    ends, kind = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("doc").type
        starts, new, codes, values = _groups(batch)
        stops = [*starts[1:].tolist(), len(codes)]
        for g in sorted({0, len(starts) - 1}):
            name, at = _hash(batch, starts[g]), slice(starts[g], stops[g])
            own = [values[int(c)].as_py() for c in codes[at][new[at]][:least_docs]]
            if ends and ends[-1][0] == name:
                ends[-1][1].extend(d for d in own if d not in ends[-1][1])
            else:
                ends = [*ends[:1], (name, own)]
    rows = [(part, *name, d) for name, docs in ends for d in docs[:least_docs]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), kind))], ["part", "h1", "h2", "doc"])


def first_occurrences(batches: Iterator[pa.RecordBatch], carried: dict[tuple[int, int], tuple[object, bool]], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, doc, th, pos) of one sorted range: those of common hashes that are not of the hash's first document.

    carried: of hashes that cross the range's borders, the first document of all and whether the hash is common.
    """
    held, decided = None, {}  # the last hash's rows while it has too few documents; its first document when it has enough
    for batch in chain(batches, [None]):
        rows = batch if held is None else held if batch is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held = None
        if rows is None or not rows.num_rows:
            continue
        starts, new, codes, values = _groups(rows)
        common, keeper = np.add.reduceat(new.astype(np.int64), starts) >= least_docs, codes[starts].copy()
        for g in {0, len(starts) - 1}:
            told = carried.get(_hash(rows, starts[g])) or decided.get(_hash(rows, starts[g]))
            if told:
                common[g] = told[1]
                keeper[g] = pc.index(values, pa.scalar(told[0], values.type)).as_py() if told[0] is not None else -1
        stop = len(codes)
        name = _hash(rows, starts[-1])
        if common[-1] and name not in decided:
            decided = {name: (values[int(keeper[-1])].as_py(), True)} if name not in carried else {}
        elif batch is not None and not common[-1] and name not in carried:
            stop = int(starts[-1])
            held = rows.slice(stop)
        marked = np.repeat(common, np.diff(np.append(starts, len(codes)))) & (codes != np.repeat(keeper, np.diff(np.append(starts, len(codes)))))
        out = rows.slice(0, stop).filter(pa.array(marked[:stop])).select(["doc", "th", "pos"])
        if out.num_rows:
            yield out


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, th (hash of the text), n_dropped and bitmap (zlib of bits, the first line highest) of documents that lose lines."""
    own = docs.select(F.col(f"`{doc}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.posexplode(lines_of(F.col(f"`{text}`"))).alias("pos", "line"))
    keys = own.withColumn("key", key_of(F.col("line"))).filter(F.length("key") >= least_chars)
    # Written once: the ranges' bounds are sampled from the hashes, not from the texts again.
    lines = cut(keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "th", "pos"))
    ordered = ["h1", "h2", F.desc_nulls_last("doc"), "pos"]
    ranges = cut(lines.repartitionByRange(*ordered).sortWithinPartitions(*ordered))
    kind = lines.schema["doc"].dataType.simpleString()
    ends = ranges.select("h1", "h2", "doc").mapInArrow(lambda batches: borders(batches, least_docs, TaskContext.get().partitionId()), f"part int, h1 long, h2 long, doc {kind}")
    crossing = ends.groupBy("h1", "h2").agg(F.count_distinct("part").alias("parts"), F.max("doc").alias("keeper"), F.count_distinct(F.struct("doc")).alias("n")).filter("parts > 1")
    carried = docs.sparkSession.sparkContext.broadcast({(r.h1, r.h2): (r.keeper, r.n >= least_docs) for r in crossing.collect()})  # two hashes a range at most
    marked = ranges.mapInArrow(lambda batches: first_occurrences(batches, carried.value, least_docs), f"doc {kind}, th long, pos int")
    return marked.groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("places")).select("doc", "th", F.size("places").alias("n_dropped"), packed("places").alias("bitmap"))


@F.pandas_udf(T.BinaryType())
def packed(places: pd.Series) -> pd.Series:
    """Bits in whole bytes up to the last dropped line; later lines are kept."""

    def bits(drop: np.ndarray) -> bytes:
        keep = np.ones(int(drop[-1]) // 8 * 8 + 8, bool)
        keep[np.asarray(drop, np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return places.map(bits)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def unpacked(bitmaps: pd.Series) -> pd.Series:
    return bitmaps.map(lambda x: None if x is None else np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text", n_lines: str = "__n_lines", n_dropped: str = "__n_dropped") -> DataFrame:
    """All columns and rows, the text without the dropped lines, and n_lines (before) and n_dropped.

    A text that loses nothing stays as it is, null included.  Columns named as n_lines and n_dropped are replaced.
    """
    docs = docs.drop(n_lines, n_dropped)
    names, left = docs.columns, positional(docs)
    own, raw = (F.col(f"c{names.index(c)}") for c in (doc, text))
    right = bitmaps.select(F.col("doc").alias("d"), F.col("th").alias("t"), F.col("n_dropped").alias("n"), "bitmap")
    both = left.withColumns({"own": own, "th": F.xxhash64(raw)}).join(right, F.col("own").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    both = both.withColumn("keep", unpacked("bitmap"))
    lines = lines_of(raw)
    kept = F.concat_ws("\n", F.filter(lines, lambda x, i: F.coalesce(F.get(F.col("keep"), i), F.lit(True))))
    columns = [F.when(F.col("keep").isNull(), raw).otherwise(kept) if c == text else F.col(f"c{k}") for k, c in enumerate(names)]
    return both.select(*columns, F.size(lines).cast("long"), F.coalesce("n", F.lit(0)).cast("long")).toDF(*names, n_lines, n_dropped)


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, n_lines: str = "__n_lines", n_dropped: str = "__n_dropped") -> DataFrame:
    """apply_bitmaps of keep_bitmaps."""
    return apply_bitmaps(docs, keep_bitmaps(docs, doc, text, least_chars, least_docs), doc, text, n_lines, n_dropped)
