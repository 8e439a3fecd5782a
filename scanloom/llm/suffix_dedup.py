"""Long repeated byte strings, found by run-length indexes over the parts of the corpus that repeat.

Every window of win bytes has a key, the least hash of its k-byte strings; equal windows have equal keys.
Consecutive windows with one key are a segment.  Only segments whose key occurs twice, in one text or several, are
followed up; equal segments are one, with a number of copies.  They are routed by key, so that equal windows meet, and
packed into blocks.  Each block gets a run-length index: the runs of its Burrows-Wheeler transform (head, length, where
it leads), the text places of both ends of each run, and how far the rows match there.  Copies only lengthen the runs.
Matching statistics are streamed against that index, all segments of the block at once, from their last byte to the
first: inside a run the match with the row above, or below, grows by one byte, and at the run's ends it is the sample.
Windows whose match is at least win long are marked, and every byte that a marked window covers.

A key with more than BLOCK_BYTES of different segments is too large for a block: these segments are keyed once more by
longer strings, at last by whole windows, so that equal windows still meet; the same index marks them.  Nothing is
capped, and no group is gathered in one task.

Texts are whole UTF-8 byte strings (null: empty), however long; a text is cut into overlapping pieces only for the
hashing.  Equal rows are copies of each other.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.llm import textops
from scanloom.llm.shared import cut, numbered, tasks_for

WIN = 400
K = 128
PIECE = 1 << 18
BLOCK_BYTES = 1 << 20
#: Text that one task indexes.
TASK_BYTES = 4 << 20
#: Windows of a segment; longer runs of one key (periodic text) are several segments.
MOST_WINDOWS = 512


def pieces(texts: list[bytes], win: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, first, text, offset): about PIECE bytes at a time; part i is data[first[i]:first[i + 1]], from that text and offset."""
    parts, text, offset, held = [], [], [], 0
    for k, raw in enumerate(texts):
        for at in range(0, max(len(raw) - win + 1, 0), PIECE):
            part = raw[at : at + PIECE + win - 1]
            parts.append(part)
            text.append(k)
            offset.append(at)
            held += len(part)
            if held >= PIECE:
                yield _joined(parts, text, offset)
                parts, text, offset, held = [], [], [], 0
    if parts:
        yield _joined(parts, text, offset)


def _joined(parts: list[bytes], text: list[int], offset: list[int]):
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=first[1:])
    return np.frombuffer(b"".join(parts), np.uint8), first, np.array(text), np.array(offset)


class Rolling:
    """Hashes of the substrings of some data."""

    def __init__(self, data: np.ndarray, salt: int = 1):
        n = len(data)
        self.power, self.inverse = textops.powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        values = textops.mix(np.arange(256, dtype=np.uint64) + np.uint64(salt << 8))
        np.cumsum(values[data] * self.power[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textops.mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return textops.mix((self.total[k:] - self.total[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def string_lengths(win: int, k: int) -> list[int]:
    """k, and longer ones with a fourth of the places in a window each, down to the window itself."""
    places, out = win - k + 1, [k]
    while places > 1:
        places //= 4
        out.append(win - max(places, 1) + 1)
    return out


def segments(texts: list[bytes], win: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, content, start, windows, again) of the runs of windows with one key, of MOST_WINDOWS at most.

    again: the key's string occurs twice in the segment.  Equal windows of one segment hold it at one offset, so the
    first such string has left the window before the segment ends; where none does, a segment has no equal windows.
    """
    for data, first, text, offset in pieces(texts, win):
        rolling = Rolling(data)
        strings = rolling.every(k)
        key = sliding_min(strings, win - k + 1)
        part = np.repeat(np.arange(len(text)), np.diff(first))[: len(key)]
        fits = np.arange(len(key)) + win <= first[part + 1]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        runs = np.flatnonzero(new)
        lengths = np.diff(np.append(runs, len(key)))
        cuts = (lengths - 1) // MOST_WINDOWS + 1
        place = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(runs, cuts) + place * MOST_WINDOWS
        end = np.minimum(begin + MOST_WINDOWS, np.repeat(runs + lengths, cuts))
        start, stop = begin[fits[begin]], end[fits[begin]]
        own = part[start]
        stop = np.minimum(stop, first[own + 1] - win + 1)
        content = rolling.of(start, stop + win - 1)
        leaves = np.concatenate([[0], np.cumsum(strings[: len(key)] == key)])
        again = leaves[stop - 1] > leaves[start]
        yield text[own], key[start].view(np.int64), content.view(np.int64), start - first[own] + offset[own], stop - start, again


class RunIndex:
    """Run-length index of parts, each with a number of copies: the transform's runs and samples at their ends.

    heads, starts, lengths: letter (0: a part begins), first row and rows of each run; copies of a part are rows of their
    own.  to: the row that a run's first row leads to, one letter further to the left.  first_place, last_place: text
    places of both ends of a run.  above, below: how far the rows that these ends lead to match the rows next to them (no
    further than the longest part needs).  near: the run of each 2 ** wide-th row, so that a row's run is found at once.
    """

    def __init__(self, parts: list[bytes], copies: list[int] | None = None):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.copies = np.ones(len(parts), np.int64) if copies is None else np.array(copies, np.int64)
        self.first = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(self.sizes + 1, out=self.first[1:])
        text = np.zeros(int(self.first[-1]), np.int16)  # separators are 0, bytes 1 to 256
        for k, p in enumerate(parts):
            text[self.first[k] : self.first[k + 1] - 1] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
        packed = words(text)
        order = suffix_order(text, packed)
        last = text[order - 1]  # the transform; the text's first place wraps round to its last separator
        rows = np.repeat(self.copies, self.sizes + 1)[order]
        row = np.cumsum(rows) - rows
        new = np.ones(len(order), bool)
        new[1:] = (last[1:] != last[:-1]) | (last[1:] == 0)
        head = np.flatnonzero(new)
        self.heads, self.starts = last[head], row[head]
        self.lengths = np.diff(np.append(self.starts, row[-1] + rows[-1]))
        self.first_place, self.last_place = order[head], order[np.append(head[1:], len(order)) - 1]
        ends = np.argsort(order[: len(parts)])  # separators are the first rows, one after the other in the text
        self.ends = row[: len(parts)][ends]
        by = np.argsort(self.heads, kind="stable")
        self.to = np.empty(len(head), np.int64)
        self.to[by] = np.cumsum(self.lengths[by]) - self.lengths[by]
        self.above, self.below = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        meet = np.flatnonzero((self.heads[by[1:]] == self.heads[by[:-1]]) & (self.heads[by[1:]] != 0))
        upper, lower = by[meet], by[meet + 1]
        self.above[lower] = self.below[upper] = match(packed, self.last_place[upper] - 1, self.first_place[lower] - 1, int(self.sizes.max()))
        rows = int(self.starts[-1] + self.lengths[-1])
        self.wide = max((rows // (2 * len(head))).bit_length() - 1, 0)
        self.near = np.searchsorted(self.starts, np.arange((rows >> self.wide) + 1) << self.wide, side="right") - 1

    def statistics(self) -> list[np.ndarray]:
        """For each part and place, how far the text from there matches another place (copies are), within the part."""
        out = self._streamed()
        return [out[a : a + n] for a, n in zip(self.first.tolist(), self.sizes.tolist())]

    def _streamed(self) -> np.ndarray:
        """The statistics of all parts, 0 at each separator."""
        out = np.zeros(int(self.first[-1]), np.int32)
        order = np.argsort(-self.sizes, kind="stable")
        sizes, at, row, copies = -self.sizes[order], self.first[order] + self.sizes[order] - 1, self.ends[order], self.copies[order]
        up, down = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        runs = np.stack([self.starts, self.starts + self.lengths, self.to - self.starts, self.above, self.below], axis=1)  # one read a run
        steps = np.arange(1, int(self.sizes.max(initial=0)) + 1)
        for done, n in zip(steps.tolist(), np.searchsorted(sizes, -steps, side="right").tolist()):  # letters from the right, of all parts that have so many
            if n < len(row):
                row, up, down, at, copies = row[:n], up[:n], down[:n], at[:n], copies[:n]
            run = self.near.take(row >> self.wide)
            here = runs.take(run, axis=0)
            later = np.flatnonzero(row >= here[:, 1])
            if len(later):
                here[later] = runs.take(run[later] + 1, axis=0)
                later = later[row[later] >= here[later, 1]]
                here[later] = runs.take(np.searchsorted(self.starts, row[later], side="right") - 1, axis=0)
            begin, stop, leads, above, below = here.T
            up = np.where(row > begin, up + 1, np.minimum(above, done))
            down = np.where(row + copies < stop, down + 1, np.minimum(below, done))
            out[at] = np.where(copies > 1, done, np.maximum(up, down))
            row, at = row + leads, at - 1
        return out

    def repeated(self, win: int) -> Iterator[list[tuple[int, int]]]:
        """For each part, the ranges of places from which win bytes occur elsewhere."""
        flag = np.zeros(int(self.first[-1]) + 1, np.int8)
        flag[1:] = self._streamed() >= win
        step = np.diff(flag)  # each range ends within its part: the separator's statistic is 0
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        bounds = np.searchsorted(begin, self.first).tolist()
        own = np.repeat(self.first[:-1], np.diff(bounds))
        begin, end = (begin - own).tolist(), (end - own).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield list(zip(begin[a:b], end[a:b]))


def words(text: np.ndarray) -> tuple[np.ndarray, int, int]:
    """For each place and the end, the letters from there in one number (beyond the end: 0), how many, and the bits of one.

    Letters are numbered from 1 among those that occur, so as many as fit 63 bits are at least 7, for 257 letters.
    """
    code = np.cumsum(np.bincount(text) > 0)
    bits = int(code[-1]).bit_length()
    most, size = 63 // bits, 1
    word = np.zeros(len(text) + 1 + 2 * most, np.int64)
    word[: len(text)] = code[text]
    while size < most:
        more = min(size, most - size)
        word = (word[:-size] << (bits * more)) | (word[size:] >> (bits * (size - more)))
        size += more
    return word[: len(text) + 1].copy(), size, bits


def suffix_order(text: np.ndarray, packed: tuple[np.ndarray, int, int] | None = None) -> np.ndarray:
    """By doubling; places that are told apart drop out.

    So do groups, after the first round, that follow another: those after their members are just the members of one
    group, so that their order is the same.  lead is the place whose order a place takes over, shift what lies between
    their ranks.
    """
    word, size, _ = packed or words(text)
    n = len(text)
    order = np.argsort(word[:n])
    key = word[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.full(n + 1, -1, np.int64)  # what lies beyond the end is least
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the place of the group's first member
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    lead = shift = None
    while len(at):
        own = order[at]
        beyond = np.minimum(own + size, n)
        key = rank[own] * (n + 1) + (rank[beyond] if lead is None else rank[lead[beyond]] + shift[beyond]) + 1
        fine = np.argsort(key, kind=None if lead is None else "stable")  # later the keys are mostly in order, which that sort uses
        own, key = own[fine], key[fine]
        told = np.ones(len(at), bool)
        told[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(told)
        order[at] = own
        rank[own] = np.repeat(at[first], np.diff(np.append(first, len(at))))
        size *= 2
        rest = ~(told & np.append(told[1:], True))
        at, own, told = at[rest], own[rest], told[rest]
        if lead is None:
            lead = np.arange(n + 1)
            lead[own[following(rank, own, told)]] = n
            lead = np.minimum.accumulate(lead[::-1])[::-1]
            shift = rank - rank[lead]
            at = at[lead[own] == own]
    if lead is not None:
        order[(rank[lead] + shift)[:n]] = np.arange(n)
    return order


def following(rank: np.ndarray, own: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Of places in groups (told: one begins), whether the places after a group's members are just the members of one group."""
    if not len(own):
        return told
    first = np.flatnonzero(told)
    count = np.diff(np.append(first, len(own)))
    members = np.zeros(len(rank), np.int64)
    members[rank[own[first]]] = count
    after = rank[own + 1]
    parts = np.add.reduceat(after != np.repeat(after[first], count), first, dtype=np.int64)
    return np.repeat((parts == 0) & (members[after[first]] == count), count)


def match(packed: tuple[np.ndarray, int, int], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How long the suffixes at a and b, two places, agree; where they do for most letters, so many at least."""
    word, size, bits = packed
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        differ = word[a[open_] + out[open_]] ^ word[b[open_] + out[open_]]
        same = differ == 0
        x = differ[~same]
        top = np.frexp((x & ~(x >> 1)).astype(np.float64))[1]  # the highest bit; what is cleared below it could be rounded up
        out[open_[~same]] += (size * bits - top) // bits
        open_ = open_[same]
        out[open_] += size
        open_ = open_[out[open_] < most]
    return out


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
SPANS_DDL = "spans array<struct<a:long,b:long>>"


def mark_blocks(batches: Iterator[pa.RecordBatch], win: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, content, copies, data) sorted by key: content and its repeated ranges, block by block; a key is never cut."""
    keys, contents, copies, parts, held = [], [], [], [], 0

    def done() -> pa.RecordBatch:
        spans = list(RunIndex(parts, copies).repeated(win))
        rows = [(h, c, [{"a": a, "b": b} for a, b in s]) for h, c, s in zip(keys, contents, spans) if s]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], SPANS)], ["key", "content", "spans"])

    for batch in batches:
        for h, c, n, data in zip(*(batch[x].to_pylist() for x in ("key", "content", "copies", "data"))):
            if held >= BLOCK_BYTES and h != keys[-1]:
                yield done()
                keys, contents, copies, parts, held = [], [], [], [], 0
            keys.append(h)
            contents.append(c)
            copies.append(n)
            parts.append(data)
            held += len(data)
    if parts:
        yield done()


def find(texts: DataFrame, win: int, strings: list[int]) -> DataFrame:
    """x, y and spans, ranges (a, b) of window starts whose strings occur elsewhere, of texts (x, y, copies, text).

    x and y name a text and are the same at each reading.  strings: how long the strings of the keys are, at each level.
    """
    k, *longer = strings

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                x, y, copies = (batch[c].to_numpy(zero_copy_only=False) for c in ("x", "y", "copies"))
                for own, key, content, start, windows, again in segments(textops.texts_of(batch["text"]), win, k):
                    columns = [x[own], y[own], copies[own], key, content, start.astype(np.int64), windows.astype(np.int64), again]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "copies", "key", "content", "start", "windows", "again"])

    every = texts.mapInArrow(cut_up, "x long, y long, copies long, key long, content long, start long, windows long, again boolean")
    twice = every.groupBy("key").agg(F.sum("copies").alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("key")
    # Tables that are written before a join have an exchange of their own there, so that a hot key can be split.
    some = cut(every.join(cut(twice, small=True), "key").drop("again"))
    each = some.groupBy("key", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("x", "y", "start", "windows")).alias("at"))
    each = cut(each.select("key", "content", "copies", "at.*"))
    large = each.groupBy("key").agg(F.sum(F.col("windows") + (win - 1)).alias("size"), F.count(F.lit(1)).alias("m")).filter(f"size > {BLOCK_BYTES} AND m > 1").select("key", F.lit(True).alias("hot"))
    large = cut(large if longer else large.limit(0), small=True)  # at the last level equal keys are equal windows
    todo = each.join(large, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = todo.groupBy("x", "y").agg(F.collect_list(F.struct("key", "content", "copies", "start", "windows", "hot")).alias("parts"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                for raw, own in zip(textops.texts_of(batch["text"]), batch["parts"].to_pylist()):
                    for first in range(0, len(own), 4096):
                        rows = [(p["key"], p["content"], p["copies"], p["hot"], raw[p["start"] : p["start"] + p["windows"] + win - 1]) for p in own[first : first + 4096]]
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "content", "copies", "hot", "data"])

    parts = cut(texts.join(wanted, ["x", "y"]).select("text", "parts").mapInArrow(take, "key long, content long, copies long, hot boolean, data binary"))
    cold = parts.filter("not hot").select("key", "content", "copies", "data")
    n = tasks_for(cold.agg(F.sum(F.octet_length("data"))).first()[0], TASK_BYTES)
    marked = cold.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda batches: mark_blocks(batches, win), f"key long, content long, {SPANS_DDL}")
    if not large.isEmpty():
        again = find(parts.filter("hot").select(F.col("key").alias("x"), F.col("content").alias("y"), "copies", F.col("data").alias("text")), win, longer)
        marked = marked.unionByName(again.withColumnsRenamed({"x": "key", "y": "content"}))
    ranges = F.transform("spans", lambda s: F.struct((s.a + F.col("start")).alias("a"), (s.b + F.col("start")).alias("b")))
    return some.join(cut(marked), ["key", "content"]).groupBy("x", "y").agg(F.flatten(F.collect_list(ranges)).alias("spans"))


def covered(spans: list[dict], win: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows cover."""
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["a"]):
        a, b = s["a"], s["b"] + win - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, win: int = WIN, k: int = K, digests: bool = False) -> DataFrame:
    """The columns keep (default: all but text), removed (byte ranges, as judged on the input) and kept (the other bytes).

    With digests n_bytes, n_removed, n_spans and kept_sha256 instead.  Columns of the new names must not be kept.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digests else ["removed", "kept"]
    if clash := {*keep} & {*made}:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    rows = numbered(docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text")))
    texts = rows.select(F.col("rid").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(1).cast("long").alias("copies"), F.col("text").cast("binary").alias("text"))
    spans = find(texts, win, string_lengths(win, k)).select(F.col("x").alias("rid"), "spans")
    both = rows.join(spans, "rid", "left").drop("rid")
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else "removed array<struct<a:long,b:long>>, kept binary"
    schema = StructType(both.drop("text", "spans").schema.fields + StructType.fromDDL(ddl).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                out: list[tuple] = []
                for raw, spans in zip(textops.texts_of(batch["text"]), batch["spans"].to_pylist()):
                    gone = covered(spans or [], win)
                    edges = [0, *[x for s in gone for x in s], len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest()) if digests else ([{"a": a, "b": b} for a, b in gone], left))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digests else [SPANS, pa.binary()]
                new = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*[batch[f"k{i}"] for i in range(len(keep))], *new], schema.names)

    return both.mapInArrow(run, schema).toDF(*keep, *made)
