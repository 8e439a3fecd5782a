"""Benchmark passages in training documents, found by a distributed positional inverted index.

The index is written once, by slices: ranges of about SLICE_BYTES of documents, each with its sorted terms, their
counts and their ascending places (as differences).  The benchmark is the query set, as distinct windows of terms.  If
these are small, by a check of their size, every slice gets all of them.  Else the counts of the windows' terms in all
slices tell each window's rarest term, and a window is sent to the slices that hold that term, in chunks of
CHUNK_WINDOWS at most.  In a slice a window is found by intersecting offset-adjusted postings, from the slice's rarest
term on.  So texts are read once however large the benchmark is.

Terms are 64-bit hashes of words: two words of a vocabulary of a billion that any window asks for are taken for each
other with a chance of 1e-7 for a benchmark of a thousand words, and windows of several words need several such pairs.

Words are maximal runs of digits, a-z (A-Z is lower-cased) and characters beyond ASCII.  Null and empty texts have no
words; items without words are never found; equal items are found together, null ids by the empty string.  Repeated
rows are rows of their own.  Texts are whole, a very long one is a slice by itself.  Empty tables give empty ones, and
an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm import textops
from scanloom.llm.shared import MOST_BROADCAST, cut, positional, small, stored, tasks_for

WINDOW = 13
SLICE_BYTES = 1 << 20
CHUNK_WINDOWS = 20_000


class Postings:
    """Of some texts, the places of each term, ascending. bounds: the texts' word ranges."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.bounds, self.terms, self.counts, self.places = bounds, terms, counts, places
        self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    @classmethod
    def made(cls, words: textops.Words) -> Postings:
        order = np.argsort(words.hash, kind="stable")
        terms, counts = np.unique(words.hash[order], return_counts=True)
        return cls(words.bounds.astype(np.int64), terms, counts.astype(np.int64), order.astype(np.int64))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """bounds, terms, counts, and the differences of each term's places."""
        gaps = np.diff(self.places, prepend=0)
        first = self.starts[:-1]
        gaps[first] = self.places[first]
        return tuple(x.astype(kind).tobytes() for x, kind in ((self.bounds, "<i8"), (self.terms, "<u8"), (self.counts, "<i4"), (gaps, "<i4")))

    @classmethod
    def unpacked(cls, bounds: bytes, terms: bytes, counts: bytes, gaps: bytes) -> Postings:
        own = cls(np.frombuffer(bounds, "<i8"), np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<i4").astype(np.int64), np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64))
        before = np.concatenate([[0], own.places])[own.starts[:-1]]
        own.places = own.places - np.repeat(before, own.counts)
        return own

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Of each term its number here, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def of(self, number: int) -> np.ndarray:
        return self.places[self.starts[number] : self.starts[number + 1]]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, side="right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Places where the terms, by their numbers, follow each other within one text."""
        order = np.argsort(self.counts[terms], kind="stable")
        found = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            there = self.of(terms[k]) - k
            at = np.minimum(np.searchsorted(there, found), len(there) - 1)
            found = found[there[at] == found]
        found = found[found >= 0]
        return found[self.text_of(found) == self.text_of(found + len(terms) - 1)]

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """Proximity: for places of the rarest term, the least range (first, last) of at most span words with all terms."""
        need = np.unique(terms)
        need = need[np.argsort(self.counts[need], kind="stable")]
        out = set()
        for place in self.of(need[0]).tolist():
            text = int(self.text_of(np.array([place]))[0])
            low = max(place - span + 1, int(self.bounds[text]))
            high = min(place + span, int(self.bounds[text + 1]))
            seen: list[tuple[int, int]] = []
            for term in need[1:]:
                own = self.of(term)
                part = own[np.searchsorted(own, low) : np.searchsorted(own, high)]
                if not len(part):
                    break
                seen += [(p, int(term)) for p in part.tolist()]
            else:
                best, last = None, {int(need[0]): place}
                for p, term in sorted([*seen, (place, int(need[0]))]):
                    last[term] = p
                    if len(last) == len(need):
                        first, end = min(last.values()), max(last.values())
                        if first <= place <= end and end - first < span and (best is None or end - first < best[1] - best[0]):
                            best = (first, end)
                if best:
                    out.add(best)
        return sorted(out)


@dataclass
class Index:
    """rows: ord, n_words and the kept columns (c0, c1, ...: names) of each document; postings: a row a slice. Both have slice."""

    names: list[str]
    rows: DataFrame
    postings: DataFrame


POSTINGS = ["bounds", "terms", "counts", "places"]


def build(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> Index:
    """Writes the index of the documents' texts, beside the columns keep (default: all)."""
    names = docs.columns if keep is None else keep
    source = positional(docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`")))
    own, column = source.columns[:-1], source.columns[-1]
    fields = [T.StructField("slice", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("n_words", T.LongType())]
    schema = T.StructType([*fields, *[T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]], *[T.StructField(c, T.BinaryType()) for c in POSTINGS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in textops.slices(whole, column, SLICE_BYTES):
                n, postings = batch.num_rows, Postings.made(textops.scan_words(textops.texts_of(batch[column]), textops.WORD))
                none = [pa.nulls(n, pa.binary())] * len(POSTINGS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(postings.bounds)), *[batch[c] for c in own], *none], schema.names)
                packed = [pa.array([x], pa.binary()) for x in postings.packed()]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), *[pa.nulls(1, batch[c].type) for c in own], *packed], schema.names)
                number += 1

    table = stored(source.mapInArrow(run, schema), "postings")
    return Index(names, table.filter("ord IS NOT NULL").drop(*POSTINGS), table.filter("terms IS NOT NULL").select("slice", *POSTINGS))


def windows_of(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """item (as a string) and terms, for each distinct window of each item; one of fewer words is one window."""
    source = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                words = textops.scan_words(textops.texts_of(batch["text"]), textops.WORD)
                for name, a, b in zip(batch["item"].to_pylist(), words.bounds.tolist(), words.bounds[1:].tolist()):
                    size = min(window, b - a)
                    if size:
                        parts = np.unique(np.lib.stride_tricks.sliding_window_view(words.hash[a:b].view(np.int64), size), axis=0)
                        terms = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, size, dtype=np.int32)), pa.array(parts.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), terms], ["item", "terms"])

    return cut(source.mapInArrow(run, "item string, terms array<long>").distinct(), small=True)


def rarest(index: Index, windows: DataFrame) -> DataFrame:
    """slice and terms: the slices that hold a window's rarest term. Windows with a term that is nowhere are left out."""
    vocabulary = cut(windows.select(F.explode("terms").alias("term")).distinct())
    known = None
    if vocabulary.count() * 8 <= MOST_BROADCAST:
        known = index.postings.sparkSession.sparkContext.broadcast(np.sort(np.array([r.term for r in vocabulary.collect()], np.int64).view(np.uint64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                terms, counts = np.frombuffer(batch["terms"][k].as_buffer(), "<u8"), np.frombuffer(batch["counts"][k].as_buffer(), "<i4")
                if known is not None:
                    some = np.isin(terms, known.value, assume_unique=True)
                    terms, counts = terms[some], counts[some]
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), batch["slice"][k].as_py())), pa.array(counts.astype(np.int64))], ["term", "slice", "n"])

    found = index.postings.select("slice", "terms", "counts").mapInArrow(count, "term long, slice long, n long")
    found = cut(found if known is not None else found.join(vocabulary, "term", "left_semi"))
    totals = cut(found.groupBy("term").agg(F.sum("n").alias("total")))
    each = windows.select("terms", F.explode(F.array_distinct("terms")).alias("term")).join(small(totals, F.lit(16), MOST_BROADCAST), "term", "left")
    least = each.groupBy("terms").agg(F.min(F.struct("total", "term")).alias("least"), F.count(F.lit(1)).alias("n"), F.count("total").alias("known")).filter("n = known")
    return least.select("terms", F.col("least.term").alias("term")).join(found.select("term", "slice"), "term").select("slice", "terms")


def covered(spans: list[tuple[int, int]]) -> list[dict]:
    """The maximal runs of words (first, last) that the spans cover."""
    out: list[dict] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS_DDL = "spans array<struct<first:long,last:long>>"
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def by_size(windows: list[list[int]]) -> list[np.ndarray]:
    """The windows of each length, a row each."""
    sizes = np.array([len(w) for w in windows])
    return [np.array([windows[k] for k in np.flatnonzero(sizes == size)], np.int64) for size in np.unique(sizes)]


def _search(postings: Postings, windows: list[np.ndarray]) -> dict[int, tuple[list[tuple[int, int]], list[list[int]]]]:
    """By text: spans (first, last) of words in windows that occur, and those windows."""
    out: dict[int, tuple[list, list]] = {}
    for own in windows:
        size, terms = own.shape[1], postings.numbers(own.view(np.uint64))
        for k in np.flatnonzero((terms >= 0).all(axis=1)).tolist():
            places = postings.phrase(terms[k])
            texts = postings.text_of(places)
            edges = [0, *(np.flatnonzero(np.diff(texts)) + 1).tolist(), len(texts)] if len(texts) else []
            for a, b in zip(edges, edges[1:]):
                spans, found = out.setdefault(int(texts[a]), ([], []))
                at = places[a:b] - postings.bounds[texts[a]]
                new = np.flatnonzero(np.append(True, np.diff(at) > size))
                last = np.append(at[new[1:] - 1], at[-1]) + size - 1
                spans += zip(at[new].tolist(), last.tolist())
                found.append(own[k].tolist())
    return out


def phrases(index: Index, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """slice, ord, n_words, spans of hit words and items, of the documents in which windows of items occur."""
    items = windows_of(benchmark, item, text, window)
    windows = cut(items.select("terms").distinct(), small=True)
    meet, every = index.postings, None
    if (windows.agg(F.sum(8 * F.size("terms") + 16)).first()[0] or 0) <= MOST_BROADCAST:
        every = index.postings.sparkSession.sparkContext.broadcast(by_size([r.terms for r in windows.collect()]))
    else:
        chunks = tasks_for(windows.count(), CHUNK_WINDOWS)
        probes = rarest(index, windows).withColumn("chunk", F.pmod(F.xxhash64("terms"), F.lit(chunks)))
        asked = cut(probes.groupBy("slice", "chunk").agg(F.collect_list("terms").alias("windows")))
        meet = meet.join(asked, "slice").select("slice", *POSTINGS, "windows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                postings = Postings.unpacked(*(batch[c][k].as_buffer() for c in POSTINGS))
                found = _search(postings, by_size(batch["windows"][k].as_py()) if every is None else every.value)
                at = sorted(found)
                columns = [
                    pa.array([batch["slice"][k].as_py()] * len(at), pa.int64()),
                    pa.array(at, pa.int32()),
                    pa.array([int(postings.bounds[t + 1] - postings.bounds[t]) for t in at], pa.int64()),
                    pa.array([covered(found[t][0]) for t in at], SPANS),
                    pa.array([found[t][1] for t in at], pa.list_(pa.list_(pa.int64()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "ord", "n_words", "spans", "windows"])

    found = cut(meet.mapInArrow(search, f"slice long, ord int, n_words long, {SPANS_DDL}, windows array<array<long>>"))
    named = found.select("slice", "ord", F.explode("windows").alias("terms")).join(items, "terms").groupBy("slice", "ord").agg(F.collect_set("item").alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [covered([(s["first"], s["last"]) for s in own]) for own in batch["spans"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("slice", "ord", "n_words", "items")], pa.array(spans, SPANS)], ["slice", "ord", "n_words", "items", "spans"])

    spans = found.groupBy("slice", "ord").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    return spans.join(named, ["slice", "ord"]).select("slice", "ord", "n_words", "items", "spans").mapInArrow(merge, f"slice long, ord int, n_words long, items array<string>, {SPANS_DDL}")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, found: str = "found", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) of all rows, with the struct found: n_words, spans of hit words (first, last), and items (as strings).

    An item of fewer than window words is one window of its own length.  A column named as found is replaced.
    """
    index = build(docs, text, [c for c in (docs.columns if keep is None else keep) if c != found])
    hits = cut(phrases(index, benchmark, item, item_text, window).drop("n_words"))
    size = 16 * F.size("spans") + F.aggregate("items", F.lit(24), lambda n, x: n + F.length(x) + 8)
    both = index.rows.join(small(hits, size, MOST_BROADCAST), ["slice", "ord"], "left")
    empty = [F.coalesce(c, F.array().cast(FOUND[c].dataType)).alias(c) for c in ("spans", "items")]
    return both.select(*[f"c{k}" for k in range(len(index.names))], F.struct("n_words", *empty)).toDF(*index.names, found)


def find_near(docs: DataFrame, words: str, span: int, text: str = "text", near: str = "near") -> DataFrame:
    """All columns and rows, with near: ranges (first, last) of at most span words that hold all the given words.

    Places are word numbers in the text.  Without any word there is no range.  A column named as near is replaced.
    """
    index = build(docs, text, [c for c in docs.columns if c != near])
    wanted = np.unique(textops.scan_words([words.encode()], textops.WORD).hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                postings = Postings.unpacked(*(batch[c][k].as_buffer() for c in POSTINGS))
                numbers, rows = postings.numbers(wanted), {}
                for first, last in postings.near(numbers, span) if len(wanted) and (numbers >= 0).all() else []:
                    t = int(postings.text_of(np.array([first]))[0])
                    rows.setdefault(t, []).append({"first": first - int(postings.bounds[t]), "last": last - int(postings.bounds[t])})
                yield pa.RecordBatch.from_arrays([pa.array([batch["slice"][k].as_py()] * len(rows), pa.int64()), pa.array([*rows], pa.int32()), pa.array([*rows.values()], SPANS)], ["slice", "ord", "spans"])

    hits = cut(index.postings.mapInArrow(run, f"slice long, ord int, {SPANS_DDL}"))
    both = index.rows.join(small(hits, 16 * F.size("spans") + 12, MOST_BROADCAST), ["slice", "ord"], "left")
    return both.select(*[f"c{k}" for k in range(len(index.names))], F.coalesce("spans", F.array().cast(FOUND["spans"].dataType))).toDF(*index.names, near)


def hit_words(found: Column) -> Column:
    return F.aggregate(found.spans, F.lit(0).cast("long"), lambda n, s: n + s.last - s.first + 1)


def is_contaminated(found: Column, share: int = 20) -> Column:
    """At least one word in share is hit."""
    return (hit_words(found) > 0) & (share * hit_words(found) >= found.n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    index = build(docs, text)
    hits = phrases(index, benchmark)
    gone = cut(hits.filter(is_contaminated(F.struct("n_words", "spans"))).select("slice", "ord"), small=True)
    kept = index.rows.join(small(gone, F.lit(12), MOST_BROADCAST), ["slice", "ord"], "left_anti")
    return kept.select(*[f"c{k}" for k in range(len(index.names))]).toDF(*index.names)
