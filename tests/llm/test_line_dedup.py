import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scanloom.llm import line_dedup as L

LONG = ["This is a line that is well over forty characters, number %d" % k for k in range(6)]


def plain(rows, least_docs=5):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(doc)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if key(x) not in keeper or (doc is not None and keeper[key(x)] == doc)]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def made():
    rng = random.Random(5)
    rows = []
    for doc in range(60):
        lines = [rng.choice(LONG + ["short", "", " \t", "É" * 40, "é" * 40, "own line of document %d with some more characters" % doc]) for _ in range(rng.randint(1, 30))]
        rows.append((doc, "\n".join(rng.choice([x, "  " + x + "\t", x.upper(), x + "\r"]) for x in lines)))
    rows += [(7, rows[7][1]), (8, "\n".join(LONG)), (None, LONG[0] + "\nx"), (None, LONG[1]), (100, None), (101, ""), (102, "\n\n"), (103, "\n".join(LONG * 500)), (104, LONG[2] + "\n"), (105, "a" * 300_000)]
    return rows


@pytest.mark.parametrize("ranges", [8, 40])
def test_against_plain(spark, ranges):
    """With many ranges every hash crosses their borders."""
    rows = made()
    df = spark.createDataFrame([(d, t, k, "mine") for k, (d, t) in enumerate(rows)], "doc_id long, text string, k long, pos string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(ranges == 8).lower())
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        out = L.dedup_lines(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = plain(rows)
    assert len(out) == len(rows)
    for r in out:
        n, dropped, kept = want[r.k]
        assert (r["__n_lines"], r["__n_dropped"], r.text or "", r.pos) == (n, dropped, kept, "mine"), r.k
    assert sum(w[1] for w in want) > 500


def test_bitmaps(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string")
    for r in L.keep_bitmaps(df).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.bitmap), np.uint8))
        assert (bits == 0).sum() == r.n_dropped > 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(df).collect() == []


@pytest.mark.parametrize("docs", [4, 5])
def test_least_docs(spark, docs):
    df = spark.createDataFrame([(k, LONG[0]) for k in range(docs)], "doc_id long, text string")
    assert sum(r["__n_dropped"] for r in L.dedup_lines(df).collect()) == (4 if docs == 5 else 0)


@pytest.mark.parametrize("least", [1, 2, 5])
@pytest.mark.parametrize("size, ranges", [(1, 1), (3, 1), (1000, 1), (2, 5), (7, 30)])
def test_stream_decides(spark, least, size, ranges):
    """Batches and ranges of any size: first documents of hashes stay, if enough documents follow."""
    rng = random.Random(size * ranges)
    rows = sorted(((h, 0, d, d, p) for h in range(6) for d in rng.sample(range(12), rng.randint(1, 9)) for p in range(rng.randint(1, 4))), key=lambda r: (r[0], -r[2], r[4]))
    names, cuts = ["h1", "h2", "doc", "th", "pos"], sorted(rng.sample(range(1, len(rows)), ranges - 1))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    batches = [[pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part[k : k + size]]) for k in range(0, len(part), size)] for part in parts]
    ends = {}
    for part, own in enumerate(batches):
        for r in (r for b in L.borders(iter(own), least, part) for r in b.to_pylist()):
            ends.setdefault((r["h1"], r["h2"]), set()).add((part, r["doc"]))
    carried = {k: (max(d for _, d in v), len({d for _, d in v}) >= least) for k, v in ends.items() if len({p for p, _ in v}) > 1}
    got = [tuple(r.values()) for own in batches for b in L.first_occurrences(iter(own), carried, least) for r in b.to_pylist()]
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(6)}
    assert got == [r[2:] for r in rows if len(docs[r[0]]) >= least and r[2] != max(docs[r[0]])]


def test_the_sort_decides(spark, monkeypatch):
    """Without it the lines that stay are others."""
    df = spark.createDataFrame([(k, "\n".join(LONG)) for k in range(40)], "doc_id long, text string").repartition(4)
    want = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert want[39] == "\n".join(LONG) and {want[k] for k in range(39)} == {""}
    kind = type(df)
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda self, *columns: self)
    assert {r.doc_id: r.text for r in L.dedup_lines(df).collect()} != want


def test_clashing_columns(spark):
    names = ["doc_id", "text", "bitmap", "th", "own", "c0", "__n_dropped", "a.b", "keep"]
    df = spark.createDataFrame([(k, "\n".join(LONG), "x", "x", "x", "x", "x", "x", "x") for k in range(6)], names)
    out = L.dedup_lines(df, n_lines="before", n_dropped="gone")
    assert out.columns == [*names, "before", "gone"]
    assert {(*r[2:9], r.gone, r.before) for r in out.collect()} == {("x",) * 7 + (6, 6), ("x",) * 7 + (0, 6)}
    assert L.dedup_lines(df).columns == [*(n for n in names if n != "__n_dropped"), "__n_lines", "__n_dropped"]
