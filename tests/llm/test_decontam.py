import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import decontam as D
from scanloom.llm import textops

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, n):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name) if name is not None else "")
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Été", "x1", "naïve", "word", "中文", "a", "b", "c"]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(k, some(rng.randint(1, 9))) for k in range(30)] + [(30, None), (31, ""), (32, "!!!"), (33, "the"), (33, "the of"), (None, "null item words"), (34, some(20)), (35, some(20))]
    docs = [some(rng.randint(0, 60)) for _ in range(60)] + [items[-1][1].upper() + ", " + some(5), None, "", "...", "null item words", "the " * 30_000, items[-2][1].replace(" ", "\n--")]
    d = spark.createDataFrame([(k % 50, t, k, "x") for k, t in enumerate(docs)], "doc_id long, text string, k long, found string")
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("size", [3, 13])
@pytest.mark.parametrize("chunk, broadcast", [(20_000, 8 << 20), (5, 0)])
def test_against_brute_force(tables, monkeypatch, size, chunk, broadcast):
    """Windows in one chunk and broadcast, or in many and shuffled."""
    monkeypatch.setattr(D, "CHUNK_WINDOWS", chunk)
    monkeypatch.setattr(D, "MOST_BROADCAST", broadcast)
    docs, items, d, b = tables
    out = D.find(d, b, window=size)
    want = plain(docs, items, size)
    rows = out.select("k", "found", D.hit_words(F.col("found")).alias("n")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.found.n_words, r.n, sorted(r.found["items"])) == want[r.k], docs[r.k][:50]
        assert all(a.last < b.first - 1 for a, b in zip(r.found.spans, r.found.spans[1:]))


def test_texts_are_read_once(spark, tables, tmp_path):
    """The index is written in one pass over the texts; what follows reads the index."""
    docs, _, d, b = tables
    index = D.build(d, keep=["k"])
    plan = D.phrases(index, b)._jdf.queryExecution().toString()
    assert index.rows.count() == len(docs) and "c1" not in index.postings.columns and "text" not in plan


def test_clashing_columns(spark, tables):
    docs, _, d, b = tables
    odd = d.selectExpr("doc_id", "text", "k AS `a.b`", "1 AS slice", "2 AS ord", "3 AS terms", "4 AS c0", "5 AS spans")
    for out in (D.find(odd, b), D.find_near(odd, "the of", 5), D.remove_contaminated(odd, b)):
        rows = out.collect()
        assert out.columns[:8] == odd.columns and {tuple(r)[3:8] for r in rows} == {(1, 2, 3, 4, 5)}
        assert all(r["text"] == docs[r["a.b"]] for r in rows)


def test_removal_and_empty_tables(tables):
    docs, items, d, b = tables
    want = {k for k, (n, hit, _) in enumerate(plain(docs, items, 13)) if not (hit and 20 * hit >= n)}
    kept = D.remove_contaminated(d, b)
    assert kept.columns == d.columns and {r.k for r in kept.collect()} == want
    assert D.remove_contaminated(d.limit(0), b).collect() == []
    assert D.remove_contaminated(d, b.limit(0)).count() == len(docs)


def test_proximity():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["p", "q", "r", "s", "t"], 30)).encode() for _ in range(5)]
    found = textops.scan_words(texts, textops.WORD)
    index = D.Postings.unpacked(*D.Postings.made(found).packed())
    inverse = index.numbers(found.hash)
    assert all((inverse[index.of(k)] == k).all() for k in range(5)) and index.counts.sum() == 150
    for terms in ([0, 1], [0, 1, 2], [3, 3], [4]):
        for span in (1, 3, 6):
            got = index.near(np.array(terms), span)
            for first, last in got:
                assert last - first < span and {*terms} <= {*inverse[first : last + 1].tolist()}
            for k in range(5):
                a, b = found.bounds[k], found.bounds[k + 1]
                some = any({*terms} <= {*inverse[i : min(i + span, b)].tolist()} for i in range(a, b))
                assert some == any(a <= first and last < b for first, last in got)


def test_proximity_operator(spark):
    df = spark.createDataFrame([(1, "a x b y"), (2, None), (3, "b. A"), (4, "a x x x b"), (5, "a a")], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.near] for r in D.find_near(df, "b A", 3).collect()}
    assert got == {1: [(0, 2)], 2: [], 3: [(0, 1)], 4: [], 5: []}
    assert all(r.near == [] for r in D.find_near(df, "", 3).collect())
