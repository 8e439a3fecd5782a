import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from scanloom.llm import suffix_dedup as S


def plain(texts, win):
    count = Counter(t[i : i + win] for t in texts for i in range(len(t) - win + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - win + 1):
            if count[t[i : i + win]] > 1:
                gone[i : i + win] = b"\1" * win
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def made(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [piece(rng.randint(20, 120)) for _ in range(8)]
    rows = []
    for _ in range(60):
        rows.append("".join(rng.choice([rng.choice(shared), piece(rng.randint(0, 90))]) for _ in range(rng.randint(1, 6))))
    rows += [rows[3]] * 5 + ["ab" * 400, "a" * 700, "a" * 39, "xy" * 19, shared[0], None, "", None, piece(40), "tail " + shared[1]]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, block):
    """Small blocks send most keys on to longer strings, down to whole windows."""
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    monkeypatch.setattr(S, "TASK_BYTES", 4 * block)
    rows = made(block)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)], "doc_id long, text string, spans string").repartition(3)
    out = S.remove_repeats(df, win=40, k=16)
    assert out.columns == ["doc_id", "spans", "removed", "kept"]
    want = plain([(t or "").encode() for t in rows], 40)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        n, spans, kept = want[r.doc_id]
        assert (sum(s.b - s.a for s in r.removed), len(r.removed), bytes(r.kept)) == (n, spans, kept), r.doc_id


@pytest.mark.parametrize("piece, windows", [(1 << 18, 512), (100, 7), (50, 1)])
def test_segments_hold_each_window_once(monkeypatch, piece, windows):
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "MOST_WINDOWS", windows)
    texts = [(t or "").encode() for t in made(4)]
    for k in S.string_lengths(40, 16):
        keys, seen = {}, Counter()
        for segment in (x for columns in S.segments(texts, 40, k) for x in zip(*(c.tolist() for c in columns))):
            text, key, _, start, n, again = segment
            assert n <= windows
            inside = Counter(texts[text][i : i + 40] for i in range(start, start + n))
            assert again or max(inside.values()) == 1
            for i in range(start, start + n):
                seen[text, i] += 1
                assert keys.setdefault(texts[text][i : i + 40], key) == key
        assert seen == Counter((t, i) for t, raw in enumerate(texts) for i in range(len(raw) - 39))


def test_index_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abcdefgh", bytes([0, 1, 255])])
        base = bytes(rng.choice(letters) for _ in range(rng.randint(1, 200)))
        parts = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(len(base))
            parts.append(bytes(rng.choice(letters) for _ in range(rng.randint(0, 20))) + base[a : rng.randint(a, len(base))])
        copies = [rng.choice([1, 1, 1, 2, 9]) for _ in parts]
        win, index = rng.choice([1, 3, 12, 30]), S.RunIndex(parts, copies)
        text = [x for p in parts for x in [*(b + 1 for b in p), 0]]
        assert S.suffix_order(np.array(text, np.int16)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        count = Counter(p[i : i + win] for p, n in zip(parts, copies) for i in range(len(p) - win + 1) for _ in range(n))
        for p, spans in zip(parts, index.repeated(win)):
            assert [any(a <= i < b for a, b in spans) for i in range(len(p) - win + 1)] == [count[p[i : i + win]] > 1 for i in range(len(p) - win + 1)]
        for p, n, own in zip(parts, copies, index.statistics()):
            for i in range(len(p)):
                found = max([k for q in parts for j in range(len(q)) if q is not p or i != j for k in [common(p[i:], q[j:])]], default=0)
                assert own[i] == (len(p) - i if n > 1 else found)


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_the_transform_is_kept():
    """Runs, spelled out, are the letters before the sorted suffixes of all copies."""
    parts, copies = [b"banana", b"bandana", b""], [3, 1, 2]
    index = S.RunIndex(parts, copies)
    rows = sorted((p[i:], p[i - 1] + 1 if i else 0) for p, n in zip(parts, copies) for _ in range(n) for i in range(len(p) + 1))
    spelled = np.repeat(index.heads, index.lengths).tolist()
    assert len(spelled) == len(rows) and Counter(spelled) == Counter(c for _, c in rows)
    tails = sorted({x for x, _ in rows})
    for x in tails:  # rows of equal suffixes may come in any order
        at = [i for i, r in enumerate(rows) if r[0] == x]
        assert Counter(spelled[at[0] : at[-1] + 1]) == Counter(c for y, c in rows if y == x)
    assert index.lengths.sum() == sum(n * (len(p) + 1) for p, n in zip(parts, copies)) and len(index.heads) < len(rows)


def test_nothing_is_removed_without_the_index(spark, monkeypatch):
    monkeypatch.setattr(S, "mark_blocks", lambda batches, win: (b.slice(0, 0).select([0, 1]) for b in batches if False))
    df = spark.createDataFrame([(k, "same text " * 60) for k in range(20)] + [(99, "x" * 900)], "doc_id long, text string")
    assert {r.n_removed for r in S.remove_repeats(df, keep=["doc_id"], digests=True).collect()} == {0}


def test_very_long_texts_and_hot_passages(spark, monkeypatch):
    """Whole texts at 400 bytes: one over a megabyte, a periodic one, and a passage in very many texts."""
    monkeypatch.setattr(S, "BLOCK_BYTES", 50_000)
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    passage, long = piece(500), piece(1_200_000)
    rows = [long, piece(300) + long[700_000:700_900] + piece(50), "ab" * 200_000] + [piece(rng.randint(0, 200)) + passage[: rng.randint(350, 500)] + piece(rng.randint(0, 200)) for _ in range(150)] + [passage] * 30
    out = S.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), keep=["doc_id"], digests=True).collect()
    windows = Counter(t[i : i + 400] for t in map(str.encode, rows[1:2] + rows[3:]) for i in range(len(t) - 399))
    raw = rows[0].encode()
    for i in range(len(raw) - 399):  # the long text's windows, counted where they are seen elsewhere
        w = raw[i : i + 400]
        if w in windows:
            windows[w] += 1
    for r in out:
        t = rows[r.doc_id].encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if r.doc_id == 2 or windows.get(t[i : i + 400], 0) > 1:
                gone[i : i + 400] = b"\1" * 400
        assert (r.n_bytes, r.n_removed) == (len(t), sum(gone)), r.doc_id


def test_registered_query(spark):
    from scanloom.llm import queries

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = plain([(r.text or "").encode() for r in docs], 400)
    got = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and sum(n for n, _, _ in want) > 0
    for r, (n, spans, kept) in zip(docs, want):
        assert tuple(got[r.doc_id])[1:] == (len((r.text or "").encode()), n, spans, hashlib.sha256(kept).hexdigest())


def test_runs_are_few_in_repetitive_text():
    unit = bytes(np.random.default_rng(1).integers(0, 256, 500, np.uint8))
    assert len(S.RunIndex([unit] * 40).heads) < 40 * 501 / 10


def test_digests_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.remove_repeats(df, keep=["doc_id"], digests=True).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans, got[2].n_bytes) == (500, 500, 1, 0)
    assert S.remove_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.remove_repeats(df.withColumnRenamed("doc_id", "kept"))


def letters(parts):
    return np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0) for p in parts]).astype(np.int16)


@pytest.mark.parametrize("seed", range(6))
def test_order_and_matches_of_texts_with_much_in_common(seed):
    """Groups that follow another take over its order: repeats in families, runs of one letter, a text in itself."""
    rng = random.Random(seed)
    alphabet = [b"a", b"ab", bytes(range(256)), bytes(range(256)), b"abcdefgh", "é ".encode()][seed]
    piece = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    shared = [piece(rng.randint(30, 200)) for _ in range(4)]
    parts = [b"".join(rng.choice([piece(rng.randint(0, 9)), rng.choice(shared)]) for _ in range(rng.randint(0, 5))) for _ in range(25)]
    text = letters(parts)
    order, listed = S.suffix_order(text), text.tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: listed[i:])
    longest = S.match(S.words(text), order[:-1], order[1:], len(text))
    assert longest.tolist() == [common(listed[a:], listed[b:]) for a, b in zip(order[:-1], order[1:])]
    most = S.match(S.words(text), order[:-1], order[1:], 20)
    assert np.minimum(most, 20).tolist() == np.minimum(longest, 20).tolist()


def test_work_for_repeated_passages(monkeypatch):
    """A passage that occurs several times is not sorted anew in each round, and most rows' runs are found without a search."""
    rng = np.random.default_rng(5)
    piece = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    shared = [piece(700) for _ in range(40)]
    parts = [piece(30) + s + piece(30) for s in shared for _ in range(3)]
    n = sum(len(p) + 1 for p in parts)
    work = Counter()
    argsort, searchsorted = np.argsort, np.searchsorted
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (work.update(sort=len(x)), argsort(x, *a, **k))[1])
    monkeypatch.setattr(np, "searchsorted", lambda x, v, *a, **k: (work.update(search=np.size(v)), searchsorted(x, v, *a, **k))[1])
    S.suffix_order(letters(parts))
    assert work["sort"] < 3 * n
    index = S.RunIndex(parts)
    work.clear()
    marked = list(index.repeated(400))
    assert work["search"] < n / 10
    count = Counter(p[i : i + 400] for p in parts for i in range(len(p) - 399))
    for p, own in zip(parts, marked):
        assert [any(a <= i < b for a, b in own) for i in range(len(p) - 399)] == [count[p[i : i + 400]] > 1 for i in range(len(p) - 399)]
