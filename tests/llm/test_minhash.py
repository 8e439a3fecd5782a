import random
import re

import numpy as np
import pytest

from scanloom.llm import minhash as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def plain(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def made(seed, copies):
    """A group of near copies on both sides of the limit, smaller groups, chains, exact copies, and edge cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    base = [word() for _ in range(120)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, 14)):
            text[rng.randrange(len(text))] = rng.choice([word(), "the"])
        rows.append(" ".join(text))
    for _ in range(25):
        text = [word() for _ in range(rng.randint(3, 60))]
        rows.append(" ".join(text))
        for _ in range(rng.randint(0, 4)):
            text = list(text)
            text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if rng.random() < 0.3 else " ".join(text))
    for k in range(1, 9):
        rows += [" ".join("abcdefghi"[:k]), " ".join("abcdefghi"[: k + 1])]
    rows += [None, "", " \n", None, "one", "one", "ONE", "a b", "word " * 30_000]
    rng.shuffle(rows)
    return [(k * 3 % 1009, t) for k, t in enumerate(rows)] + [(5000, rows[0]), (None, rows[1]), (None, "nobody else has this text"), (3, rows[2])]


@pytest.mark.parametrize("words, copies, block", [(2, 150, 7), (5, 60, 512)])
def test_against_brute_force(spark, monkeypatch, words, copies, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = made(words, copies)
    want = plain(rows, words)
    df = spark.createDataFrame([(d, t, k, "x") for k, (d, t) in enumerate(rows)], "doc_id long, text string, k long, node string")
    own = M.numbered(df)
    found = {r.rid: r for r in M.cluster(own, words=words).collect()}
    assert len(found) == len(rows)
    for r in own.select("rid", "k").collect():
        assert (found[r.rid].n_shingles, found[r.rid].component) == want[r.k], rows[r.k]


def family(rng, members, share):
    """Texts of which any two have about that share of a template in common, and twins and triplets among them."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, rows = [word() for _ in range(100)], []
    for k in range(members):
        own = template[: int(100 * share)] + [word() for _ in range(100 - int(100 * share))]
        rows.append(" ".join(own))
        for _ in range(k % 3):
            own = list(own)
            own[rng.randrange(int(100 * share), 100)] = word()
            rows.append(" ".join(own))
    return rows


def test_families_below_the_limit_do_not_meet(spark, monkeypatch):
    """Documents of one template are found in one bucket, but what is theirs alone keeps them apart before they meet."""
    block = 5
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(11)
    rows = [(k, t) for k, t in enumerate(family(rng, 60, 0.8) + family(rng, 20, 0.9))]
    df = M.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    met = []
    own = M.tasks_for
    monkeypatch.setattr(M, "tasks_for", lambda work, a_task: met.append(work or 0) or own(work, a_task))
    found = {r.doc: r.component for r in M.cluster(df, words=2).collect()}
    assert [(found[k]) for k, _ in rows] == [c for _, c in plain(rows, 2)]
    assert met[0] < (len(rows) / block) ** 2 / 4


def test_registered_query_and_recall(spark):
    """Of all true links of every 50th document, and of all others, none is missed on the smallest table."""
    from scanloom.llm import queries

    docs = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    want = {d: w for (d, _), w in zip(docs, plain(docs, 2))}
    got = queries.op8_minhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one(spark):
    rows = made(9, 30)
    want = plain(rows, 5)
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, th string, rid int, `a.b` int")
    kept = M.keep_one(df)
    assert kept.columns == df.columns and {(r.rid, r["a.b"]) for r in kept.collect()} == {(1, 2)}
    groups = {c for n, c in want if n}
    got = kept.collect()
    assert len([r for r in got if shingles(r.text, 5)]) == len(groups)
    assert len([r for r in got if not shingles(r.text, 5)]) == sum(n == 0 for n, _ in want)
    assert M.keep_one(df.limit(0)).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, share in [(5, 0.5), (60, 0.8), (1000, 0.3), (5000, 0.9)]:
        seen = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            k = round(n * 2 * share / (1 + share))
            a, b = x[:n], x[n - k : 2 * n - k]
            seen.append(((M.sketch(a) == M.sketch(b)).mean(), k / (2 * n - k)))
        got, true = np.array(seen).T
        assert abs(got.mean() - true[0]) < 0.04
    assert (M.sketch(x[:3]) == M.sketch(x[[2, 0, 1]])).all()


def test_percent(spark):
    with pytest.raises(ValueError):
        M.cluster(spark.range(1), percent=70)
