import random

import numpy as np

from scanloom.llm import quality_knn as K


def made(rng, good):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    return " ".join(words) if good else " ".join(w + rng.choice(["###", "%%%", "!!"]) for w in words)


def data(spark):
    rng = random.Random(2)
    rows = [(k, made(rng, k % 4 != 0), 5.0) for k in range(300)] + [(900, None, 5.0), (901, "", 5.0), (902, "ab", 5.0), (903, "x" * 500_000, 5.0), (None, "abc abd", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(200)] + [(900, 0), (5, 1), (950, 1), (None, 1)], "doc_id long, quality int")
    return docs, labels


def test_held_out(spark):
    docs, labels = data(spark)
    model = K.fit(docs, labels, "doc_id", "text", "quality")
    out = K.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = {r.doc_id: r.score for r in out.collect()}
    assert len(got) == 305 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= K.PREDICT_AT) == (k % 4 != 0) for k in range(200, 300)]) > 0.97
    assert got[901] == got[900] == model.prior
    assert K.score(docs.limit(0), model).collect() == []
    again = {r.doc_id: r.score for r in K.score(docs, K.fit(docs.repartition(5), labels, "doc_id", "text", "quality")).collect()}
    assert max(abs(got[k] - again[k]) for k in got) < 1e-6


def test_votes_are_exact(spark):
    docs, labels = data(spark)
    model = K.fit(docs, labels, "doc_id", "text", "quality")
    texts = [r.text.encode() for r in docs.filter("doc_id BETWEEN 200 AND 230").collect()]
    for text, score in zip(texts, model.score(texts)):
        own = model.project(K.term_counts([text]))[0]
        near = sorted(((float(own @ v), float(y), float(w)) for v, y, w in zip(model.vectors, model.labels, model.weights)), reverse=True)[: K.NEAREST]
        votes = [(max(s, 0) ** K.SHARPNESS * w, y) for s, y, w in near]
        want = (sum(v * y for v, y in votes) + 1e-3 * model.prior) / (sum(v for v, _ in votes) + 1e-3)
        assert abs(want - score) < 1e-4


def test_registered_query(spark):
    """Every score by plain loops over the labelled vectors; held-out rows are not learned from, and come out right."""
    import zlib

    from scanloom.llm import queries

    data = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, data, "documents").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, data, "labels").collect()}
    held_out = {k for k in docs if zlib.crc32(str(k).encode()) % 4 == 2}
    got = {r.doc_id: r for r in queries.op4_quality_knn(spark, data).collect()}
    assert got.keys() == docs.keys() and {k for k, r in got.items() if r.held_out} == held_out
    learned = spark.createDataFrame([(k, v) for k, v in labels.items() if k not in held_out], "doc_id long, quality int")
    model = K.fit(queries.table(spark, data, "documents"), learned, "doc_id", "text", "quality")
    assert len(model.labels) == len({*labels} - held_out)
    for k, text in docs.items():
        own = model.project(K.term_counts([text.encode()]))[0]
        near = sorted(((float(own @ v), float(y), float(w)) for v, y, w in zip(model.vectors, model.labels, model.weights)), reverse=True)[: K.NEAREST]
        votes = [(max(s, 0) ** K.SHARPNESS * w, y) for s, y, w in near]
        total = sum(v for v, _ in votes)
        want = (sum(v * y for v, y in votes) + 1e-3 * model.prior) / (total + 1e-3) if total else model.prior
        assert abs(got[k].score - want) < 1e-3 and got[k].predicted == (got[k].score >= 0.7)
    right = [got[k].predicted == v for k, v in labels.items() if k in held_out]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_clashing_columns(spark):
    docs, labels = data(spark)
    odd = docs.selectExpr("doc_id", "text", "1 AS `a.b`", "2 AS c0", "3 AS Score")
    out = K.score(odd, K.fit(docs, labels, "doc_id", "text", "quality"), column="verdict")
    assert out.columns == [*odd.columns, "verdict"] and {tuple(r)[2:5] for r in out.collect()} == {(1, 2, 3)}
