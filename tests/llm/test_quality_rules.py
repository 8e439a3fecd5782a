import random
import re

import duckdb
import pandas as pd
import pytest

from scanloom.llm import oracle, quality_rules as Q

PROSE = "The old man of the sea was known in the village and to all of them he told a story of the wind. "


def prose(seed=1, common=("the", "the", "of", "and", "to", "in", "a")):
    rng = random.Random(seed)
    rare = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    words = [rng.choice(common) if rng.random() < 0.2 else rng.choice(rare) for _ in range(400)]
    return ". ".join(" ".join(words[k : k + 10]).capitalize() for k in range(0, 400, 10)) + "."


TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    "a b c a b c a b c",
    "x " * 200,
    "line one here\nline one here\n\n \nline one here\nother",
    PROSE * 3,
    prose(),
    "### $$$ %%% &&& " * 60,
    "中文 " * 300 + "終",
    "ABC DEF! " * 100,
    "".join(chr(97 + (k * 7919) % 26) + ("" if k % 5 else " ") for k in range(9000)),
    "a\x0bb\x0cc\rd e　f",
]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len({*lines}), len(hit)


GERMAN = ("der", "der", "die", "und", "in", "den", "von")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "kept", 1, "en") for k, t in enumerate(TEXTS)] + [(0, None, "kept", 1, None), (None, PROSE * 3, "kept", 1, "xx")]
    rows += [(100 + k, prose(k, GERMAN if k % 3 == 0 else ("the", "of", "to")), "kept", 1, "de" if k % 3 == 0 else "en") for k in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, lang string")


def test_counts(docs):
    for r in Q.score(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_same_as_sql(docs):
    documents = docs.select("doc_id", "text", "lang").toPandas()  # noqa: F841
    want = duckdb.sql(oracle.SQL["op10_quality_rules"]).df()
    got = Q.score(docs, keep=["doc_id"]).toPandas()[list(want.columns)]
    key = lambda d: d.astype(object).where(d.notna(), None).sort_values(list(d.columns), key=lambda c: c.astype(str)).values.tolist()
    assert key(got) == key(want) and got["kept"].sum() > 5


def test_verdicts_and_filter(docs):
    kept = {r.doc_id for r in Q.keep_good(docs).collect()}
    assert {8, *range(100, 112)} <= kept and not kept & {0, 1, 2, 3, 4, 5, 9, 10, 11}
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.keep_good(docs.limit(0)).collect() == []


def test_references_are_measured(docs):
    """By plain sums over the documents of a language that pass the base rules."""
    refs = Q.language_references(docs)
    assert [*refs] == ["de", "en"]
    own = [r.text for r in docs.collect() if r.lang == "de"]
    words = [w for t in own for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    classes, names, shares = refs["de"]
    assert names == Q.WORDS["de"] and abs(sum(shares) - 1) < 1e-9
    assert shares[:12] == [sum(w in (x, x.capitalize()) for w in words) / len(words) for x in names]
    letters = "".join(words)
    assert classes[:4] == [sum(test(c) for c in letters) / len(letters) for test in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in Q.PUNCTUATION)]


def test_no_references(spark):
    df = spark.createDataFrame([(1, prose(), None), (2, "short", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.kept, r.class_distance) for r in Q.score(df).collect()} == {1: (True, None), 2: (False, None)}


def test_distances(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(Q.js_distance(F.array(F.lit(0.5), F.lit(0.5)), [0.5, 0.5]).alias("same"), Q.js_distance(F.array(F.lit(1.0), F.lit(0.0)), [1e-12, 1 - 1e-12]).alias("apart")).first()
    assert row.same == 0 and row.apart == pytest.approx(1, abs=1e-6)


def test_no_python(docs, monkeypatch):
    plans = []
    own = Q.stored
    monkeypatch.setattr(Q, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    plans.append(Q.score(docs)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any(x in p for p in plans for x in ("Python", "Arrow", "Exchange"))


def test_filter_judges_by_both_distances(spark, docs):
    """Words of no language with strange characters between them are kept by neither histogram alone, but by the sum of both."""
    refs = Q.language_references(docs)
    rng = random.Random(2)
    syllables = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    junk = " ".join(w + ("|" if k % 3 == 0 else "") for k, w in enumerate(syllables))
    df = spark.createDataFrame([(1, junk, "en"), (2, prose(77), "en")], "doc_id long, text string, lang string")
    score = {r.doc_id: r for r in Q.score(df, references=refs).collect()}
    assert max(score[1].class_distance, score[1].word_distance) <= Q.LIMIT < score[1].class_distance + score[1].word_distance
    assert [r.doc_id for r in Q.keep_good(df, references=refs).collect()] == [2]


def test_clashing_columns_and_long_texts(spark):
    long = "word and " * 200_000 + "the end " * 3
    df = spark.createDataFrame([(1, long, 1, 2, 3, 4, "en")], "doc_id long, text string, __text int, `a.b` int, N_Words int, c0 int, lang string")
    out = Q.score(df)
    assert out.columns == ["doc_id", "text", "__text", "a.b", "c0", "lang", *Q.MADE]
    row = out.first()
    assert tuple(row)[2:5] == (1, 2, 4) and tuple(row)[6:11] == plain(long)
