"""The registered queries over the smallest tables: schemas, laws, SQL, and the pipeline against its parts."""

import math
import re
import struct
import zlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from test_decontam import plain as plain_hits
from test_line_dedup import plain as plain_lines
from test_minhash import plain as plain_groups
from test_quality_rules import plain as counts
from tokenizers import Tokenizer

import corpus_pipeline
import __spark_entry__ as entry
from scanloom.llm import oracle, quality_rules, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_names():
    own = queries.queries()
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in own] == list(range(1, 11))
    assert {*own, "pipeline"} <= {*entry.queries()} and {*oracle.SQL} <= {*entry.oracle_sql()}


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda d: sorted(tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_shards(spark, duck):
    got = queries.op3_sharding(spark, DATA).toPandas()
    docs = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert len(got) == len(docs) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    assert got.groupby("shard").size().between(len(docs) // 24, len(docs) // 24 + 1).all()
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def _features(text):
    """Base verdict, shares of character classes (null if too few) and words, in plain Python."""
    n_words, n_chars, _, _, n_repeat = counts(text)
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    solid = "".join(own)
    some = [sum("a" <= c <= "z" for c in solid), sum("A" <= c <= "Z" for c in solid), sum("0" <= c <= "9" for c in solid), sum(c in quality_rules.PUNCTUATION for c in solid)]
    beyond = len(solid.encode()) - len(solid)
    some += [max(0, len(solid) - sum(some) - beyond), beyond]
    return n_words < 50 or 100 * n_repeat > 50 * n_words, n_chars, some, own


def _good(rows):
    """The rows (doc_id, text, lang, ...) that the quality stage keeps."""

    def distance(p, q):
        return math.sqrt(max(0, sum(x * math.log2(2 * x / (a + b)) for a, b in zip(p, q) for x in (a, b) if x) / 2))

    def hits(own, words):
        found = [sum(w in (x, x.capitalize()) for w in own) for x in words]
        return [*found, len(own) - sum(found)]

    features, refs = [_features(r[1] or "") for r in rows], {}
    for lang, words in quality_rules.WORDS.items():
        own = [f for f, r in zip(features, rows) if r[2] == lang and not f[0]]
        if own:
            total = [sum(x) for x in zip(*(hits(f[3], words) for f in own))]
            refs[lang] = ([sum(f[2][k] for f in own) / sum(f[1] for f in own) for k in range(6)], words, [x / sum(total) for x in total])
    kept = []
    for r, (failed, n_chars, some, own) in zip(rows, features):
        if not failed:
            near = min((distance([x / n_chars for x in some], classes) if n_chars >= 200 else 0) + distance([x / len(own) for x in hits(own, words)], shares) for classes, words, shares in refs.values())
            kept += [r] if near <= quality_rules.LIMIT else []
    return kept


def test_pipeline_against_a_plain_version(spark, duck):
    library = Tokenizer.from_file(queries.VOCABULARY)
    library.no_padding()
    library.no_truncation()
    rows = duck.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()
    rows = _good(rows)
    rows = [(r[0], kept if n else r[1], *r[2:]) for r, (_, n, kept) in zip(rows, plain_lines([r[:2] for r in rows]))]
    rows = [r for r, (n, component) in zip(rows, plain_groups([r[:2] for r in rows], 5)) if not n or r[0] == component]
    found = plain_hits([r[1] for r in rows], duck.sql("SELECT item_id, text FROM benchmark").fetchall(), 13)
    rows = [r for r, (n, hit, _) in zip(rows, found) if not (hit and 20 * hit >= n)]
    want = {}
    for doc, text, lang, source in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc] = (lang, source, len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False))
    got = {r.doc_id: (r.lang, r.source, r.n_tokens, bytes(r.ids), r.decoded) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(got) > 100


def test_stages_keep_clashing_columns(spark):
    docs = queries.table(spark, DATA, "documents").selectExpr("*", "1 AS __n_dropped", "2 AS bitmap", "3 AS rid", "4 AS `a.b`", "5 AS slice", "6 AS kept", "7 AS c0", "8 AS __row", "9 AS n_words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(1, 10))}, name


def test_stages_on_empty_tables_and_nulls(spark):
    schema = queries.table(spark, DATA, "documents").schema
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", None)], schema)
    for df in (spark.createDataFrame([], schema), nulls):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, DATA).collect()
