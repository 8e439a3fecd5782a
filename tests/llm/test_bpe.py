import hashlib
import random
import struct

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from tokenizers import Tokenizer

from scanloom.llm import bpe, textops
from scanloom.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)


def texts():
    rng = random.Random(1)
    letters = "aaabcdethinoréüñßΣσİ中文😀's't've 0129 \t\n\x1c\x85　<|>/w!?.,#$"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += ["".join(rng.choice("aath") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    return out + ["", " ", "<|endoftext|>a <|startoftext|><|endoftext|>", "a" * 30_000, "ΑΣ ΑΣ.", "é Å", "</w>", "can't CAN'T we'Ve"]


def test_same_as_the_library(library):
    coder = bpe.loaded(VOCABULARY)
    many = coder.encode_all(texts())
    for text, ids, said in zip(texts(), many, coder.decode_all(many)):
        assert (ids, said) == wanted(library, text), text[:50]
        assert coder.encode(text) == ids
    assert coder.encode_all([]) == coder.decode_all([]) == [] and coder.encode_all([""]) == [b""] and coder.decode_all([b""]) == [""]


def test_splits_where_unicode_has_white_space():
    """Arrow's white space is the pattern's, but for four control characters, whose texts go another way."""
    space = regex.compile(f"[{bpe.SPACE}]")
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    parts = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in letters]))).to_pylist()
    assert {c for c, n in zip(letters, parts) if n == 2} == {c for c in letters if space.match(c)} | set("\x1c\x1d\x1e\x1f")


def test_registered_query(spark, library):
    from scanloom.llm import queries

    docs = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()}
    got = queries.op2_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids, said = wanted(library, docs[r.doc_id])
        assert tuple(r)[1:] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_dataframe(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "The cat's hat", "x"), (3, "The cat's hat", "x"), (None, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = bpe.encode(df, VOCABULARY).collect()
    assert len(got) == 5
    for r in got:
        assert (bytes(r.ids), r.decoded) == wanted(library, r.text) and r.n_tokens * 4 == len(r.ids) and r.extra == "x"
    short = bpe.encode(df, VOCABULARY, keep=["doc_id"], digests=True).collect()
    for r in short:
        ids, said = wanted(library, {1: None, 2: "", 3: "The cat's hat", None: "<|endoftext|>"}[r.doc_id])
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, VOCABULARY).drop("decoded"), VOCABULARY).collect()
    assert sorted(r.decoded for r in back) == sorted(r.decoded for r in got)
    assert bpe.encode(df.limit(0), VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("extra", "ids"), VOCABULARY)


def test_memory_is_given_back_after_a_task(spark, monkeypatch):
    df, taken, given = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), [], []
    own = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: (taken.append(f), own(self, f, schema))[1])
    monkeypatch.setattr(textops, "release", lambda: given.append(True))
    bpe.encode(df, VOCABULARY)
    out = taken[0](iter([pa.RecordBatch.from_pydict({"c0": [1], "c1": ["some words"], "c2": ["some words"]})]))
    assert next(out)["n_tokens"].to_pylist() == [2] and not given
    assert next(out, None) is None and given == [True]
