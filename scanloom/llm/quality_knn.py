"""Quality scores by the votes of the nearest labelled documents in a latent-semantic space.

Terms are hashed strings of three bytes, and two for repetition: words equal to the word before, and words
whose last three words came before.  A bounded sample of labelled documents gives term weights (tf-idf)
and a latent basis (randomised SVD); their vectors and labels are broadcast.  Every document is projected,
its cosine with every labelled vector is computed in exact blocked products, and the labels of the NEAREST
are weighted by similarity.  Documents are not shuffled.

The sample is bounded by SAMPLE rows for each label (those with the least hashes of their ids), whatever the
size of the input; so are the driver's memory and what is broadcast.  Votes are weighted back to the labels'
shares in all labelled rows.  Documents without three bytes (null and empty ones too) get the share of label 1.
Texts are whole, however long; repeated rows get equal scores, and of equally near labelled vectors any may vote.  Empty
documents give an empty table; without labelled rows nothing can be learned, which is an error.  Null labels and ids are
not learned from.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.llm import textops
from scanloom.llm.shared import positional

BUCKETS = 4096
TERMS = BUCKETS + 2
RANK = 96
NEAREST = 25
SAMPLE = 2000
SHARPNESS = 8
PREDICT_AT = 0.7


def term_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, TERMS) counts of hashed byte trigrams, and of repeated words and word trigrams."""
    out = np.zeros((len(texts), TERMS), np.float32)
    words = textops.scan_words(texts, textops.NOT_SPACE)
    for k, raw in enumerate(texts):
        own = words.hash[words.bounds[k] : words.bounds[k + 1]]
        three = textops.shingles(own, 3)
        out[k, BUCKETS] = (own[1:] == own[:-1]).sum()
        out[k, BUCKETS + 1] = len(three) - len(np.unique(three))
        for at in range(0, max(len(raw) - 2, 0), textops.BLOCK):
            x = np.frombuffer(raw[at : at + textops.BLOCK + 2], np.uint8).astype(np.uint32)
            code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
            out[k, :BUCKETS] += np.bincount(code, minlength=BUCKETS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(counts) * self.idf) @ self.basis)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for at in range(0, len(texts), 256):
            own = self.project(term_counts(texts[at : at + 256]))
            near = own @ self.vectors.T
            k = min(NEAREST, near.shape[1])
            top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
            vote = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS * self.weights[top]
            total = vote.sum(axis=1)
            some = total > 0
            out[at : at + 256][some] = ((vote * self.labels[top]).sum(axis=1)[some] + 1e-3 * self.prior) / (total[some] + 1e-3)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str) -> Model:
    """labels: doc and label 0 or 1 of the rows to learn from. Of rows that share an id the least label counts."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).groupBy(F.col(f"`{doc}`").alias("doc")).agg(F.min(label).alias("label"))
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        raise ValueError("no labelled rows")
    order = F.xxhash64(F.lit(7), "doc")
    sample = None
    for value in sorted(shares):
        part = known.filter(F.col("label") == value).orderBy(order, "doc").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                counts = [np.log1p(term_counts([t])[0]).astype(np.float16) for t in textops.texts_of(batch["text"])]
                at = [np.flatnonzero(c).astype(np.uint16) for c in counts]
                yield pa.RecordBatch.from_arrays([batch["doc"], batch["label"], pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].tobytes() for c, a in zip(counts, at)], pa.binary())], ["doc", "label", "at", "tf"])

    kind = rows.schema
    found = rows.select("doc", "label", "text").mapInArrow(count, StructType([kind["doc"], kind["label"]]).add("at", "binary").add("tf", "binary"))
    found = found.orderBy(order, "label").limit(2 * SAMPLE).collect()  # in an order of its own, so that a fit can be repeated; repeated ids do not make it larger
    tf = np.zeros((len(found), TERMS), np.float32)
    for k, r in enumerate(found):
        tf[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["tf"], np.float16)
    y = np.array([r["label"] for r in found], np.float64)
    prior = shares.get(1, 0) / sum(shares.values())
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(tf * idf)
    rng = np.random.default_rng(7)
    wide = min(RANK + 16, max(1, min(x.shape)))
    q = np.linalg.qr(x @ rng.standard_normal((TERMS, wide)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:RANK].T.copy()
    in_sample = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weights = np.array([shares.get(int(v), 0) / in_sample[int(v)] for v in y])
    return Model(idf, basis, unit(x @ basis), y, weights / max(weights.mean(), 1e-9) if len(weights) else weights, prior)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns and rows, with the score of label 1. A column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(column)
    out = positional(kept.select("*", F.col(f"`{text}`")))  # the text once more: its own column may be the one that is replaced
    *own, raw = out.columns
    schema = StructType([*out.schema.fields[:-1]]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, raw):
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(sent.value.score(textops.texts_of(batch[raw])), pa.float64())], schema.names)

    return out.mapInArrow(run, schema).toDF(*kept.columns, column)
