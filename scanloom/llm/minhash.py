"""Near-duplicates by fast similarity sketches, banding and exact verification.

Sketch: in each round every shingle is hashed to a bin and a value; a bin keeps the least value of the
first round that reached it.  After T rounds, T more each serve one bin with all shingles, so every
coordinate is filled; coordinates agree with the probability of the Jaccard similarity, and as concentrated
as full MinHash.  BANDS bands of ROWS coordinates find a pair at similarity 0.8 but for odds of 1e-7.

Texts with equal shingle sets are one class; only classes are compared.  For each class in a bucket (equal
band) it is counted how many of its shingles no other such class has.  That bounds the similarity of every
pair from above, so classes with too many of their own are out, and of the others those with the fewest lead
their buckets.  Members are verified against the leader they meet most often, and where a bucket then still
holds several components, against the centre of its leader's.  Where components then remain, members outside
the centre's meet those of that centre, compared by what they differ in from it, in bounded cells, unless what only
their components have tells that they cannot be linked.  Links are confirmed on full sets (64-bit hashes of shingles).
Nothing is capped, and no bucket is spread out into its pairs.

Empty sets (null and empty texts) are linked with nothing.  Texts are whole, however long.  Rows are documents of their
own; a null doc_id counts as the largest.  Empty tables give empty ones; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textops
from scanloom.llm.graph import components
from scanloom.llm.shared import cut, fresh, numbered, small, tasks_for

BANDS, ROWS = 40, 5
T = BANDS * ROWS
#: Members on each side of a cell.
BLOCK = 512
#: A set of fewer shingles is within 0.8 of no other set.
LEAST_SET = 4
_SEEDS = textops.mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOW = np.uint64((1 << 48) - 1)


def sketch(items: np.ndarray) -> np.ndarray:
    """T coordinates of a set of 64-bit hashes, which must not be empty."""
    best = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    rounds, at = max(1, math.ceil(T * (math.log(T) + 1) / len(items))), 0
    while at < T:
        stop = min(T, at + rounds)
        h = textops.mix(items[None, :] ^ _SEEDS[at:stop, None])
        bins = ((h >> np.uint64(48)) * np.uint64(T)) >> np.uint64(16)
        value = (np.arange(at, stop, dtype=np.uint64)[:, None] << np.uint64(48)) | (h & _LOW)
        np.minimum.at(best, bins.ravel().astype(np.int64), value.ravel())
        at = stop
        if best.max() != np.iinfo(np.uint64).max:
            return best
    for j in np.flatnonzero(best == np.iinfo(np.uint64).max):
        best[j] = (np.uint64(T + j) << np.uint64(48)) | (textops.mix(items ^ _SEEDS[T + j]) & _LOW).min()
    return best


def bands(items: np.ndarray) -> np.ndarray:
    rows = sketch(items).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = textops.mix(out * np.uint64(0x2545F4914F6CDD1D) + rows[:, k])
    return out


def sets_of(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the texts' shingles."""
    found = textops.scan_words(texts, textops.NOT_SPACE)
    for k in range(len(texts)):
        yield np.unique(textops.shingles(found.hash[found.bounds[k] : found.bounds[k + 1]], words))


def describe(docs: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """rid, doc, n (size of the set), c1, c2 (hash of the set) and bands of every row. docs has rid."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                sizes, first, second, keys = [], [], [], []
                for own in sets_of(textops.texts_of(batch["text"]), words):
                    sizes.append(len(own))
                    first.append(int(textops.mix(own).sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(textops.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(bands(own).view(np.int64) if len(own) >= LEAST_SET else [])
                yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc"], pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["rid", "doc", "n", "c1", "c2", "bands"])

    source = docs.select("rid", F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, f"rid long, doc {kind}, n long, c1 long, c2 long, bands array<long>")


def full_sets(nodes: DataFrame, docs: DataFrame, text: str, words: int) -> DataFrame:
    """node and its whole set, from the text of the row that stands for the class. The nodes are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array([own.tobytes() for own in sets_of(textops.texts_of(batch["text"]), words)], pa.binary())], ["node", "set"])

    texts = docs.select(F.col("rid").alias("node"), F.col(f"`{text}`").alias("text"))
    return texts.join(small(nodes, F.lit(8)), "node").select("node", "text").mapInArrow(run, "node long, set binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """node and own: how many of its shingles no other of the sets has. Nodes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch["node"].to_pylist(), batch["set"]):
                own = np.frombuffer(items.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int64)), pa.array(own)], ["node", "g"])

    once = sets.mapInArrow(run, "node long, g long").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds shared and joint, the sizes of intersection and union, to the pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, joint = [], []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch[c][k].as_buffer(), np.uint64) for c in ("sa", "sb"))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared.append(int((y[at] == x).sum()))
                joint.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(shared, pa.int64()), pa.array(joint, pa.int64())], ["a", "b", "shared", "joint"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, shared long, joint long")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, centre, n, n_centre, shared, and differ: what only one of the two sets has, for pairs (node, centre)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_centre, shared, differ = [], [], [], []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch[c][k].as_buffer(), np.uint64) for c in ("sa", "sb"))
                apart = np.setxor1d(x, y, assume_unique=True)
                n.append(len(x))
                n_centre.append(len(y))
                shared.append((len(x) + len(y) - len(apart)) // 2)
                differ.append(apart.tobytes())
            numbers = [pa.array(c, pa.int64()) for c in (n, n_centre, shared)]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["centre"], *numbers, pa.array(differ, pa.binary())], ["node", "centre", "n", "n_centre", "shared", "differ"])

    left = sets.select("node", F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("centre"), F.col("set").alias("sb"))
    both = pairs.join(right, "centre").join(left, "node").select("node", "centre", "sa", "sb")
    return both.mapInArrow(run, "node long, centre long, n long, n_centre long, shared long, differ binary")


def lone_elements(told: DataFrame) -> DataFrame:
    """centre, node, lone: how many elements of a member's difference no other component's member of that centre has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for centre, node, root, differ in zip(*(batch[c].to_pylist() for c in ("centre", "node", "root")), batch["differ"]):
                own = np.frombuffer(differ.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(own), x, np.int64)) for x in (centre, node, root)], pa.array(own)], ["centre", "node", "root", "e"])

    each = told.select("centre", "node", "root", "differ").mapInArrow(run, "centre long, node long, root long, e long")
    lone = each.groupBy("centre", "e").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x = y").select("centre", "e")
    return each.join(cut(lone), ["centre", "e"]).groupBy("centre", "node").agg(F.count(F.lit(1)).alias("lone"))


def links_by_centre(told: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, for members (node, centre, n, n_centre, shared, differ, root, main) of centres.

    With d common elements of two members' differences from their centre, the members themselves share
    shared_x + shared_y - n_centre + d, exactly.  Members of two components differ at least in what only one of these
    components has: they cannot be linked if their excess, the lone elements beyond the share of their size that links
    leave, adds up to more than nothing.  So members outside the centre's component (main) meet those of that centre, in
    cells of at most about BLOCK by BLOCK, but two with an excess over nothing never do, nor those with more than all
    others can make up for.  Of each member's links to one component, one comes back.
    """
    mixed = told.groupBy("centre").agg(F.max((F.col("root") != F.col("main")).cast("int")).alias("some")).filter("some = 1").select("centre")
    told = cut(told.join(cut(mixed, small=True), "centre"))
    excess = F.lit(100 + percent) * F.coalesce("lone", F.lit(0)) - F.lit(100 - percent) * F.col("n")
    told = cut(told.join(lone_elements(told), ["centre", "node"], "left").withColumn("excess", excess).drop("lone"))
    out_, low = F.col("root") != F.col("main"), F.col("excess") <= 0
    least = told.groupBy("centre").agg(F.min("excess").alias("least_y"), F.min(F.when(out_, F.col("excess"))).alias("least_x"))
    may_x, may_y = out_ & (F.col("excess") + F.col("least_y") <= 0), F.col("excess") + F.col("least_x") <= 0
    number = lambda c: F.count(F.when(c, 1))
    judged = told.join(cut(least, small=True), "centre")
    sizes = judged.groupBy("centre").agg(number(may_x & low).alias("xl"), number(may_x & ~low).alias("xh"), number(may_y & low).alias("yl"), number(may_y & ~low).alias("yh")).filter("xl + xh > 0 AND yl + yh > 0")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("long").alias(n)
    sizes = cut(sizes.select("centre", *[parts(n) for n in ("xl", "xh", "yl", "yh")]), small=True)
    cells = sizes.agg(F.sum(F.expr("xl * (yl + yh) + xh * yl"))).first()[0]
    rows = judged.join(sizes, "centre")
    own = lambda b: F.pmod(F.xxhash64("node"), F.greatest(F.col(b), F.lit(1)))
    some = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))
    kept = ["centre", "node", "n", "n_centre", "shared", "differ", "root"]
    # Blocks of low excess come first, on either side; those of high excess meet only the other side's low ones.
    x = rows.filter(may_x).select(*kept, F.lit(True).alias("out"), F.when(low, own("xl")).otherwise(F.col("xl") + own("xh")).alias("cx"), some(F.when(low, F.col("yl") + F.col("yh")).otherwise(F.col("yl"))).alias("cy"))
    y = rows.filter(may_y).select(*kept, F.lit(False).alias("out"), F.when(low, own("yl")).otherwise(F.col("yl") + own("yh")).alias("cy"), some(F.when(low, F.col("xl") + F.col("xh")).otherwise(F.col("xl"))).alias("cx"))

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        x, y = cell[cell["out"]], cell[~cell["out"]].reset_index(drop=True)
        found: list[tuple[int, int]] = []
        if len(x) and len(y):
            sets = [np.frombuffer(d, np.uint64) for d in y["differ"]]
            items, owner = np.concatenate(sets), np.repeat(np.arange(len(y)), [len(s) for s in sets])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            n, shared, root = y["n"].to_numpy(), y["shared"].to_numpy(), y["root"].to_numpy()
            for r in x.itertuples():
                wanted = np.frombuffer(r.differ, np.uint64)
                low, high = np.searchsorted(items, wanted), np.searchsorted(items, wanted, side="right")
                hit = [owner[a:b] for a, b in zip(low, high) if b > a]
                common = np.bincount(np.concatenate(hit), minlength=len(y)) if hit else np.zeros(len(y), np.int64)
                both = r.shared + shared - r.n_centre + common
                linked = np.flatnonzero((100 * both >= percent * (r.n + n - both)) & (root != r.root))
                for k in linked[np.unique(root[linked], return_index=True)[1]]:
                    found.append((r.node, int(y["node"][k])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    both = x.unionByName(y).repartition(tasks_for(cells, 2), "centre", "cx", "cy")  # adaptive execution would put cells into tasks by bytes
    return both.groupBy("centre", "cx", "cy").applyInPandas(meet, "a long, b long")


def may_link(na: str, oa: str, nb: str, ob: str, percent: int) -> Column:
    """Whether sets of these sizes, with so many shingles of their own, can be similar enough."""
    most = F.least(F.col(na) - F.col(oa), F.col(nb) - F.col(ob))
    return 100 * most >= percent * (F.col(na) + F.col(nb) - most)


def with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root, the node itself where it has no links."""
    return rows.join(roots.withColumnRenamed("node", "__r"), F.col("node") == F.col("__r"), "left").withColumn("root", F.coalesce("root", "node")).drop("__r")


def cluster(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """rid, doc, n_shingles and component (the least doc of the component) of every row of docs, which has rid.

    Rows of documents are linked if 100 * shared >= percent * joint; percent must be 80 or more.
    """
    if percent < 80:
        raise ValueError("bands and sizes are made for 80 percent and more")
    rows = cut(describe(docs, doc, text, words))
    classes = rows.filter("n > 0").groupBy("c1", "c2").agg(F.min("rid").alias("node"), F.min("doc").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keyed = classes.select("node", "n", F.explode("bands").alias("h"))
    # Tables that are written before a join have an exchange of their own there, so that a hot key can be split.
    several = cut(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("h"), small=True)
    met = cut(keyed.join(several, "h"))
    sets = cut(full_sets(cut(met.select("node").distinct(), small=True), docs, text, words))

    own = cut(own_shingles(sets), small=True)
    hits = met.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter(f"100 * (n - own) >= {percent} * n")
    hits = cut(hits)
    leaders = hits.groupBy("h").agg(F.min(F.struct("own", "node", "n")).alias("l"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    leaders = cut(leaders.select("h", F.col("l.node").alias("leader"), F.col("l.n").alias("ln"), F.col("l.own").alias("lo")), small=True)
    hits = cut(hits.join(leaders, "h"))

    link = F.expr(f"100 * shared >= {percent} * joint")
    stars = hits.filter("node <> leader").filter(may_link("n", "own", "ln", "lo", percent)).groupBy("node", "leader", "lo").agg(F.count(F.lit(1)).alias("times"))
    # First the leader that a member meets most often.
    best = stars.groupBy("node").agg(F.max(F.struct("times", (-F.col("lo")).alias("lo"), "leader")).alias("m")).select(F.col("node").alias("a"), F.col("m.leader").alias("b"))
    links = cut(verify(best, sets), small=True)
    edges = links.filter(link).select("a", "b")
    roots = components(edges)

    # Then all members of buckets that hold several components, against one centre: in the component of the
    # bucket's leader the member with the fewest shingles of its own.
    placed = with_root(hits, roots)
    centres = placed.groupBy("root").agg(F.min(F.struct("own", "node", "n")).alias("c")).select(F.col("root").alias("main"), F.col("c.node").alias("centre"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max(F.when(F.col("node") == F.col("leader"), F.col("root"))).alias("main")).filter("x <> y").select("h", "main")
    mixed = cut(mixed.join(centres, "main").select("h", "centre"), small=True)
    open_ = hits.select("h", "node").join(mixed, "h")
    met = open_.filter("node <> centre").select("node", "centre").distinct()
    told = cut(differences(met, sets))
    edges = cut(edges.unionByName(told.filter(f"100 * shared >= {percent} * (n + n_centre - shared)").select(F.col("node").alias("a"), F.col("centre").alias("b"))), small=True)
    roots = components(edges)

    # Last the pairs between the components that remain, by what members differ in from their centre.
    main = roots.select(F.col("node").alias("centre"), F.col("root").alias("main"))
    told = with_root(told, roots).join(main, "centre", "left").withColumn("main", F.coalesce("main", "centre"))
    rest = links_by_centre(told, percent)
    roots = components(edges.unionByName(rest))

    named = cut(with_root(classes.select("c1", "c2", "node", "least"), roots))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("c1", "c2", "component", F.lit(True).alias("linked"))
    out = rows.drop("bands").join(named, ["c1", "c2"], "left")
    return out.select("rid", "doc", F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc")).alias("component"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its own columns: the first of those with the least doc_id.

    Rows with an empty set are components of their own, so all stay.
    """
    rid = fresh(docs.columns, "rid")
    own = numbered(docs, rid)
    found = cluster(own.select(F.col(rid).alias("rid"), F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")), "doc", "text", words, percent)
    first = found.filter((F.col("n_shingles") > 0) & F.col("doc").eqNullSafe(F.col("component"))).groupBy("component").agg(F.min("rid").alias("rid")).select("rid")
    kept = first.unionByName(found.filter("n_shingles = 0").select("rid")).select(F.col("rid").alias(rid))
    return own.join(kept, rid, "left_semi").drop(rid)
