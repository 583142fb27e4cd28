"""One document of each class of near-duplicates, where five-word shingles say what is near.

Two texts link if their SimHash fingerprints do (see simhash_anchor) or if the Jaccard similarity of their sets of
distinct SHINGLE-word shingles is at least SIMILARITY. Fingerprints alone miss most of the latter: 0.8 of the shingles
in common leaves 3 to 15 bits of 64 different.

Method. MinHash values in BANDS bands of ROWS values: a pair at exactly 0.8 shares no band with a probability of
(1 - 0.8 ** 4) ** 18 = 8e-5, the only loss. Every candidate is verified on its sets, which are made again for the texts
that share a band with another class only. First all texts of a bucket are held against one of them; buckets in which several
classes are left are compared in blocks, whole, without building pairs as rows. The comparisons there are quadratic in
the bucket.

Defined cases: a text of fewer than SHINGLE words is one shingle; texts without words, null or empty, are equal; a tie (a
similarity of just SIMILARITY) links; very long texts are hashed whole; repeated rows leave one; an empty table gives an
empty result; extra columns stay as they are; all else as in simhash_anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buckets, common, graph, simhash_anchor

SHINGLE = 5
#: Smallest Jaccard similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 18, 4
#: Rows of a bucket that one task holds against the others.
BLOCK = 256


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.asarray(simhash_anchor.shingle_hashes(text, size), np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for each set; no set is empty."""
    r = np.random.RandomState(7)
    mul, add = (r.randint(0, 1 << 32, (2, BANDS * ROWS), np.uint64) for _ in range(2))
    mul, add = (mul[0] << 32 | mul[1]) | 1, add[0] << 32 | add[1]
    every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(every * mul[i] + add[i], starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def signatures(rows: DataFrame, text_col: str) -> DataFrame:
    """__id, __th, fp, sid (a hash of the shingle set) and bands (none for a text without words)."""
    from xxhash import xxh64_intdigest as h

    schema = rows.select("__id", "__th").schema.add("fp", "long").add("sid", "long").add("bands", T.ArrayType(T.LongType()))

    def signed(b):
        fps, sids, bands = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), [[]] * b.num_rows
        at, starts, hashes, sets = [], [], [], []
        for i, text in enumerate(b.column(2)):
            if found := simhash_anchor.shingle_hashes(t := text.as_py()):
                at.append(i)
                starts.append(len(hashes))
                hashes += found
                sets.append(shingle_set(t))
                sids[i] = h(sets[-1].tobytes(), 42)
        if at:
            fps[at] = simhash_anchor.fingerprint_of(np.asarray(hashes, np.uint64), np.asarray(starts))
            for i, keys in zip(at, band_keys(sets).view(np.int64), strict=True):
                bands[i] = keys
        cols = [b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(sids.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, 2):
                yield signed(b)

    return rows.select("__id", "__th", F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sid, fp and the shingle set of nodes (sid, fp, __id, __th)."""
    d = docs.select(F.col(text_col).alias("__text"), *common.row_key(docs, id_col, text_col))
    # An inner join after the bitmap: most texts are nobody's candidates and are not shuffled.
    d = common.marked(d, "__th", common.bitmap(nodes, "__th")).where("__maybe").alias("d")
    d = d.join(nodes.alias("n"), common.same_key("d", "n")).select("n.sid", "n.fp", "d.__text")

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, 2):
                sets = [shingle_set(t.as_py()).tobytes() for t in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["sid", "fp", "hashes"])

    # Equal rows give equal sets.
    return common.materialise(d.mapInArrow(run, "sid long, fp long, hashes binary").dropDuplicates(["sid"]), "sets")


def near(x: np.ndarray, y: np.ndarray) -> bool:
    common_n = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILARITY[1] * common_n >= SIMILARITY[0] * (len(x) + len(y) - common_n)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints for those of pairs (x, y: sids) that are near."""
    x = sets.select(F.col("sid").alias("x"), F.col("fp").alias("a"), F.col("hashes").alias("hx"))
    y = sets.select(F.col("sid").alias("y"), F.col("fp").alias("b"), F.col("hashes").alias("hy"))

    def run(batches):
        for b in batches:
            ok = [near(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return common.materialise(pairs.join(x, "x").join(y, "y").select("a", "b", "hx", "hy").mapInArrow(run, "a long, b long"), "near")


def _compared(batches):
    """Links (a, b) of fingerprints between a block's homes, and between them and the bucket's other rows, where the
    roots differ. Homes come first; of two rows in different blocks the block of the smaller sid compares them."""
    homes, index, out = [], None, []

    def against(x):
        """Indices of the homes that x is near to."""
        hashes, owner, sizes = index
        lo, hi = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(owner[at], minlength=len(sizes))
        return np.flatnonzero(SIMILARITY[1] * both >= SIMILARITY[0] * (sizes + len(x) - both))

    def build():
        nonlocal index
        owner = np.repeat(np.arange(len(homes)), [len(h[3]) for h in homes])
        every = np.concatenate([h[3] for h in homes])
        by = np.argsort(every, kind="stable")
        index = every[by], owner[by], np.array([len(h[3]) for h in homes])
        for i, h in enumerate(homes):
            out.extend((h[1], homes[j][1]) for j in against(h[3]) if j < i and h[2] != homes[j][2])

    for new, _, part in buckets.segments(batches):
        if new:
            if homes and index is None:
                build()
            homes, index = [], None
        for role, sid, fp, root, x in zip(*(part.column(c).to_pylist() for c in ("role", "sid", "fp", "root", "hashes")), strict=True):
            x = np.frombuffer(x, np.uint64)
            if role == buckets.HOME:
                homes.append((sid, fp, root, x))
            elif homes:
                if index is None:
                    build()
                out.extend((fp, homes[j][1]) for j in against(x) if homes[j][0] < sid and homes[j][2] != root)
        if len(out) > 10_000:
            yield _links(out)
            out.clear()
    if homes and index is None:
        build()
    if out:
        yield _links(out)


def _links(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (key, sid, root) of the keys with more than one root, with the key's first row as `one`."""
    per = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("root", "sid")).alias("one")).where("low <> high")
    return rows.join(per.select("key", "one"), "key")


def _rooted(rows: DataFrame, col: str, roots: DataFrame) -> DataFrame:
    """rows with root: that of their fingerprint or root `col`, or it itself where it has no link."""
    r = roots.select(F.col("node").alias(col), F.col("root").alias("__r"))
    return rows.join(r, col, "left").withColumn("root", F.coalesce("__r", col)).drop("__r")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row for each class, chosen as simhash_anchor.keep_one does."""
    rows = docs.select(F.col(text_col), *common.row_key(docs, id_col, text_col))
    sigs = common.materialise(signatures(rows, text_col), "sigs")
    distinct = simhash_anchor.lowest(sigs)
    # Equal sets are one node of the search by bands; all their fingerprints link.
    nodes = sigs.where("size(bands) > 0").groupBy("sid").agg(F.min(F.struct("fp", "__id", "__th")).alias("n"), F.max("fp").alias("high"))
    nodes = common.materialise(nodes.select("sid", "n.*", "high"), "nodes")
    same = sigs.join(nodes.where("fp <> high").select("sid", F.col("fp").alias("b")), "sid").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    roots = common.materialise(graph.components(simhash_anchor.link(distinct, **options).union(same)), "roots")
    # Keys that only one set has go after one aggregation; the rows of the others are found again through a bitmap.
    keyed = sigs.select("sid", F.explode("bands").alias("key"))
    shared = common.materialise(keyed.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("key"), "shared")
    some = common.marked(keyed, "key", common.bitmap(shared, "key")).where("__maybe").drop("__maybe").distinct().join(shared, "key")
    some = common.materialise(some.join(nodes.select("sid", "fp"), "sid"), "some")
    cand = common.materialise(_mixed(_rooted(some, "fp", roots)).select("key", "sid", "root", "one"), "cand")
    wanted = nodes.join(cand.select("sid").distinct(), "sid", "left_semi").select("sid", "fp", "__id", "__th")
    sets = _sets(docs, common.materialise(wanted, "wanted"), id_col, text_col)
    links = _verified(cand.where("root <> one.root").select(F.col("sid").alias("x"), F.col("one.sid").alias("y")).distinct(), sets)
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
    # What is left: classes of a bucket that its first row did not join.
    roots = common.materialise(graph.components(edges), "roots2")
    left = common.materialise(_mixed(_rooted(cand.select("key", "sid", "root").withColumnRenamed("root", "was"), "was", roots)).select("key", "sid", "root"), "left")
    rows = left.withColumn("role", F.lit(buckets.HOME)).join(sets, "sid")
    dealt = buckets.deal(rows, left, "sid", BLOCK).select("key", "block", "role", "sid", "fp", "root", "hashes")
    roots = graph.components(edges.union(common.materialise(dealt.mapInArrow(_compared, "a long, b long").distinct(), "compared")))
    return simhash_anchor.first_rows(docs, sigs, distinct, roots, id_col, text_col)
