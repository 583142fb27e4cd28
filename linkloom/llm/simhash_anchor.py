"""SimHash near-duplicates by anchor-point covering.

Fingerprints at 3 or fewer differing bits link. The anchors are the words of a covering code on 23 of the 64 bits: the
perfect Golay code, within whose radius 3 every word has exactly one anchor. A fingerprint's home is its nearest anchor,
and it is replicated to every anchor within radius + threshold = 6, some 71 of 4096; if two fingerprints link, the
second lies within 6 of the first one's home, so comparing homes with replicas per anchor loses no link. An anchor with
more than REFINE homes is refined by the same code on 23 further bits (the threshold that the first part has used up is
not granted to the second), so work per fingerprint stays bounded as the corpus grows. What remains crowded is compared
in blocks (see buckets). Groups yield one link per row, not all pairs.

Equal fingerprints are one node. Defined cases: a text without words, empty or null, has fingerprint 0 and links like
any other; very long texts are hashed whole, one after the other; rows with a null id get their class but never name it
(a class of null ids alone has a null name); repeated rows and ids each get a row; a tie (a bit set in just half of the
hashes) is a 0; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, common, graph

SHINGLE = 3
THRESHOLD = 3
REFINE = 8192
#: Length and radius of the binary Golay code, and its generator polynomial.
LENGTH, RADIUS, GENERATOR = 23, 3, 0xC75


def fingerprint_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Majority bits of the uint64 hashes of each run that begins at starts (no run is empty)."""
    out = np.zeros(len(starts), np.uint64)
    ends = np.append(starts[1:], len(hashes))
    votes = np.zeros((len(starts), 64), np.int64)
    step = 1 << 16
    for at in range(0, len(hashes), step):  # bits of 64k hashes at a time
        part = hashes[at : at + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        votes[lo:hi] += np.add.reduceat(bits, np.maximum(starts[lo:hi] - at, 0), axis=0, dtype=np.int64)
    ones = 2 * votes > (ends - starts)[:, None]
    out[:] = np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of the space-joined shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [h(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """keep columns and fp, the fingerprint as a signed long, for each row of docs."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches):
        for whole in batches:
            n = whole.num_columns - 1
            for b in common.slices(whole, n):
                fps = np.zeros(b.num_rows, np.uint64)
                rows, starts, hashes = [], [], []
                for i, text in enumerate(b.column(n)):
                    if found := shingle_hashes(text.as_py(), size):
                        rows.append(i)
                        starts.append(len(hashes))
                        hashes += found
                if rows:
                    fps[rows] = fingerprint_of(np.asarray(hashes, np.uint64), np.asarray(starts))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(fps.view(np.int64))], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


@lru_cache(1)
def _code():
    """Per syndrome the error patterns of weight up to RADIUS + THRESHOLD, lightest first: (offsets, patterns, weights);
    and the tables that give a word's syndrome by its bytes."""
    check = LENGTH - 12
    unit = []
    for i in range(LENGTH):
        x = 1 << i
        for d in range(i, check - 1, -1):
            if x >> d & 1:
                x ^= GENERATOR << (d - check)
        unit.append(x)
    tables = np.zeros((3, 256), np.int64)
    for t in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * t + i < LENGTH:
                    tables[t, v] ^= unit[8 * t + i]
    every = np.arange(1 << LENGTH, dtype=np.int64)
    weight = np.bitwise_count(every)
    every = every[weight <= RADIUS + THRESHOLD]
    weight = np.bitwise_count(every)
    s = _syndromes(every, tables)
    by = np.lexsort((every, weight, s))
    return np.searchsorted(s[by], np.arange((1 << check) + 1)), every[by], weight[by].astype(np.int64), tables


def _syndromes(words: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16 & 255]


def near_anchors(words: np.ndarray, within: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, distance) for every anchor within the given distance of each 23-bit word."""
    offsets, patterns, weights, tables = _code()
    s = _syndromes(words, tables)
    n = offsets[s + 1] - offsets[s]
    row = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[s], n)
    ok = weights[at] <= (within if np.isscalar(within) else within[row])
    row, at = row[ok], at[ok]
    return row, words[row] ^ patterns[at], weights[at]


def anchor_rows(fps: np.ndarray, crowded: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role): where each fingerprint goes."""
    mask = (1 << LENGTH) - 1
    reach = RADIUS if homes_only else RADIUS + THRESHOLD
    row, c1, d1 = near_anchors(fps & mask, reach)
    fine = np.isin(c1, crowded)
    keys, roles, rows = [c1[~fine] << (LENGTH + 1)], [np.where(d1[~fine] <= RADIUS, buckets.HOME, buckets.OTHER)], [row[~fine]]
    if fine.any():
        row, c1, d1 = row[fine], c1[fine], d1[fine]
        left = reach - np.maximum(0, d1 - RADIUS)
        sub, c2, d2 = near_anchors(fps[row] >> LENGTH & mask, left)
        keys.append(c1[sub] << (LENGTH + 1) | 1 << LENGTH | c2)
        roles.append(np.where((d1[sub] <= RADIUS) & (d2 <= RADIUS), buckets.HOME, buckets.OTHER))
        rows.append(row[sub])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def _spread(distinct: DataFrame, crowded: list[int], homes_only: bool) -> DataFrame:
    hot = np.asarray(crowded, np.int64)

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            for s in range(0, len(fps), 2000):
                part = fps[s : s + 2000]
                row, key, role = anchor_rows(part, hot, homes_only)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role.astype(np.int32)), pa.array(part[row])], names=["key", "role", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, role int, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of longs; bitwise_count alone takes a negative number's absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def _links(batches):
    """(a, b): every row that links with a home gets one link; homes that a row or a link joins get one link each."""
    homes, labels, out = np.zeros(0, np.int64), buckets.Labels(), []

    def close():
        moved = np.flatnonzero(labels.lab != np.arange(len(homes)))
        if len(moved):
            out.append((homes[moved], homes[labels.lab[moved]]))

    for new, _, part in buckets.segments(batches):
        if new:
            close()
            homes, labels = np.zeros(0, np.int64), buckets.Labels()
        role, fp = part.column("role").to_numpy(), part.column("fp").to_numpy()
        if (own := fp[role == buckets.HOME]).size:
            labels.grow(len(own))
            homes = np.concatenate([homes, own])
            for s in range(len(homes) - len(own), len(homes), 512):
                for t in range(0, min(s + 512, len(homes)), 2048):
                    x, y = np.nonzero(_bits(homes[s : s + 512, None] ^ homes[None, t : t + 2048]) <= THRESHOLD)
                    labels.join(x + s, y + t)
        rest = fp[role != buckets.HOME]
        if not len(homes):
            continue
        for t in range(0, len(rest), 2048):
            some = rest[t : t + 2048]
            first = np.full(len(some), -1)
            for s in range(0, len(homes), 512):
                y, x = np.nonzero(_bits(some[:, None] ^ homes[None, s : s + 512]) <= THRESHOLD)
                if len(y):
                    fresh = first[y] < 0
                    np.maximum.at(first, y[fresh], x[fresh] + s)
                    labels.join(first[y], x + s)
            hit = first >= 0
            if hit.any():
                out.append((some[hit], homes[first[hit]]))
        if len(out) > 200:
            yield _pairs(out)
            out = []
    close()
    if out:
        yield _pairs(out)


def _pairs(out):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], names=["a", "b"])


def link(distinct: DataFrame, refine: int = REFINE, block: int = buckets.BLOCK) -> DataFrame:
    """Links (a, b) that join the fingerprints of `distinct` (fp, each once) into their classes."""
    first = F.col("key").bitwiseAND(-1)
    per = _spread(distinct, [], True).groupBy(first.alias("key")).count().where(F.col("count") > refine)
    crowded = [r.key >> (LENGTH + 1) for r in per.collect()]  # of 4096 anchors
    rows, homes = _spread(distinct, crowded, False), _spread(distinct, crowded, True).select("key")
    return buckets.deal(rows, homes, "fp", block).select("key", "block", "role", "fp").mapInArrow(_links, "a long, b long").distinct()


def classes(fps: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """fps (materialised, with fp and id_col) with component_id: the smallest id of its class."""
    distinct = common.materialise(fps.groupBy("fp").agg(F.min(id_col).alias("low")), "distinct")
    roots = common.materialise(graph.components(link(distinct, **options)), "roots")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(low, "root").select("fp", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id."""
    fps = common.materialise(fingerprints(docs.select(F.col(id_col).alias("__id"), text_col), ["__id"], text_col), "fps")
    out = classes(fps, "__id", **options)
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def lowest(fps: DataFrame) -> DataFrame:
    """fp, each once, with its lowest row: the smallest id (null last) and, among equal ids, the smallest text hash."""
    return common.materialise(fps.groupBy("fp").agg(F.min(F.struct(F.col("__id").isNull().alias("nil"), "__id", "__th")).alias("low")), "distinct")


def first_rows(docs: DataFrame, fps: DataFrame, distinct: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the lowest of their class. Of the others only the keys are shuffled, and the texts that a
    bitmap of those keys does not clear."""
    best = distinct.join(roots, distinct.fp == roots.node, "left").groupBy(F.coalesce("root", "fp")).agg(F.min("low").alias("low"))
    best = common.materialise(best.select(F.col("low.__id").alias("__id"), F.col("low.__th").alias("__th")).distinct(), "best").alias("k")
    every = common.materialise(fps.groupBy("__id", "__th").count(), "keys").alias("d")
    gone = common.materialise(every.join(best, common.same_key("d", "k"), "left_anti").select("__id", "__th"), "gone")
    kept = common.rows_without_key(docs, gone, id_col, text_col)
    # Only if a row that stays stands there more than once do the texts have to be compared, that is, shuffled again.
    if not every.where("count > 1").join(best, common.same_key("d", "k"), "left_semi").isEmpty():
        kept = kept.dropDuplicates(["__id", "__th"])
    return kept.select("__row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row for each class: its smallest id and, among equal ids, the smallest text hash and then any one
    of the equal rows. Ids that are null count as larger than all others."""
    rows = docs.select(F.col(text_col), *common.row_key(docs, id_col, text_col))
    fps = common.materialise(fingerprints(rows, ["__id", "__th"], text_col), "fps")
    distinct = lowest(fps)
    return first_rows(docs, fps, distinct, graph.components(link(distinct, **options)), id_col, text_col)
