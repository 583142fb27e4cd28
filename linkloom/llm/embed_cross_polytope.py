"""Near-duplicate vectors by cross-polytope hashing, with verified links.

A table has fast Hadamard rotations (random signs and a Walsh-Hadamard transform, three times each). A vector's home is
the tuple of signed axes that its rotations lie closest to, and it also visits the PROBES - 1 next best tuples. Homes are
compared with all vectors of their bucket in double precision (a product in single precision decides only what is farther
than MARGIN from the limit).

The number of distinct vectors says how many axes a tuple needs for buckets of some HOMES homes: part of one rotation
while they are few, several rotations when they are many, so a vector meets about as many others however many there are.
Longer tuples separate more near pairs, so the number of tables follows: `plan` measures on random pairs at just the
limit, in this number of dimensions, how many pairs one table finds, and takes as many tables as leave out fewer than
MISSED of them. Pairs nearer than the limit are found more often.

Equal vectors are one node with a multiplicity, so copies are counted without being paired. A vector is told by 128 bits of
hash, so at 10^11 distinct vectors two share one with a probability of 2e-17. A link found in several places counts at the
first of them, which both codes tell. Crowded buckets are compared block by block (see buckets); a bucket yields one row
per vector, not its pairs. Work within a group of near copies is quadratic in its distinct vectors, as all its links are
counted.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows
with a null id (whose component is null); vectors of different lengths never link; a tie (a cosine of just the limit)
links; repeated rows link with one another; an id that repeats with different vectors keeps a row for each; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, common, graph

COSINE = 0.95
PROBES = 4
#: Share of the pairs at just the limit that all tables together may leave out, and random pairs that measure it.
MISSED, TRIALS = 1e-4, 1000
HOMES = 1024
BLOCK = 4096
#: Products in single precision are off by less than this up to so many dimensions.
MARGIN, SINGLE = 1e-4, 1024


@lru_cache(256)
def _signs(dim: int, table: int, rotation: int) -> np.ndarray:
    """Signs [round, axis], the same on every worker."""
    return np.random.default_rng([20, dim, table, rotation]).choice([-1.0, 1.0], (3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(dim: int, n: int, homes: int = HOMES) -> tuple[int, ...]:
    """Axes used of each rotation, so that n vectors of dim (padded) dimensions make buckets of some `homes`."""
    out, cells = [], n / homes
    while cells > 2:
        out.append(min(dim, max(2, math.ceil(cells / 2))))
        cells /= 2 * out[-1]
    return tuple(out)


def codes(unit: np.ndarray, use: tuple[int, ...], tables: range) -> np.ndarray:
    """[row, table, probe]: bucket numbers within a table, the home first; -1 where there are fewer buckets than probes."""
    n, d = unit.shape
    dim = _padded(d)
    x = np.zeros((n, dim))
    x[:, :d] = unit
    out = np.full((n, len(tables), PROBES), -1, np.int64)
    for t, table in enumerate(tables):
        number, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for k, used in enumerate(use):
            y = x
            for signs in _signs(dim, table, k):
                y = hadamard(y * signs)
            y = y[:, :used]
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :PROBES]
            at = np.take_along_axis(y, top, 1)
            off = (np.abs(at[:, :1]) - np.abs(at)) ** 2
            number = (number[:, :, None] * (2 * used) + (2 * top + (at < 0))[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + off[:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
            number, loss = np.take_along_axis(number, best, 1), np.take_along_axis(loss, best, 1)
        out[:, t, : number.shape[1]] = number
    return out


def _padded(d: int) -> int:
    return max(4, 1 << (d - 1).bit_length())


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[pair, table]: whether the codes of a pair share a bucket that is home to one of them."""
    return (b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)


@lru_cache(256)
def plan(d: int, n: int, cosine: float = COSINE, homes: int = HOMES) -> tuple[tuple[int, ...], int]:
    """(axes of each rotation, number of tables) for n vectors of d dimensions."""
    use = axes(_padded(d), n, homes)
    if not use or d < 2:
        return (), 1
    r = np.random.default_rng([21, d])
    x, z = (v / np.linalg.norm(v, axis=1)[:, None] for v in r.normal(size=(2, TRIALS, d)))
    z = z - (z * x).sum(1)[:, None] * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z, axis=1)[:, None]
    found = meet(codes(x, use, range(3)), codes(y, use, range(3))).mean()
    # A margin of three standard deviations for what the trials cannot tell.
    found = min(max(found - 3 * math.sqrt(found * (1 - found) / (3 * TRIALS)), 0.01), 0.999)
    return use, min(63, math.ceil(math.log(MISSED) / math.log(1 - found)))


def _matrix(col) -> np.ndarray:
    """Unit rows of a list column whose lists are equally long."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(x: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """[row, table, probe]: codes as keys that differ by table and length, too; -1 for no bucket. n: the number of vectors,
    and how many homes a bucket should have."""
    use, tables = plan(x.shape[1], n[0], homes=n[1])
    if not use:
        return np.full((len(x), 1, PROBES), [x.shape[1]] + [-1] * (PROBES - 1), np.int64)
    c = codes(x, use, range(tables))
    return np.where(c < 0, -1, (c * 64 + np.arange(tables)[None, :, None]) * 65536 + x.shape[1])


def _spread(n: tuple[int, int], homes_only: bool):
    """Rows by bucket; of homes alone just the keys."""

    def run(batches):
        for b in batches:
            sizes = b.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                of = b.take(pa.array(np.flatnonzero(sizes == dim)))
                for s in range(0, of.num_rows, 500):
                    part = of.slice(s, 500)
                    key = _keys(_matrix(part.column("embedding")), n)
                    if homes_only:
                        yield pa.RecordBatch.from_arrays([pa.array(key[:, :, 0].ravel())], names=["key"])
                        continue
                    row, _, probe = np.nonzero(key >= 0)
                    got = part.take(pa.array(row))
                    role = np.where(probe == 0, buckets.HOME, buckets.OTHER).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key[key >= 0]), pa.array(role), got.column("cid"), got.column("m"), got.column("embedding")], names=["key", "role", "cid", "m", "embedding"])

    return run


def _first_place(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of keys [pair, table, probe], x of the smaller id: the first bucket in which the two meet."""
    a = (y == x[:, :, :1]).any(2)  # x's home is among y's visits
    t = np.argmax(a | (x == y[:, :, :1]).any(2), axis=1)
    i = np.arange(len(x))
    return np.where(a[i, t], x[i, t, 0], y[i, t, 0])


def _near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of unit rows of x and y whose cosine reaches the limit."""
    if x.shape[1] > SINGLE:
        return np.nonzero(x @ y.T >= COSINE)
    s = x.astype(np.float32) @ y.astype(np.float32).T
    i, j = np.nonzero(s >= COSINE - MARGIN)
    unsure = np.flatnonzero(s[i, j] < COSINE + MARGIN)
    ok = np.ones(len(i), bool)
    for at in range(0, len(unsure), 20000):
        u = unsure[at : at + 20000]
        ok[u] = np.einsum("ij,ij->i", x[i[u]], y[j[u]]) >= COSINE
    return i[ok], j[ok]


class _Bucket:
    """The homes of one block of a bucket, the links counted at them, and their classes."""

    def __init__(self, key: int, n: tuple[int, int]):
        self.key, self.of, self.labels = key, n, buckets.Labels()
        self.cid, self.m, self.n = (np.zeros(0, np.int64) for _ in range(3))
        self.x = self._codes = None

    def add(self, x, cid, m) -> None:
        begin = len(self.cid)
        self.x = x if self.x is None else np.concatenate([self.x, x])
        self.cid, self.m, self.n = np.concatenate([self.cid, cid]), np.concatenate([self.m, m]), np.concatenate([self.n, np.zeros(len(cid), np.int64)])
        self.labels.grow(len(cid))
        self._codes = None
        for s in range(begin, len(self.cid), 512):
            e = min(s + 512, len(self.cid))
            i, j = _near(self.x[s:e], self.x[:e])
            i += s
            i, j = i[j < i], j[j < i]  # every pair of homes once
            self.labels.join(i, j)
            for a, b in self._here(i, j, self.cid, self.keys, np.ones(len(i), bool)):
                np.add.at(self.n, a, self.m[b])
                np.add.at(self.n, b, self.m[a])

    @property
    def keys(self) -> np.ndarray:
        if self._codes is None:
            self._codes = _keys(self.x, self.of)
        return self._codes

    def _here(self, i, j, cid, keys, ok):
        """The pairs (row i, home j) that count in this bucket, some at a time."""
        for at in range(0, len(i), 20000):
            a, b, may = i[at : at + 20000], j[at : at + 20000], ok[at : at + 20000]
            low = (cid[a] < self.cid[b])[:, None, None]
            x, y = keys[a], self.keys[b]
            may = may & (_first_place(np.where(low, x, y), np.where(low, y, x)) == self.key)
            yield a[may], b[may]

    def visit(self, x, cid, m, role):
        """(cid, n, other) of the rows that link with homes."""
        i, j = _near(x, self.x)
        if not len(i):
            return None
        rows, at = np.unique(i, return_inverse=True)
        keys = np.zeros((len(x), *self.keys.shape[1:]), np.int64)
        keys[rows] = _keys(x[rows], self.of)
        joined, n = np.zeros(len(rows), np.int64), np.zeros(len(x), np.int64)
        joined[at] = j
        self.labels.join(joined[at], j)
        # Homes of other blocks meet twice, once in each block.
        ok = (role[i] != buckets.HOME_ELSEWHERE) | (self.cid[j] < cid[i])
        for a, b in self._here(i, j, cid, keys, ok):
            np.add.at(n, a, self.m[b])
            np.add.at(self.n, b, m[a])
        return cid[rows], n[rows], self.cid[joined]

    def close(self):
        hit = np.flatnonzero((self.n > 0) | (self.labels.lab != np.arange(len(self.cid))))
        return (self.cid[hit], self.n[hit], self.cid[self.labels.lab[hit]]) if len(hit) else None


def _links(n: tuple[int, int]):
    def run(batches):
        """(cid, n, other): links counted in a bucket, and a home that the row is joined with (itself if none)."""
        at, out = None, []
        for new, key, part in buckets.segments(batches):
            if new:
                out += [at.close()] if at is not None else []
                at = _Bucket(key, n)
            role = part.column("role").to_numpy()
            cid, m = part.column("cid").to_numpy(), part.column("m").to_numpy()
            own = role == buckets.HOME
            if not own.any() and at.x is None:
                continue
            x = _matrix(part.column("embedding"))
            if own.any():
                at.add(x[own], cid[own], m[own])
            rest = np.flatnonzero(~own)
            for s in range(0, len(rest), 1024):
                some = rest[s : s + 1024]
                out.append(at.visit(x[some], cid[some], m[some], role[some]))
            if len(out) > 200:
                yield from _batch(out)
                out = []
        if at is not None:
            out.append(at.close())
        yield from _batch(out)

    return run


def _batch(out):
    out = [x for x in out if x is not None]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=["cid", "n", "other"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", homes: int = HOMES, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: the id, n_links, component_id, kept."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    usable = F.col("id").isNotNull() & F.coalesce(
        (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    v = v.withColumns({"ok": usable, "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    # -0.0 and 0.0 hash and group together.
    nodes = v.where("ok").groupBy("h1", "h2", "embedding").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("m"))
    nodes = common.materialise(nodes.withColumn("cid", F.monotonically_increasing_id()), "nodes")
    n, kind = (nodes.count(), homes), nodes.schema["embedding"].dataType.simpleString()
    rows = nodes.select("cid", "m", "embedding").mapInArrow(_spread(n, False), f"key long, role int, cid long, m long, embedding {kind}")
    dealt = buckets.deal(rows, nodes.select("embedding").mapInArrow(_spread(n, True), "key long"), "cid", block)
    found = common.materialise(dealt.select("key", "block", "role", "cid", "m", "embedding").mapInArrow(_links(n), "cid long, n long, other long"), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = graph.components(found, "cid", "other").withColumnRenamed("node", "cid")
    named = nodes.select("cid", "h1", "h2", "low", "m").join(counts, "cid", "left").join(roots, "cid", "left")
    named = common.materialise(named.select("h1", "h2", "low", "m", "n", F.coalesce("root", "cid").alias("root")), "named")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(low, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    good = v.where("ok").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    rest = v.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
