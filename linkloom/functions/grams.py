"""Character 3-grams of two texts as one hashed vector, over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: A sparse vector as Spark stores it.
_TYPE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
_LOW, _BITS = (1 << 21) - 1, 21


def murmur3(b: bytes, seed: int = 42) -> int:
    """MurmurHash3 of 32 bits, unsigned: MLlib's HashingTF takes it of a term's UTF-8."""
    h, n = seed, len(b)
    for i in range(0, n, 4):
        k = int.from_bytes(b[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        if i + 4 <= n:
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


@lru_cache(1 << 18)
def _places(code: int, buckets: int) -> tuple[int, int, int]:
    """Buckets of a gram that both texts have, only the first, only the second."""
    gram = "".join(chr(c - 1) for c in (code & _LOW, code >> _BITS & _LOW, code >> 2 * _BITS) if c).encode()
    signed = (murmur3(t + gram) for t in (b"=", b"<", b">"))
    return tuple((h - (1 << 32) if h >> 31 else h) % buckets for h in signed)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram's code) of all grams; a text of fewer than three characters is one gram."""
    texts = [t or "" for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.concatenate([np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1, np.zeros(3, np.int64)])
    n = np.maximum(size - 2, 1)
    row = np.repeat(np.arange(len(texts)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, left = np.repeat(np.cumsum(size) - size, n) + off, size[row] - off
    return row, sum(np.where(left > i, chars[at + i], 0) << (_BITS * i) for i in range(3))


def vectors(ta: list[str | None], tb: list[str | None], buckets: int) -> pa.Array:
    """Counts of the hashed grams and, in the last place, the share of grams that both texts have."""
    (ra, ca), (rb, cb) = _grams(ta), _grams(tb)
    codes, ids = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    place = np.array([_places(c, buckets) for c in codes.tolist()], np.int64).reshape(-1, 3)
    a, b = np.unique(ra * len(codes) + ids[: len(ra)]), np.unique(rb * len(codes) + ids[len(ra) :])
    both = np.intersect1d(a, b, assume_unique=True)
    sets = both, np.setdiff1d(a, both, assume_unique=True), np.setdiff1d(b, both, assume_unique=True)
    n, width = len(ta), buckets + 1
    keys, counts = np.unique(np.concatenate([x // len(codes) * width + place[x % len(codes), i] for i, x in enumerate(sets)]), return_counts=True)
    per = [np.bincount(x // len(codes), minlength=n) for x in sets]
    rows = np.flatnonzero(per[0])
    keys, values = np.concatenate([keys, rows * width + buckets]), np.concatenate([counts, (per[0] / sum(per))[rows]])
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    edges = pa.array(np.searchsorted(keys, np.arange(n + 1) * width), pa.int32())
    lists = pa.ListArray.from_arrays(edges, pa.array(keys % width, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(values, pa.float64()))
    return pa.StructArray.from_arrays([pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, width), pa.int32()), *lists], fields=list(_TYPE))


def encode(buckets: int, step: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the columns ta and tb, which come last, become x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                x = vectors(b.column("ta").to_pylist(), b.column("tb").to_pylist(), buckets)
                names = b.schema.names[:-2]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), x], names=[*names, "x"])

    return run
