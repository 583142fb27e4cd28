"""Packing into near-equal windows by multiway differencing (Karmarkar-Karp).

Each task reads its documents once, tokenizes them and takes whole windows off each, which stand alone. What remains of
the documents, each under a window long, gathers until it fills WINDOWS windows. Then the pieces, sorted by length, form
partial partitions of k pieces each (balanced differencing: sorted groups of k, not single pieces, are the first partial
partitions), and the two partial partitions with the widest spread are merged again and again, the fullest window of one
with the emptiest of the other. k starts at the least count that could hold the ids and rises for as long as a window
exceeds the capacity. Remainders stay whole if that leaves at most PADDING unused; if not (where most are longer than
half a window, no differencing can), they are cut into pieces of at most a half, a third, then a quarter of a window,
the first that does, so that pieces are no finer than the padding asks for. No shuffle; a task holds WINDOWS windows. A
lost task gives the same pieces again, as they depend on its rows alone; sequence ids are unique over tasks by the task's
partition number.

Defined cases: a null or empty text is the end id alone; very long texts are cut into windows, all of them; repeated rows
and ids are packed as often as they occur; pieces of equal length (ties) keep their order; a null id stays null; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 1024
#: Share of the windows that may stay unused before remainders are cut, and the parts of a window they are cut into.
PADDING, PARTS = 0.01, 4
WINDOWS = 512
SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Indices of lengths in k near-equal parts."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    heap: list[tuple] = []
    for at in range(0, len(order), k):
        row = order[at : at + k]
        sums = [lengths[i] for i in row] + [0] * (k - len(row))
        parts = [[i] for i in row] + [[] for _ in range(k - len(row))]
        heap.append((-(sums[0] - sums[-1]), len(heap), sums, parts))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        sums = np.asarray(a) + np.asarray(b)[::-1]  # both fall: the fullest meets the emptiest
        by = np.argsort(-sums, kind="stable")
        parts = [pa_[i] + pb[k - 1 - i] for i in by]
        sums = sums[by].tolist()
        made += 1
        heapq.heappush(heap, (-(sums[0] - sums[-1]), made, sums, parts))
    return heap[0][3] if heap else [[] for _ in range(k)]


def windows(lengths: list[int], capacity: int, most: int | None = None) -> list[list[int]] | None:
    """As few windows as differencing can fill without exceeding the capacity; None if these are more than `most`."""
    k = max(1, -(-sum(lengths) // capacity))
    while most is None or k <= most:
        parts = difference(lengths, k)
        over = sum(max(0, sum(lengths[i] for i in p) - capacity) for p in parts)
        if not over:
            return [p for p in parts if p]
        k += max(1, over // capacity)
    return None


def cut(lengths: list[int], most: int) -> list[tuple[int, int, int]]:
    """(index, start, length) of the pieces of at most `most` ids."""
    return [(i, s, min(most, n - s)) for i, n in enumerate(lengths) for s in range(0, n, most)]


def pieces(lengths: list[int], capacity: int, padding: float = PADDING, parts: int = PARTS) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (index, start, length): remainders whole, or cut no finer than the padding asks for."""
    ideal = -(-sum(lengths) // capacity)
    for n in range(1, parts + 1):
        got = cut(lengths, max(1, capacity // n))
        found = windows([x[2] for x in got], capacity, None if n == parts else max(ideal, int(sum(lengths) * (1 + padding) / capacity)))
        if found is not None:
            return [[got[i] for i in w] for w in found]
    raise AssertionError("the last attempt has no limit")


class _Out:
    """Rows for Arrow, some thousand at a time."""

    def __init__(self, kind: pa.DataType):
        self.schema = pa.schema([("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        cols = zip(*self.rows, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.schema.types, strict=True)], schema=self.schema)
        self.rows = []
        return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, padding: float = PADDING, per_flush: int = WINDOWS, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        tail = np.asarray([end_id], dtype=tokens.ID).tobytes()
        seq = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # document, its ids before the remainder, the remainder's ids, all its ids
        size, out = 0, None

        def flush():
            nonlocal seq, held, size
            for window in pieces([len(h[2]) // 4 for h in held], capacity, padding):
                at = 0
                for i, start, length in window:
                    doc, before, ids, n = held[i]
                    out.rows.append((doc, before + start, length, ids[4 * start : 4 * (start + length)], n, seq, at))
                    at += length
                seq += 1
            held, size = [], 0

        for b in batches:
            if out is None:
                out = _Out(b.schema.field(0).type)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(text.as_py()) + tail
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    out.rows.append((doc, start, capacity, ids[4 * start : 4 * (start + capacity)], n, seq, 0))
                    seq += 1
                    if len(out.rows) >= 2000:
                        yield out.batch()
                if whole < n:
                    held.append((doc, whole, ids[4 * whole :], n))
                    size += n - whole
                if size >= per_flush * capacity:
                    flush()
                if len(out.rows) >= 2000:
                    yield out.batch()
        if held:
            flush()
        while out is not None and out.rows:
            yield out.batch()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA.format(id=kind.simpleString()))
