"""Best-fit-decreasing packing into rows of a token-id matrix.

Each task tokenizes its documents once and gathers items until TOKENS ids are held; documents longer than a row are
split, losslessly, into whole rows and a rest. Items then go, longest first, into the open row with the least room
that still holds them, which a segment tree over the possible amounts of room finds in log2(capacity) steps. A row of
the result has the padded ids, the cumulative lengths of its segments (cu_seqlens, from 0 to the ids in use), and
positions that restart at 0 with every segment (as a document's part may start later, `starts` gives its first id's
place in the document). Ids and positions are little-endian unsigned 16- or 32-bit binaries, as `width` says.

Defined cases: a null or empty text is the end id alone; very long texts are split, losslessly; repeated rows and ids are
packed as often as they occur; items of equal length (ties) keep their order, and of rows with equal room the last one
opened takes an item; a null id stays null; an empty table gives an empty result; other columns are not read, whatever
their names. A lost task gives the same rows again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 2048
TOKENS = 1 << 21


class Rooms:
    """Segment tree over 0..capacity with the number of open rows that have just so much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the open row with the least room of at least need; it is no longer open."""
        at = need + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):  # up until a right sibling has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of lengths (each from 1 to capacity) by row."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            rows.append([i])
            room, row = capacity, len(rows) - 1
        else:
            room, row = found
            rows[row].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], row)
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, pad_id: int = 0, width: int = 2, hold: int = TOKENS) -> DataFrame:
    """One row per matrix row: row_id, doc_ids, starts, cu_seqlens, input_ids, position_ids, n_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row_id long, doc_ids array<{kind}>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary, n_tokens int"
    if width not in (2, 4) or (width == 2 and capacity > 65536):
        raise ValueError("width is 2 (ids and positions under 65536) or 4")

    def run(batches):
        from pyspark import TaskContext

        enc, kind_of = tokens.encoder(path), np.dtype(f"<u{width}")
        row_id = TaskContext.get().partitionId() << 40
        count = np.arange(capacity, dtype=kind_of)
        held, size, rows, id_type = [], 0, [], None

        def emit(items):
            nonlocal row_id
            ids, pos, at = np.full(capacity, pad_id, kind_of), np.zeros(capacity, kind_of), [0]
            for _, _, x in items:
                a, b = at[-1], at[-1] + len(x)
                ids[a:b], pos[a:b] = x, count[: len(x)]
                at.append(b)
            rows.append((row_id, [d for d, _, _ in items], [s for _, s, _ in items], at, ids.tobytes(), pos.tobytes(), at[-1]))
            row_id += 1

        def flush():
            nonlocal held, size
            for row in best_fit_decreasing([len(x) for _, _, x in held], capacity):
                emit([held[i] for i in row])
            held, size = [], 0

        def batch():
            nonlocal rows
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32()]
            names = ["row_id", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids", "n_tokens"]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows = []
            return out

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(enc.ids(text.as_py()), dtype=tokens.ID)
                if width == 2 and len(ids) and int(ids.max()) > 65535:
                    raise ValueError("ids over 65535 need width=4")
                ids = np.append(ids, np.uint32(end_id)).astype(kind_of)
                whole = len(ids) - len(ids) % capacity
                for s in range(0, whole, capacity):
                    emit([(doc, s, ids[s : s + capacity])])
                if whole < len(ids):
                    held.append((doc, whole, ids[whole:].copy()))
                    size += len(ids) - whole
                if size >= hold:
                    flush()
                if len(rows) >= 500:
                    yield batch()
        if held:
            flush()
        while rows:
            yield batch()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
