"""Token ids in packed rows of fixed length: best-fit-decreasing with a segment tree.

Texts are encoded and cut into pieces of at most the row length, losslessly. Pieces gather in a
buffer of bounded size within a task, longest first each goes to the open row with the least room
that still holds it; a segment tree over amounts of room finds that row. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chat_format import VOCABULARY, load_encoding
from .common import bounded_batches

ROW = 2048
BUFFER_TOKENS = 1 << 21


class RoomTree:
    """How many open rows have each amount of room, as a segment tree; finds the least amount >= k."""

    def __init__(self, most: int):
        self.leaves = 1 << (most + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i, count = room + self.leaves, self.count
        while i:
            count[i] += by
            i >>= 1

    def least_from(self, k: int) -> int:
        """The least room >= k that some row has, or -1."""
        i, count = k + self.leaves, self.count
        if count[i]:
            return k
        while i > 1:  # up until a right neighbour holds something, then down its left side
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not count[i]:
                        i += 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, row: int = ROW) -> list[list[int]]:
    """Indices of pieces by row. Equal lengths keep their order; of equal rooms the newest row is taken."""
    tree = RoomTree(row)
    open_rows: list[list[int]] = [[] for _ in range(row + 1)]
    rows: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.least_from(n)
        if room < 0:
            rows.append([i])
            at, room = len(rows) - 1, row
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
            rows[at].append(i)
        if room - n:
            open_rows[room - n].append(at)
            tree.add(room - n, 1)
    return rows


PACKED_SCHEMA = "row_id long, n_tokens int, doc_ids array<long>, token_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary, position_ids binary"


def pack_rows(ids: list[np.ndarray], docs: list[int | None], row: int, pad: int, first_row: int, kind: np.dtype) -> pa.RecordBatch:
    """Packed rows of encoded texts: every token stands in exactly one row."""
    piece_doc, piece_off, piece_len = [], [], []
    for d, x in enumerate(ids):
        for at in range(0, len(x), row):
            piece_doc.append(d)
            piece_off.append(at)
            piece_len.append(min(row, len(x) - at))
    lengths = np.array(piece_len, dtype=np.int64)
    rows = best_fit_decreasing(lengths, row)
    matrix = np.full((len(rows), row), pad, dtype=kind)
    places = np.zeros((len(rows), row), dtype=np.uint16 if row <= 1 << 16 else np.uint32)
    out: dict[str, list] = {c: [] for c in ("n", "docs", "offs", "cu")}
    span = np.arange(row)
    for r, pieces in enumerate(rows):
        at, cu = 0, [0]
        for p in pieces:
            n = piece_len[p]
            matrix[r, at : at + n] = ids[piece_doc[p]][piece_off[p] : piece_off[p] + n]
            places[r, at : at + n] = span[:n]
            at += n
            cu.append(at)
        out["n"].append(at)
        out["docs"].append([docs[piece_doc[p]] for p in pieces])
        out["offs"].append([piece_off[p] for p in pieces])
        out["cu"].append(cu)
    cols = [
        pa.array(np.arange(first_row, first_row + len(rows))),
        pa.array(out["n"], pa.int32()),
        pa.array(out["docs"], pa.list_(pa.int64())),
        pa.array(out["offs"], pa.list_(pa.int64())),
        pa.array(out["cu"], pa.list_(pa.int32())),
        pa.array([c[:-1] for c in out["cu"]], pa.list_(pa.int32())),
        pa.array([m.tobytes() for m in matrix], pa.binary()),
        pa.array([m.tobytes() for m in places], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PACKED_SCHEMA.split(", ")])


def pack_tokens(docs: DataFrame, row: int = ROW, buffer_tokens: int = BUFFER_TOKENS, path: str = VOCABULARY) -> DataFrame:
    """Packed rows of all texts of docs(doc_id, text).

    Each row: row_id (unique), n_tokens, then for each piece in it doc_ids, token_offsets (where the
    piece starts in its text's ids), cu_seqlens (cumulative lengths, from 0), position_resets
    (where positions return to 0), and as little-endian binary of the row length input_ids (uint16
    if the vocabulary allows, else uint32; the first free id pads) and position_ids. A null or empty
    text has no tokens and stands in no row; rows that repeat, or have no doc_id, are packed each;
    more columns are ignored; an empty table gives no rows. A text longer than the buffer fills one
    by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pad = load_encoding(path)
        kind = np.dtype(np.uint16 if pad < 1 << 16 else np.uint32)
        context = TaskContext.get()
        next_row = (context.partitionId() if context else 0) << 40
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.array(encoding.encode_ordinary(text.as_py() or ""), dtype=kind)
                if len(x):
                    ids.append(x)
                    names.append(d)
                    held += len(x)
                if held >= buffer_tokens:
                    out = pack_rows(ids, names, row, pad, next_row, kind)
                    next_row += out.num_rows
                    ids, names, held = [], [], 0
                    yield out
        if ids:
            yield pack_rows(ids, names, row, pad, next_row, kind)

    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PACKED_SCHEMA)
