"""Packed id matrices: best-fit-decreasing with a segment tree over free capacities.

Each scan partition packs buffers of BUFFER ids: documents are split losslessly at the
window size, the pieces sorted by falling length, and each put into the window with the
least free room that holds it. That room is found in a segment tree over the capacities
0..window, which counts the windows that have each. Windows that stay loosely filled
return their pieces to the next buffer. Each sequence carries its ids, the cumulative
segment lengths, and position ids that restart at each segment.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import VOCABULARY, encoded

WINDOW = 2048
BUFFER = 2_000_000
PAD = 0
#: Windows filled less than this share are packed again with the next buffer.
FULL = 0.97
SEQUENCES = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class Capacities:
    """Counts of windows by free room, in a segment tree."""

    def __init__(self, top: int):
        self.size = 1 << (top + 1).bit_length()
        self.tree = [0] * (2 * self.size)

    def change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def least(self, room: int) -> int:
        """The least free room of at least room that a window has, or -1."""
        node, tree = room + self.size, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up, until a right neighbour holds one
                node >>= 1
            if node == 1:
                return -1
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(pieces: list[tuple], window: int = WINDOW) -> list[list[tuple]]:
    """Windows of pieces (doc_id, start, ids)."""
    rooms = Capacities(window)
    by_room: dict[int, list[list]] = {}
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        size = len(piece[2])
        room = rooms.least(size)
        if room < 0:
            room, home = window, []
        else:
            home = by_room[room].pop()
            rooms.change(room, -1)
        home.append(piece)
        by_room.setdefault(room - size, []).append(home)
        rooms.change(room - size, 1)
    return [w for room in sorted(by_room) for w in by_room[room]]


def matrix(windows: list[list[tuple]], first: int, window: int) -> pa.RecordBatch:
    ids = np.full((len(windows), window), PAD, "<u2")
    places = np.zeros((len(windows), window), "<u2")
    ends, docs, starts = [], [], []
    for k, pieces in enumerate(windows):
        end = [0]
        for _, _, part in pieces:
            ids[k, end[-1] : end[-1] + len(part)] = part
            places[k, end[-1] : end[-1] + len(part)] = np.arange(len(part))
            end.append(end[-1] + len(part))
        ends.append(end)
        docs.append([p[0] for p in pieces])
        starts.append([p[1] for p in pieces])
    cols = [
        pa.array(range(first, first + len(windows)), pa.int64()), pa.array([e[-1] for e in ends], pa.int32()), pa.array(docs, pa.list_(pa.int64())),
        pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())), pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in places], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in SEQUENCES.split(", ")])


def packed_matrices(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each sequence (SEQUENCES): input_ids and position_ids are window
    little-endian 16-bit numbers (padding: id PAD, position 0), cu_seqlens starts at 0 and
    ends at n_tokens. docs gives doc_id and text; other columns are ignored. A null or
    empty text is the end id alone; null doc_ids and repeated rows are packed like any
    other; an empty table gives no rows."""

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        held = 0

        def settle(last: bool):
            nonlocal number, pieces, held
            windows = best_fit_decreasing(pieces, window)
            loose = [] if last else [w for w in windows if sum(len(p[2]) for p in w) < FULL * window]
            done = windows if last else [w for w in windows if sum(len(p[2]) for p in w) >= FULL * window]
            for k in range(0, len(done), 512):
                yield matrix(done[k : k + 512], number + k, window)
            number += len(done)
            pieces = [p for w in loose for p in w]
            held = 0

        for doc_id, ids in encoded(batches, vocabulary):
            pieces += [(doc_id, start, ids[start : start + window]) for start in range(0, len(ids), window)]
            held += len(ids)
            if held >= BUFFER:
                yield from settle(False)
        yield from settle(True)

    return docs.select("doc_id", "text").mapInArrow(packed, SEQUENCES)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """packed_matrices as Parquet files under path."""
    packed_matrices(docs, **options).write.mode("errorifexists").parquet(path)


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of documents; ids and positions as CRC-32 of their bytes."""
    out = packed_matrices(table(spark, sf_dir, "documents"))
    return out.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))
