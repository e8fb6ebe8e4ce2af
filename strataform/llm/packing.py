"""Sum-of-squares packing of documents into training sequences.

Each scan partition packs its own stream in one pass, without a shuffle. A document's
ids beyond whole windows form its tail; a tail goes to the fill level that leaves the
smallest sum of squared counts of partially filled windows, which keeps no level
crowded and so leaves a partner for later tails. Counts are kept in one array by fill
level. At the end of a partition the open windows are merged: pieces from the emptiest
are cut into the gaps of the fullest, so each partition ends with one partial window.

Memory is bounded by the open windows (at most one piece list for each). A lost task is
done again from its scan split and gives the same rows: sequence ids are the partition
number and a running number.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .tokens import VOCABULARY, encoded

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows of size capacity; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = WINDOW):
        self.capacity = capacity
        self.counts = np.zeros(capacity, np.int64)  # by fill level; level 0 stands for a new window
        self.open: dict[int, list[list]] = defaultdict(list)
        self.full: list[list] = []

    def level(self, size: int) -> int:
        """The level to place size at: the smallest sum of squares, then the fullest."""
        top = self.capacity - size
        counts = self.counts
        change = np.zeros(top + 1, np.int64)
        change[:top] = 2 * counts[size : size + top] + 1  # the level it moves to; a full window counts no more
        change[1:] += 1 - 2 * counts[1 : top + 1]
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def put(self, piece: tuple) -> None:
        size = len(piece[2])
        at = self.level(size)
        window = self.open[at].pop() if at else []
        if at:
            self.counts[at] -= 1
        window.append(piece)
        if at + size == self.capacity:
            self.full.append(window)
        else:
            self.counts[at + size] += 1
            self.open[at + size].append(window)

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.full.append([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if whole < len(ids):
            self.put((doc_id, whole, ids[whole:], len(ids)))

    def taken(self) -> list[list]:
        out, self.full = self.full, []
        return out

    def close(self) -> list[list]:
        """The open windows, merged: the emptiest fill the gaps of the fullest."""
        left = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        out, low, high = [], 0, len(left) - 1
        while low < high:
            fill, window = left[high]
            while fill < self.capacity and low < high:
                have, donor = left[low]
                doc_id, start, ids, tokens = donor.pop()
                part = min(len(ids), self.capacity - fill)
                window.append((doc_id, start + len(ids) - part, ids[len(ids) - part :], tokens))
                if part < len(ids):
                    donor.append((doc_id, start, ids[: len(ids) - part], tokens))
                fill += part
                left[low] = (have - part, donor)
                if not donor:
                    low += 1
            left[high] = (fill, window)
            if fill == self.capacity:
                out.append(window)
                high -= 1
        return out + [w for _, w in left[low : high + 1]]


def rows(windows: list[list], first: int) -> pa.RecordBatch:
    """PIECES of windows, numbered from first on."""
    cols: list[list] = [[] for _ in range(7)]
    for number, window in enumerate(windows, first):
        offset = 0
        for doc_id, start, ids, tokens in window:
            for col, value in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, number, offset)):
                col.append(value)
            offset += len(ids)
    names = [f.split()[0] for f in PIECES.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of docs (PIECES), which takes doc_id and text; other
    columns are ignored. A null or empty text is the end id alone; repeated rows and null
    doc_ids are packed like any other; an empty table gives no rows."""

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        bins = SumOfSquares(window)
        for doc_id, ids in encoded(batches, vocabulary):
            bins.add(doc_id, ids)
            if len(bins.full) >= 1024:
                done = bins.taken()
                yield rows(done, number)
                number += len(done)
        yield rows(bins.taken() + bins.close(), number)

    return docs.select("doc_id", "text").mapInArrow(packed, PIECES)


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
