"""Byte-pair merges of many words at once, as numpy steps over a matrix of their symbols.

A step merges in each word the adjacent pair of the lowest rank, the leftmost of equal
ones, until a word has none; so a word's ids are those of the tokenizers BPE model.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa

NONE = np.iinfo(np.int32).max
PAD = 0xFFFF
#: Words of up to so many bytes share a matrix; longer ones go to the model itself.
WIDTHS = (4, 8, 12, 16, 24, 40)
BITS = 18


def binaries(lengths: np.ndarray, data: list) -> pa.Array:
    """Values of these lengths, which follow each other in data."""
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])


class Merges:
    def __init__(self, path: str, letters: dict[int, str]):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.uint16)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], np.uint16)
        ranks = {vocab[a] << 16 | vocab[b]: k for k, (a, b) in enumerate(model["merges"])}
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.uint16)
        # Hash tables: what finds its slot taken goes to the next one.
        key, rank = np.array([*ranks], np.uint32), np.array([*ranks.values()], np.int32)
        self.tables: list[tuple[np.uint32, np.ndarray, np.ndarray]] = []
        while len(key):
            factor = np.uint32(0x9E3779B1 + 0x3C6EF372 * len(self.tables) & 0xFFFFFFFF)
            slot, first = np.unique(key * factor >> np.uint32(32 - BITS), return_index=True)
            keys, values = np.full(1 << BITS, 0xFFFFFFFF, np.uint32), np.full(1 << BITS, NONE, np.int32)
            keys[slot], values[slot] = key[first], rank[first]
            self.tables.append((factor, keys, values))
            key, rank = np.delete(key, first), np.delete(rank, first)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right
        out = np.full(key.shape, NONE, np.int32)
        for factor, keys, values in self.tables:
            slot = key * factor >> np.uint32(32 - BITS)
            hit = keys[slot] == key
            out[hit] = values[slot[hit]]
        return out

    def _merged(self, symbols: np.ndarray):
        """(rows, their ids with PAD after them) as rows are done."""
        rows = np.arange(len(symbols))
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while ranks.size:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            go = best < NONE
            if not go.all():
                yield rows[~go], symbols[~go]
                rows, symbols, ranks, at, best = rows[go], symbols[go], ranks[go], at[go], best[go]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            symbols[each, at] = self.made[best]
            keep = np.ones(symbols.shape, bool)
            keep[each, at + 1] = False
            symbols = symbols[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            for near in (at - 1, at):
                k = each[(near >= 0) & (near < ranks.shape[1])]
                ranks[k, near[k]] = self.rank(symbols[k, near[k]], symbols[k, near[k] + 1])
        yield rows, symbols

    def ids(self, words: list[str], longer: Callable[[str], bytes]) -> pa.Array:
        """Little-endian 16-bit ids of each of words, which have no space and are not empty;
        longer does those above WIDTHS."""
        letters = np.frombuffer(" ".join([*words, ""]).encode(), np.uint8)
        stops = np.flatnonzero(letters == ord(" "))
        starts = np.append(0, stops[:-1] + 1)[: len(stops)]
        sizes = stops - starts
        of, lengths, data = [], [], []
        for low, width in zip((0, *WIDTHS), WIDTHS):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            inside = np.arange(width) < sizes[some, None]
            symbols = np.full(inside.shape, PAD, np.uint16)
            symbols[inside] = self.inner[letters[(starts[some, None] + np.arange(width))[inside]]]
            symbols[np.arange(len(some)), sizes[some] - 1] = self.final[letters[stops[some] - 1]]
            for rows, ids in self._merged(symbols):
                real = ids != PAD
                of.append(some[rows])
                lengths.append(2 * real.sum(1))
                data.append(ids[real].astype("<u2").tobytes())
        for k in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            of.append([k])
            data.append(longer(words[k]))
            lengths.append([len(data[-1])])
        place = np.empty(len(words), np.int64)
        place[np.concatenate(of)] = np.arange(len(words))
        return binaries(np.concatenate(lengths), data).take(pa.array(place))
