"""Token ids of whole texts, a slab at a time, with a bounded cache in each Python worker.

Ids are those of the named tokenizers vocabulary. Its normaliser and its splitting
never look past a space or a line feed, so Arrow cuts a slab of texts between those,
each distinct piece of it is encoded once, and Arrow puts the ids back in the texts'
order. Pieces of Latin letters, digits and ASCII signs are split here and those of their
words that are not known yet merged together; any other piece goes through the whole
tokenizer.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .merges import Merges, binaries

VOCABULARY = "word_bpe_49k.json"
END = 1
#: A quarter of the words from which on a worker's cache starts anew.
CACHED = 25_000
#: Bytes of text whose distinct pieces are encoded together, CACHED in a step.
SLAB = 1 << 22

_PLAIN = r"\A[!-~À-ÖØ-öø-ÿ]*\z"
_WORDS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else
    the next letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.merges = Merges(path, self.letters)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}  # the place of a word's ids in found
        self.found = pa.array([b""], pa.large_binary())

    def _learn(self, words: set[str]) -> None:
        """The ids of all words come into the cache; a space has none."""
        if len(self.words) > 4 * CACHED:
            self.forget()
        if not self.words:
            self.words[" "] = 0
        if fresh := list(words.difference(self.words)):
            self.found = pa.concat_arrays([self.found, self.merges.ids(fresh, self._word)])
            self.words.update(zip(fresh, range(len(self.words), len(self.found))))

    def _word(self, word: str) -> bytes:
        spelt = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelt)], "<u2").tobytes()

    def _plain(self, pieces: pa.Array) -> pa.Array:
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), pa.scalar(" ", pieces.type))[0].as_py()
        words = _WORDS.findall(text.lower() + " ")  # a space ends a piece
        self._learn(set(words))
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        _, ends, data = self.found.take(pa.array(at)).buffers()
        ends = np.frombuffer(ends, np.int64)[1 : len(at) + 1][at == 0]
        return binaries(np.diff(ends, prepend=0), [memoryview(data)[: ends[-1]]] if data else [])

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Each piece's ids, as bytes."""
        plain = pc.and_(pc.match_substring_regex(pieces, _PLAIN), pc.invert(pc.match_substring(pieces, "<|")))
        rest = pieces.filter(pc.invert(plain)).to_pylist()
        kept = pieces.filter(plain) if rest else pieces
        ids = [np.array(self.whole.encode(p, add_special_tokens=False).ids, "<u2").tobytes() for p in rest]
        out = pa.concat_arrays([*(self._plain(kept.slice(k, CACHED)) for k in range(0, len(kept), CACHED)), pa.array(ids, pa.large_binary())])
        if rest:
            is_plain = plain.to_numpy(zero_copy_only=False)
            out = out.take(pa.array(np.where(is_plain, np.cumsum(is_plain), len(kept) + np.cumsum(~is_plain)) - 1))
        return out

    def slab(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Little-endian 16-bit ids of each text (null: empty), END included."""
        pieces = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        distinct = pieces.flatten().dictionary_encode()
        placed = self._pieces(distinct.dictionary).take(distinct.indices)
        _, ends, data = placed.buffers()
        ids = np.frombuffer(data, "<u2") if data else np.empty(0, "<u2")
        offsets = pieces.offsets.to_numpy()
        ends = np.frombuffer(ends, np.int64)[offsets - offsets[0]] // 2
        last = np.array([END], "<u2")
        for a, b in zip(ends, ends[1:]):
            yield np.concatenate((ids[a:b], last))

    def ids(self, text: str | None) -> np.ndarray:
        """Little-endian 16-bit ids of text (null: empty), END included."""
        return next(self.slab(pa.array([text], pa.string())))


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """vocabulary: a file of the installed public tokenizers, or a path."""
    import os

    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Encoder(vocabulary)


def encoded(batches, vocabulary: str = VOCABULARY) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids) for each row of Arrow batches of (doc_id, text). Workers are used again
    by other stages, so what was cached goes at the end."""
    known = encoder(vocabulary)
    try:
        for batch in batches:
            texts = batch.column(1)
            slab = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLAB
            cuts = [0, *(np.flatnonzero(np.diff(slab)) + 1).tolist(), len(slab)] if len(slab) else [0]
            for a, b in zip(cuts, cuts[1:]):
                yield from zip(batch.column(0).slice(a, b - a).to_pylist(), known.slab(texts.slice(a, b - a)))
    finally:
        known.forget()
        pa.default_memory_pool().release_unused()
