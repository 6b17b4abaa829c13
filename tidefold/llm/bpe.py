"""Byte-level BPE through the tokenizers library, with each distinct pre-token run encoded once."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from . import text as tx

_held: dict[tuple, Encoder] = {}


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Distinct runs that are encoded at once.
LEARNT_AT_ONCE = 20_000


def spelling() -> list[str]:
    """How byte-level vocabularies spell each byte: printable ones as themselves, the others by characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Ids of whole texts. A cache of at most 2**BITS * FILL runs makes the library's work follow distinct runs."""

    BITS, FILL = 21, 0.6

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text

        self.by_line = Tokenizer.from_file(path)
        self.by_line.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.letters, self.width = np.array([ord(c) for c in spelling()], "<u4"), self.byte_lengths()
        self.reset()

    def reset(self) -> None:
        self.map = tx.HashMap(self.BITS)
        self.start = np.zeros(1 << self.BITS, np.int32)
        self.count = np.zeros(1 << self.BITS, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.size = 0

    def byte_lengths(self) -> np.ndarray:
        """Bytes of each id; byte-level vocabularies spell every byte with one character."""
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            out[i] = len(token)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        data, off = tx.raw(texts)
        start, end, first = tx.chunks(data, off)
        h = tx.nonzero(tx.span_hash(data, start, end))
        slot = self.map.find(h)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            at, new = tx.distinct(h[miss])
            if self.map.used + len(new) > (1 << self.BITS) * self.FILL:
                self.reset()
                at, new = tx.distinct(h)
                miss = np.arange(len(h))
            if len(new) > (1 << self.BITS) * self.FILL:  # one enormous document
                return self._plain(texts)
            self._learn(data, start[miss[at]], end[miss[at]], new)
            slot = self.map.find(h)
        count = self.count[slot].astype(np.int64)
        ids = self.pool[tx.ranges(self.start[slot].astype(np.int64), count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        return ids, sums[first[1:]] - sums[first[:-1]]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.lib.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        for at in range(0, len(keys), LEARNT_AT_ONCE):
            part = slice(at, at + LEARNT_AT_ONCE)
            ids, counts = self._spans(data, start[part], end[part])
            if self.size + len(ids) > len(self.pool):
                grown = np.zeros(2 * (self.size + len(ids)), np.int32)
                grown[: self.size] = self.pool[: self.size]
                self.pool = grown
            self.pool[self.size : self.size + len(ids)] = ids
            slot = self.map.add(keys[part])
            self.start[slot] = self.size + np.cumsum(counts) - counts
            self.count[slot] = counts
            self.size += len(ids)

    def _spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans, number of ids of each). A span of letters, digits or punctuation alone, with or without one space
        before, is one pre-token: such spans go to the model together, a line each, without the pre-tokenizer's work."""
        length = end - start
        data = data[tx.ranges(start, length)]  # the spans alone from here on
        end = np.cumsum(length)
        start = end - length
        at = np.where(data[start] == 32, np.minimum(start + 1, end - 1), start)
        kind = tx.pre_token_kinds(data)
        changes = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
        simple = np.flatnonzero((kind[at] > 0) & (changes[at] == changes[end - 1]))
        length = length[simple]
        lines = np.full(int(length.sum()) + len(simple), 10, "<u4")
        lines[tx.ranges(np.cumsum(length + 1) - length - 1, length)] = self.letters[data[tx.ranges(start[simple], length)]]
        ids = np.array(self._encoded(self.by_line, [lines.tobytes().decode("utf-32-le")])[0] if len(simple) else [], np.int32)
        ends, wanted = np.cumsum(self.width[ids]), np.cumsum(length)
        to = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[to], wanted):
            raise ValueError("the vocabulary is not of byte-level BPE")
        counts, rest = np.zeros(len(start), np.int64), np.ones(len(start), bool)
        counts[simple], rest[simple] = np.diff(to + 1, prepend=0), False
        rest = np.flatnonzero(rest)
        lists = self._encoded(self.lib, [data[a:b].tobytes().decode() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
        counts[rest] = [len(x) for x in lists]
        out, place = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        out[tx.ranges(place[simple], counts[simple])] = ids
        out[tx.ranges(place[rest], counts[rest])] = list(chain.from_iterable(lists))
        return out, counts

    @staticmethod
    def _encoded(lib, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This process's encoder of a vocabulary file; Python workers are reused, so its cache outlives a task."""
    key = (path, special_as_text)
    if key not in _held:
        _held[key] = Encoder(path, special_as_text)
    return _held[key]
