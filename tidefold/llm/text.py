"""Words, their hashes and shingle sets of whole Arrow batches, without a Python loop over words.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D. UTF-8 never uses those bytes inside
a character, so byte and character definitions agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(0, 2**64, 256, dtype=U64)
BASE = U64(0x9E3779B97F4A7C15)
#: Inverse of BASE modulo 2**64.
BASE_INV = U64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; a longer document is handled alone.
BLOCK = 1 << 20
#: Documents handled at once; set_keys() needs at most 2**12.
BLOCK_DOCS = 4096
SET_BITS = U64(52)
SET_MASK = U64((1 << 52) - 1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(n, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `limit` bytes of text and BLOCK_DOCS rows."""
    n = batch.num_rows
    if not n:
        return
    _, off = raw(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n, at + BLOCK_DOCS)
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and len + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    data: np.ndarray  #: bytes, lower-cased if asked
    off: np.ndarray  #: document offsets into data
    start: np.ndarray  #: of each word
    end: np.ndarray
    first: np.ndarray  #: len(docs) + 1 offsets of each document's words
    hash: np.ndarray | None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    data, off = raw(texts)
    if lower:
        data = data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    n = len(data)
    solid = np.zeros(n + 1, bool)
    np.logical_and(data != 32, (data - np.uint8(9)) >= 5, out=solid[:n])
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:-1]
    edge = np.zeros(n + 1, bool)  # a document begins here
    edge[off] = True
    start = np.flatnonzero(solid & (~before | edge))
    end = np.flatnonzero(before & (~solid | edge))
    first = np.searchsorted(start, off)
    return Words(data, off, start, end, first, span_hash(data, start, end) if hashed else None)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(TABLE[data] * p[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of k words; a document with 1 to k - 1 words has its whole sequence as one."""
    count, doc = w.count, w.doc
    pos = np.arange(len(doc)) - w.first[:-1][doc]
    room = count[doc] - pos
    at = np.flatnonzero((room >= k) | ((pos == 0) & (room < k)))
    size = np.minimum(room[at], k)
    h = np.zeros(len(at), U64)
    padded = np.concatenate([w.hash, np.zeros(k, U64)])
    for j in range(k):
        h = h * U64(0x9FB21C651E98DF25) + np.where(j < size, mix(padded[at + j] + U64(j + 1)), U64(0))
    return doc[at], mix(h + size.astype(U64))


def set_keys(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, as document << 52 | 52 bits of hash, and the set sizes."""
    doc, h = shingles(w, k)
    key = (doc.astype(U64) << SET_BITS) | (h >> U64(12))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key, np.bincount((key >> SET_BITS).astype(np.int64), minlength=len(w.first) - 1)


def fold(w: Words, salt: int) -> np.ndarray:
    """A 64-bit hash of each document's word sequence."""
    n = len(w.hash)
    p, inv = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(w.hash + U64(salt)) * p[:n], out=sums[1:])
    a, b = w.first[:-1], w.first[1:]
    return mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(U64))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] of them, for each i in turn."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - start, count)


class HashMap:
    """Open addressing from non-zero 64-bit keys to slots, with vectorised probes."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, U64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, U64)
        self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = h & self.mask
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            k = self.keys[s]
            hit = k == h[left]
            out[left[hit]] = s[hit]
            left = left[~hit & (k != 0)]
            slot[left] = (slot[left] + U64(1)) & self.mask
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Slots of distinct keys that are not in the map yet."""
        slot = h & self.mask
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[left[free]]  # of two keys for one slot the last stays
            left = left[self.keys[s] != h[left]]
            slot[left] = (slot[left] + U64(1)) & self.mask
        self.used += len(h)
        return slot.astype(np.int64)


def nonzero(h: np.ndarray) -> np.ndarray:
    return np.where(h == 0, U64(1), h)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct value, the values), values ascending."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    return order[first], s[first]


#: A space or line feed before one of these bytes begins a pre-token of byte-level BPE; not before <, which may begin a special
#: token, whose white space before it stays whole.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
SOLID[0x3C] = False
SOLID[0xC3] = True


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: ASCII punctuation but for the apostrophe, which contractions begin with, and what special tokens like <|x|> hold.
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK[LETTER] = False
MARK[0x30:0x3A] = MARK[[0x27, 0x3C, 0x3E, 0x7C]] = False


DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True


def pre_token_kinds(data: np.ndarray) -> np.ndarray:
    """Of each byte: 1 in a letter (ASCII, or of two bytes that begin with C3), 2 in an ASCII digit, 3 in punctuation of
    MARK, else 0. A run of one kind is one pre-token of byte-level BPE, with a space before it or not."""
    out = LETTER[data].view(np.uint8) | (DIGIT[data].view(np.uint8) << np.uint8(1)) | (MARK[data].view(np.uint8) * np.uint8(3))
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]  # the signs of multiplication and division are no letters
    out[lead] = out[lead + 1] = 1
    return out


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): spans that cover all bytes and that byte-level BPE encodes independently of each other.

    `first` are len(docs) + 1 offsets of each document's spans. The pre-tokenizer lets a white-space run keep
    all but its last character, so the last one, if a space or line feed, always begins a new pre-token;
    so does punctuation after a letter.
    """
    n = len(data)
    at = np.zeros(n + 1, bool)
    if n > 1:
        at[: n - 1] = ((data[:-1] == 32) | (data[:-1] == 10)) & SOLID[data[1:]]
        at[1:n] |= LETTER[data[:-1]] & MARK[data[1:]]
    full = off[1:][np.diff(off) > 0]
    last = full - 1
    at[last[SPACE[data[last]]]] = False  # white space at a document's end goes with what it follows
    at[off[:-1][np.diff(off) > 0]] = True
    at[n] = False
    start = np.flatnonzero(at)
    end = np.append(start[1:], n) if len(start) else start
    return start, end, np.searchsorted(start, off)
