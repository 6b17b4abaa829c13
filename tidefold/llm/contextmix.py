"""Language-model scoring by logistic context mixing.

A text is its lower-cased words, a space after each, and one line feed; each word, and the line feed, is a token. Its
probability is a product of predicted bits of two sorts.

* Is the token the guess? The three words before it are a hashed context; the guess is what followed them most often
  in the training documents. Whether it comes true is predicted from the guess's counts, the run of true guesses
  before it and the last four outcomes, and a true guess costs this bit alone.
* Else the token is spelt in bytes, bit by bit, from five hashed contexts: the last two, three and four bytes of the word,
  the word so far, and the word so far in documents of this class. A context and the bits so far lead to a slot
  with two counts.

Each sort mixes the log-odds of its counts by weights that gates select, learnt online, and refines the mix by an
adaptive map from what it said to what came. A document's class is its most frequent word, hashed; naming it costs the
log of its share of the documents.

A document that is learnt from is scored with one occurrence of each token, the token itself, left out of the counts, so
that its score compares with that of a held-out document and tells whether the *rest* of the corpus predicts it.

Words and three-word contexts are counted exactly, in buckets of their hashes: a block of documents sends each of its
distinct ones once and gets back what it needs. A bucket spells its words once for the whole corpus. The slots are a table of
2**MAX_SLOT_BITS at most, in which the context seen more often keeps a slot that two want.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .exchange import BUCKET_ENTRIES, of_blocks, split_at, squeeze, stretch, unpack, write_blocks
from .scratch import cut, drop

ORDERS = 5  #: the last 2, 3 and 4 bytes, the word so far, and that within a class
MIN_SLOT_BITS, MAX_SLOT_BITS = 14, 23
#: Entries that a task holds before it sends them, and bytes of words that are spelt at once.
HELD, PART = 2 << 20, 1 << 19
#: Cases that are mixed at once, so that their slots stay in the processor's cache from bit to bit.
STEP = 1 << 12
LEVELS, MAP_CELLS, LIMIT, RATE = 8, 33, 11.0, 0.03
NO_CLASS = 256
#: A document's most frequent word names its class if it comes so often.
MODE_COUNT = 4
#: Words before a token that its guess rests on.
SIGHT = 3
END = tx.U64(0xC2B2AE3D27D4EB4F)
FOLLOWER = tx.U64(0xFFFF)
LOW, TOP = tx.U64(0xFF), ~tx.U64((1 << 48) - 1)
#: The bits of a hashed context; below them there is room for a class and a byte.
CONTEXT = ~tx.U64((1 << 17) - 1)
#: A slot's counts are kept in 8 bits each: exact below 64, then by eighths of a doubling.
EXACT = 64
_C = [tx.U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct key, which of them each element is, times)."""
    order = np.argsort(key)
    s = key[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return order[at], which, np.diff(np.append(at, len(s)))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(out)


def _add_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at) if len(at) else x[:0]


def code_of(n: np.ndarray) -> np.ndarray:
    """Counts as 8 bits."""
    far = EXACT + np.rint(np.log2(np.maximum(n, EXACT) / EXACT) * 8)
    return np.where(n < EXACT, n, np.minimum(far, 255)).astype(np.uint32)


_N = np.where(np.arange(256) < EXACT, np.arange(256), EXACT * 2.0 ** ((np.arange(256) - EXACT) / 8))
_N0, _N1 = np.repeat(_N, 256), np.tile(_N, 256)
#: By code of the count of zeros << 8 | code of that of ones, and by which of them one is left out of (none, zeros, ones):
#: the log-odds, and the level of confidence, by doublings of all counts.
_LEFT = [(np.maximum(_N0 - a, 0), np.maximum(_N1 - b, 0)) for a, b in ((0, 0), (1, 0), (0, 1))]
ODDS = np.concatenate([np.log((b + 0.3) / (a + 0.3)) for a, b in _LEFT]).astype(np.float32)
LEVEL = np.concatenate([np.minimum(np.floor(np.log2(a + b + 1)), LEVELS - 1) for a, b in _LEFT]).astype(np.uint8)


# tokens of a block


class Tokens:
    """The tokens of a block's documents, each document's line feed last."""

    def __init__(self, texts: pa.Array):
        w = self.words = tx.words(texts, lower=True)
        n = self.n = len(w.first) - 1
        self.count = w.count + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.doc = np.repeat(np.arange(n), self.count)
        at = np.arange(len(w.hash)) + w.doc
        total = int(self.first[-1])
        self.hash = np.full(total, END)
        self.hash[at] = w.hash
        self.start, self.length = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.start[at], self.length[at] = w.start, w.end - w.start
        self.size = np.bincount(w.doc, weights=w.end - w.start + 1, minlength=n) + 1
        self.kind = self._kinds(w)

    def _kinds(self, w: tx.Words) -> np.ndarray:
        """Each document's class: 0, or one of 255 by the hash of its most frequent word (of equal ones the least hash)."""
        out = np.zeros(self.n, np.uint64)
        key = (w.doc.astype(tx.U64) << tx.U64(48)) | (w.hash >> tx.U64(16))
        key.sort()
        at = _heads(key)
        times, doc = np.diff(np.append(at, len(key))), (key[at] >> tx.U64(48)).astype(np.int64)
        begin = _heads(doc)
        if len(begin):
            most = np.maximum.reduceat(times, begin)
            best = np.flatnonzero(times == np.repeat(most, np.diff(np.append(begin, len(doc)))))
            best = best[_heads(doc[best])]
            best = best[times[best] >= MODE_COUNT]
            out[doc[best]] = tx.mix(key[at[best]] & tx.U64((1 << 48) - 1)) % tx.U64(255) + tx.U64(1)
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (word, class): (index of one token of each, which each token is, ascending keys)."""
        key = (self.hash & ~LOW) | self.kind[self.doc]
        one, which, _ = _grouped(key)
        return one, which, key[one]

    def sight(self) -> tuple[np.ndarray, np.ndarray]:
        """(tokens with SIGHT words before them in their document, 48 bits of a hash of those << 16 | 16 bits of a hash of the
        token)."""
        t = np.flatnonzero(np.arange(len(self.hash)) - self.first[self.doc] >= SIGHT)
        h = np.zeros(len(t), tx.U64)
        for j in range(1, SIGHT + 1):
            h = (h ^ self.hash[t - j]) * _C[0]
            h ^= h >> tx.U64(29)
        return t, (tx.mix(h) & ~FOLLOWER) | (self.hash[t] >> tx.U64(48))


def _emit(word_bits: int, guess_bits: int, held: int):
    """What the blocks ask: rows of kind 0 of their distinct words, of kind 1 of their distinct contexts and followers."""

    def rows(kind: int, block: int, h: np.ndarray, bits: int, cols: list[np.ndarray], data: tuple[np.ndarray, np.ndarray] | None = None):
        buckets, bounds = split_at(h, bits)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        packed = [pa.array([squeeze(x[a:b]) for a, b in spans], pa.binary()) for x in (h, *cols)]
        packed += [pa.nulls(len(spans), pa.binary())] * (4 - len(packed))
        packed.append(pa.nulls(len(spans), pa.binary()) if data is None else pa.array([squeeze(data[0][data[1][a] : data[1][b]]) for a, b in spans], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(spans), pa.int32()), pa.array(buckets, pa.int32()), pa.array([block] * len(spans), pa.int64()), *packed], names=["kind", "bucket", "block", "h", "p0", "p1", "p2", "p3"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for k in range(some.num_rows):
                block, batch = some.column(0)[k].as_py(), unpack(some.column(1)[k].as_py())
                t, learnt = Tokens(batch.column(2)), np.asarray(batch.column(1)) != held
                one, which, key = t.entries()
                all_ = np.bincount(which, minlength=len(one))
                n = np.bincount(which, weights=learnt[t.doc], minlength=len(one)).astype(np.int64)
                use = (n > 0).astype(np.uint8) | ((all_ > n).astype(np.uint8) << np.uint8(1))
                length = t.length[one]
                data = t.words.data[tx.ranges(t.start[one], length)]
                yield rows(0, block, key, word_bits, [n.astype(np.uint32), use, length.astype(np.uint32)], (data, np.concatenate([[0], np.cumsum(length)])))
                at, cf = t.sight()
                if len(at):
                    order = np.argsort(cf)
                    cf, mine = cf[order], learnt[t.doc[at]][order]
                    head = _heads(cf)
                    n = _add_at(mine.astype(np.int64), head)
                    whole = n < np.diff(np.append(head, len(cf)))  # a document that isn't learnt from asks
                    yield rows(1, block, cf[head], guess_bits, [n.astype(np.uint32), whole.astype(np.uint8)])

    return run


EMITTED = "kind int, bucket int, block long, h binary, p0 binary, p1 binary, p2 binary, p3 binary"
GATHERED = "kind int, bucket int, block long, a binary, b binary, c binary, d binary, e binary, f binary, v long, total long, n_bytes long, blocks array<long>, places array<binary>"
_GATHERED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in "abcdef"), ("v", pa.int64()), ("total", pa.int64()), ("n_bytes", pa.int64()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])


def _gather(table: pa.Table) -> pa.Table:
    """One bucket of what the blocks asked."""
    rows = table.to_pylist()
    rows.sort(key=lambda r: r["block"])
    out = [_words_of(rows)] if rows[0]["kind"] == 0 else _guesses_of(rows)
    return pa.Table.from_pylist(out, _GATHERED)


def _words_of(rows: list[dict]) -> dict:
    """The bucket's distinct words: bytes (a), lengths (b), classes (c), training counts (d), those of the word in all
    classes (e), uses (f); and where each block's words are among them."""
    hs = [stretch(r["h"], tx.U64) for r in rows]
    h = np.concatenate(hs)
    one, which, _ = _grouped(h)
    n = np.bincount(which, weights=np.concatenate([stretch(r["p0"], np.uint32) for r in rows]), minlength=len(one)).astype(np.int64)
    asked_whole = np.bincount(which, weights=np.concatenate([stretch(r["p1"], np.uint8) for r in rows]) >> 1, minlength=len(one)) > 0
    use = (n > 0).astype(np.uint8) | (asked_whole.astype(np.uint8) << np.uint8(1))
    length = np.concatenate([stretch(r["p2"], np.uint32) for r in rows]).astype(np.int64)
    data = np.concatenate([stretch(r["p3"], np.uint8) for r in rows])
    data = data[tx.ranges((np.cumsum(length) - length)[one], length[one])]
    key = h[one]
    word = _heads(key & ~LOW)
    each = _add_at(n, word)
    bounds = np.cumsum([0, *map(len, hs)])
    return {
        "kind": 0, "bucket": rows[0]["bucket"], "a": squeeze(data), "b": squeeze(length[one].astype(np.int32)), "c": squeeze((key & LOW).astype(np.uint8)), "d": squeeze(n),
        "e": squeeze(np.repeat(each, np.diff(np.append(word, len(key))))), "f": squeeze(use), "v": int((each > 0).sum()), "total": int(n.sum()), "n_bytes": len(data),
        "blocks": [r["block"] for r in rows], "places": [squeeze(which[a:b].astype(np.uint32)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
    }


def _guesses_of(rows: list[dict]) -> list[dict]:
    """To each block, of its contexts that other places know: place (a), the two most frequent followers (b, c; count << 16
    | the complement of the follower's 16 bits) and the count of all followers (d)."""
    hs = [stretch(r["h"], tx.U64) for r in rows]
    h, n = np.concatenate(hs), np.concatenate([stretch(r["p0"], np.uint32) for r in rows]).astype(np.int64)
    order = np.argsort(h)
    sorted_ = h[order]
    pair = _heads(sorted_)
    c = sorted_[pair] >> tx.U64(16)
    # of the pairs of a context the greatest is the most frequent, and of equal ones that of the least follower
    rank = (_add_at(n[order], pair) << 16) | (int(FOLLOWER) - (sorted_[pair] & FOLLOWER).astype(np.int64))
    at = _heads(c)
    size = np.diff(np.append(at, len(c)))
    first, total = np.maximum.reduceat(rank, at), _add_at(rank >> 16, at)
    rank[rank == np.repeat(first, size)] = 0
    second = np.maximum.reduceat(rank, at)
    context = np.empty(len(h), np.int64)
    context[order] = np.repeat(np.repeat(np.arange(len(at)), size), np.diff(np.append(pair, len(h))))
    out, begin = [], 0
    for r, mine in zip(rows, hs, strict=True):
        head = _heads(mine >> tx.U64(16))
        where, whole = context[begin + head], np.maximum.reduceat(stretch(r["p1"], np.uint8), head)
        begin += len(mine)
        # the one occurrence of a document that is learnt from tells that document nothing
        told = np.flatnonzero((total[where] > 1) | ((total[where] == 1) & (whole > 0)))
        if len(told):
            g = where[told]
            out.append({"kind": 1, "bucket": r["bucket"], "block": r["block"], "a": squeeze(told.astype(np.uint32)), "b": squeeze(first[g]), "c": squeeze(second[g]), "d": squeeze(total[g])})
    return out


# guesses

LV, PURE, RUN, HIST = 8, 4, 8, 81
FLAG_KEYS = LV * PURE * RUN * HIST


def _level(n: np.ndarray, most: int) -> np.ndarray:
    """0 for 0, 1 for 1, 2 for 2 and 3, and so on by doubling."""
    return np.minimum(np.frexp(n.astype(np.float64))[1], most)


def guess_keys(t: Tokens, learnt: np.ndarray, told: list[dict], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token (key of what its guess is judged by, or -1 without a guess; whether the guess comes true)."""
    key, right = np.full(len(t.hash), -1, np.int64), np.zeros(len(t.hash), bool)
    at, cf = t.sight()
    if not len(at):
        return key, right
    one, which, _ = _grouped(cf >> tx.U64(16))
    found = np.zeros((3, len(one)), np.int64)
    buckets, bounds = split_at(cf[one], bits)
    begin = dict(zip(buckets.tolist(), bounds.tolist(), strict=False))
    for r in told:
        place = begin[r["bucket"]] + stretch(r["a"], np.uint32).astype(np.int64)
        for k, x in enumerate("bcd"):
            found[k, place] = stretch(r[x], np.int64)
    first, second, total = found[:, which]
    own, f = learnt[t.doc[at]].astype(np.int64), int(FOLLOWER) - (cf & FOLLOWER).astype(np.int64)
    f1, f2 = first & int(FOLLOWER), second & int(FOLLOWER)
    n1, n2 = first >> 16, second >> 16
    n1, n2, total = n1 - own * ((f1 == f) & (n1 > 0)), n2 - own * ((f2 == f) & (n2 > 0)), total - own
    n, guess = np.maximum(n1, n2), np.where(n2 > n1, f2, f1)
    has = n > 0
    hit = has & (guess == f)
    outcome = np.zeros(len(t.hash), np.int64)
    outcome[at] = has.astype(np.int64) + hit
    right[at] = hit
    pos = np.arange(len(t.hash)) - t.first[t.doc]
    hist = np.zeros(len(t.hash), np.int64)
    for j in range(1, 5):
        hist[j:] += 3 ** (j - 1) * outcome[:-j] * (pos[j:] >= j)
    # the run of true guesses just before a token; a document's first tokens have no guess and end every run
    missed = np.maximum.accumulate(np.where(outcome == 2, -1, np.arange(len(outcome))))
    run = np.zeros(len(outcome), np.int64)
    run[1:] = np.arange(len(outcome) - 1) - missed[:-1]
    pure = (2 * n >= total).astype(np.int64) + (4 * n >= 3 * total) + (n >= total)
    own_key = ((_level(n, LV) - 1) * PURE + pure) * RUN + _level(run[at], RUN - 1)
    key[at[has]] = (own_key * HIST + hist[at])[has]
    return key, right


def _flag_contexts() -> np.ndarray:
    """(contexts of the three predictors of each key, and its two gates)."""
    k = np.arange(FLAG_KEYS)
    hist, run, pure, lv = k % HIST, k // HIST % RUN, k // (HIST * RUN) % PURE, k // (HIST * RUN * PURE)
    return np.stack([lv * PURE + pure, lv * RUN + run, hist * PURE + pure, lv * RUN + run, pure * RUN + hist % 3])


def fit_flags(counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The probability of a true guess for each key, from how often (false, true) guesses came with it: the log-odds
    of three contexts' counts, mixed and refined as bits are."""
    contexts = _flag_contexts()
    sums = [np.stack([np.bincount(c, counts[y], c.max() + 1) for y in (0, 1)]) for c in contexts[:3]]

    def inputs(key: np.ndarray, left_out: np.ndarray) -> np.ndarray:
        x = np.ones((4, len(key)), np.float32)
        for j, s in enumerate(sums):
            n = np.maximum(s[:, contexts[j][key]] - left_out, 0)
            x[j] = np.log((n[1] + 0.3) / (n[0] + 0.3))
        return x

    mixer = Mixer(kinds=1, inputs=3)
    y, key = np.nonzero(counts)
    times = counts[y, key].astype(np.float64)
    x, gates = inputs(key, np.stack([1 - y, y])), (contexts[3][key], contexts[4][key])
    for r in range(rounds if len(key) else 0):
        if r == rounds - 1:
            mixer.map[:] = 0  # the map is to hold what the last weights say
        mixer.learn(x, gates, 0, y.astype(np.float64), times)
    all_ = np.arange(FLAG_KEYS)
    z = mixer.logit(inputs(all_, np.zeros((2, 1))), (contexts[3], contexts[4]))
    return mixer.refine(z, 0)


# spelling


def contexts(seen: np.ndarray, so_far: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Hashes (ORDERS x cases) of the contexts, CONTEXT bits each; the last two share their leading bits."""
    last = [tx.mix((seen & np.uint32((1 << (8 * j)) - 1)).astype(tx.U64) + (tx.U64(j) << tx.U64(40))) for j in (2, 3, 4)]
    word = tx.mix(so_far + (tx.U64(9) << tx.U64(40))) & CONTEXT
    return np.stack([*(x & CONTEXT for x in last), word, in_class(word, kind)])


def in_class(word: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return (word & TOP) | (tx.mix(word + (kind.astype(tx.U64) + tx.U64(1)) * _C[2]) & ~TOP & CONTEXT)


class Spelling:
    """Distinct (class, left out or not, word so far, next byte) of some words, and which of them each byte is."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray, left_out: np.ndarray):
        n, begin, length = len(data), off[:-1], np.diff(off)
        wide = np.zeros(n + 4, np.uint32)
        wide[4:] = data
        seen = wide[3:-1] | (wide[2:-2] << np.uint32(8)) | (wide[1:-3] << np.uint32(16)) | (wide[:-4] << np.uint32(24))
        for k in range(4):
            at = begin[length > k] + k
            seen[at] &= np.uint32((1 << (8 * k)) - 1)
        p, inv = tx.powers(n + 1)
        sums = np.zeros(n + 1, tx.U64)
        np.cumsum(tx.TABLE[data] * p[:-1], out=sums[1:])
        so_far = (sums[:-1] - np.repeat(sums[begin], length)) * np.repeat(inv[begin], length)
        so_far += (np.arange(n) - np.repeat(begin, length)).astype(tx.U64)
        kinds, out = np.repeat(kind, length), np.repeat(left_out, length)
        key = (tx.mix(so_far + (kinds.astype(tx.U64) * tx.U64(2) + out.astype(tx.U64)) * _C[1]) & ~LOW) | data
        one, self.which, _ = _grouped(key)
        self.key, self.kind, self.left_out, self.begin = key[one], kinds[one], out[one], begin
        self.byte = data[one].astype(tx.U64)
        self.ctx = contexts(seen[one], so_far[one], self.kind)

    def weights(self, n: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each distinct case the sum of its words' n."""
        return np.bincount(self.which, weights=np.repeat(n, length), minlength=len(self.key))


def _parts(row: dict, pick: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, bytes as they are spelt, offsets) of the words `pick` of a bucket, PART bytes at a time; words
    that begin alike come together."""
    data, length, kind = stretch(row["a"], np.uint8), stretch(row["b"], np.int32).astype(np.int64), stretch(row["c"], np.uint8)
    start = np.cumsum(length) - length
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lead = np.zeros(len(pick), tx.U64)
    for j in range(8):
        lead = (lead << tx.U64(8)) | np.where(j < length[pick], padded[start[pick] + j], 0).astype(tx.U64)
    pick = pick[np.lexsort((start[pick], lead, kind[pick]))]
    ends = np.cumsum(length[pick] + 1)
    at = 0
    while at < len(pick):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        some = pick[at:to]
        off = np.concatenate([[0], np.cumsum(length[some] + 1)])
        spelt = np.full(off[-1], 32, np.uint8)
        spelt[off[1:][length[some] == 0] - 1] = 10  # the line feed is a token without bytes of its own
        spelt[tx.ranges(off[:-1], length[some])] = data[tx.ranges(start[some], length[some])]
        yield some, spelt, off
        at = to


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    at = _heads(h)
    return h[at], _add_at(n[order], at)


def _count(bits: int):
    """(piece, h, n): how often each byte followed each context; h is context | class << 8 | byte, for the word so far by
    class, for the others with NO_CLASS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def flush(h, n) -> pa.RecordBatch:
            pieces, bounds = split_at(h, bits)
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), *(pa.array([squeeze(x[a:b]) for a, b in spans], pa.binary()) for x in (h, n))], names=["piece", "h", "n"])

        for row in _rows(batches):
            n, kind = stretch(row["d"], np.int64), stretch(row["c"], np.uint8)
            for some, spelt, off in _parts(row, np.flatnonzero(n)):
                s = Spelling(spelt, off, kind[some], np.zeros(len(some), np.uint8))
                w = s.weights(n[some], np.diff(off)).astype(np.int64)
                held.append((s.ctx[3] | (s.kind.astype(tx.U64) << tx.U64(8)) | s.byte, w))
                held += [_summed(c | tx.U64(NO_CLASS << 8) | s.byte, w) for c in s.ctx[:3]]
                if sum(len(x[0]) for x in held) > HELD:
                    held = [joined()]
                    if len(held[0][0]) > HELD // 2:
                        yield flush(*held[0])
                        held = []
        if held:
            yield flush(*joined())

    return run


def _groups(ctx: np.ndarray, half: np.ndarray, piece_bits: int, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, check) of the 16 neighbouring slots that serve four bits after a context: the first four of a byte where
    half is 0, the others where it is 16 and the first four bits. The slot differs in its low bits by context, so
    that contexts which share a group do not all begin at one slot; a node's slot is that xor its _place."""
    x = (ctx ^ ((half + tx.U64(1)) * _C[1])) * _C[2]
    x ^= x >> tx.U64(29)
    x *= _C[0]
    low = tx.U64(slot_bits - piece_bits)
    return ((ctx >> tx.U64(64 - piece_bits)) << low | (x >> (tx.U64(64) - low))).astype(np.int64), (x & tx.U64(0xFFFF)).astype(np.uint32) | np.uint32(1)


def _half(byte: np.ndarray, k: int) -> np.ndarray:
    """Which four bits bit k is among, as _groups takes it."""
    return np.zeros(len(byte), tx.U64) if k < 4 else tx.U64(16) + (byte >> tx.U64(4))


def _place(byte: np.ndarray, k: int) -> np.ndarray:
    """The slot within its group: a leading 1 and those of the four bits that are known."""
    j = k % 4
    known = (byte >> tx.U64(8 - k)) & tx.U64((1 << j) - 1)
    return (known | tx.U64(1 << j)).astype(np.int64)


def _piece(piece_bits: int, slot_bits: int):
    """The slots of one piece of the model from all counts whose contexts it holds."""

    def run(table: pa.Table) -> pa.Table:
        h, n = (np.concatenate([stretch(b, t) for b in table.column(c).to_pylist()]) for c, t in (("h", tx.U64), ("n", np.int64)))
        kind = (h >> tx.U64(8)) & tx.U64(0x1FF)
        own = kind != NO_CLASS
        word = h[own] & CONTEXT
        h, n = _summed(np.concatenate([(h & CONTEXT) | (h & LOW), in_class(word, kind[own]) | (h[own] & LOW)]), np.concatenate([n, n[own]]))
        ctx, byte = h & CONTEXT, h & LOW
        nodes: list[np.ndarray] = []
        for k in range(8):
            node = byte >> tx.U64(8 - k)
            bit = (byte >> tx.U64(7 - k)) & tx.U64(1)
            # bytes ascend within a context, so nodes do too
            at = _heads(ctx, node)
            n1, both = np.add.reduceat(n * bit.astype(np.int64), at), np.add.reduceat(n, at)
            slot, check = _groups(ctx[at], _half(byte[at], k), piece_bits, slot_bits)
            slot ^= _place(byte[at], k)
            nodes.append(np.stack([slot, check.astype(np.int64), both - n1, n1]))
        slot, check, n0, n1 = np.concatenate(nodes, axis=1)
        order = np.argsort(slot)
        rank, at = ((n0 + n1) << 16 | check)[order], _heads(slot[order])
        # the node seen most keeps the slot, and of equal ones that of the greatest check
        best = np.flatnonzero(rank == np.repeat(np.maximum.reduceat(rank, at), np.diff(np.append(at, len(rank)))))
        first = order[best[_heads(slot[order][best])]]
        value = (check[first].astype(np.uint32) << np.uint32(16)) | (code_of(n0[first]) << np.uint32(8)) | code_of(n1[first])
        return pa.table({"slot": pa.array([squeeze(slot[first].astype(np.uint32))], pa.binary()), "value": pa.array([squeeze(value)], pa.binary())})

    return run


class Lookup:
    """The evidence of all predictors for some cases, bit by bit; slots are found once for four bits. Where left_out is 1,
    one occurrence of the case is left out of the counts."""

    def __init__(self, table: np.ndarray, ctx: np.ndarray, byte: np.ndarray, left_out: np.ndarray, piece_bits: int):
        self.table, self.ctx, self.byte, self.piece_bits = table, ctx, byte, piece_bits
        self.left_out, self.slot_bits = left_out.astype(np.uint32), len(table).bit_length() - 1

    def bit(self, k: int, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(inputs, gates, bits) of bit k for the cases `at`; a predictor whose slots are another's gives 0 at level 0."""
        if k % 4 == 0:
            half = _half(self.byte, k)
            self.groups = [_groups(c, half, self.piece_bits, self.slot_bits) for c in self.ctx]
        byte = self.byte[at]
        place = _place(byte, k)
        bit = ((byte >> tx.U64(7 - k)) & tx.U64(1)).astype(np.uint32)
        left = (self.left_out[at] * (bit + np.uint32(1))) << np.uint32(16)
        x = np.ones((ORDERS + 1, len(byte)), np.float32)
        level = []
        for o, (first, check) in enumerate(self.groups):
            v = self.table.take(first[at] ^ place)
            v &= np.uint32(0xFFFF) * ((v >> np.uint32(16)) == check[at])
            v |= left
            x[o] = ODDS.take(v)
            if o:  # no gate asks the first
                level.append(LEVEL.take(v).astype(np.int64))
        here = k * LEVELS
        return x, ((here + level[3]) * LEVELS + level[2], (here + level[1]) * LEVELS + level[0]), bit


class Mixer:
    """Two gated sets of weights, whose dot products add up, and the adaptive map after them; for `kinds` kinds of bit,
    each with LEVELS * LEVELS gates."""

    def __init__(self, state: np.ndarray | None = None, kinds: int = 8, inputs: int = ORDERS):
        self.inputs = inputs + 1
        shape = (2, self.inputs, kinds * LEVELS * LEVELS)
        self.slope = np.zeros(shape)
        self.size = int(np.prod(shape))
        if state is None:
            self.weights = np.full(shape, 0.15, np.float64)
            self.weights[:, inputs] = 0
            self.map = np.zeros((2, kinds, MAP_CELLS))
        else:
            self.weights = state[: self.size].reshape(shape).astype(np.float32)
            self.map = state[self.size :].reshape(2, kinds, MAP_CELLS)

    def state(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.map.ravel()])

    def logit(self, x: np.ndarray, g: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        z = np.zeros(x.shape[1], self.weights.dtype)
        for o, own in enumerate(x):
            z += (self.weights[0, o].take(g[0]) + self.weights[1, o].take(g[1])) * own
        return np.clip(z, -LIMIT, LIMIT)

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        return np.rint((z + LIMIT) * ((MAP_CELLS - 1) / (2 * LIMIT))).astype(np.int64)

    def refine(self, z: np.ndarray, k: int) -> np.ndarray:
        """The probability of a 1: the mean of the mix's and the map's."""
        p = 1 / (1 + np.exp(-z))
        ones, all_ = self.map[0, k], self.map[1, k]
        center = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, MAP_CELLS)))
        said = (ones + 30 * center) / (all_ + 30)
        pos = (z + LIMIT) * ((MAP_CELLS - 1) / (2 * LIMIT))
        low = np.minimum(pos.astype(np.int64), MAP_CELLS - 2)
        part = pos - low
        return np.clip(0.5 * p + 0.5 * (said[low] * (1 - part) + said[low + 1] * part), 2.0**-16, 1 - 2.0**-16)

    def learn(self, x: np.ndarray, g: tuple[np.ndarray, np.ndarray], k: int, bit: np.ndarray, times: np.ndarray) -> None:
        """One online step for each run of STEP cases: predict, note in the map, then move the weights."""
        gates, low = LEVELS * LEVELS, k * LEVELS * LEVELS  # the gates of this bit
        here = slice(low, low + gates)
        for a in range(0, x.shape[1], STEP):
            part = slice(a, a + STEP)
            xs, gs, y, t = x[:, part], (g[0][part], g[1][part]), bit[part], times[part]
            z = self.logit(xs, gs)
            cell = self.cell(z)
            self.map[0, k] += np.bincount(cell, y * t, MAP_CELLS)
            self.map[1, k] += np.bincount(cell, t, MAP_CELLS)
            miss = t * (y - 1 / (1 + np.exp(-z)))
            step = [miss * own for own in xs]
            for s in (0, 1):
                at = gs[s] - low
                total = np.stack([np.bincount(at, own, gates) for own in step])
                total /= np.sqrt(np.maximum(np.bincount(at, t, gates), 1))
                # steps shrink with the slope seen so far, so no frequent case takes one too far
                self.slope[s, :, here] += total**2
                self.weights[s, :, here] += RATE * total / np.sqrt(self.slope[s, :, here] + 1e-6)
        np.clip(self.weights, -4, 4, out=self.weights)


#: States are added up as whole numbers of this part, so that no order of addition changes them.
UNIT = 1 << 20


def _fit(model, piece_bits: int):
    """The state of each bucket's online run over its words, every one as often as it comes in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            n, kind = stretch(row["d"], np.int64), stretch(row["c"], np.uint8)
            pick = np.flatnonzero(n)
            if not len(pick):
                continue
            mixer = Mixer()
            for some, spelt, off in _parts(row, pick):
                s = Spelling(spelt, off, kind[some], np.ones(len(some), np.uint8))
                times = s.weights(n[some], np.diff(off))
                for a in range(0, len(times), STEP):
                    part = slice(a, a + STEP)
                    lookup = Lookup(model.value, s.ctx[:, part], s.byte[part], s.left_out[part], piece_bits)
                    for k in range(8):
                        x, g, bit = lookup.bit(k)
                        mixer.learn(x, g, k, bit.astype(np.float64), times[part])
            state = mixer.state()
            state[: mixer.size] *= UNIT
            yield pa.RecordBatch.from_arrays([pa.array([np.rint(state).astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["state"])

    return run


def log10_of(table: np.ndarray, mixer: Mixer, s: Spelling, piece_bits: int) -> np.ndarray:
    """Of each distinct case the log10 probability of its byte. Cases that agree in all but the bits to come follow each
    other, and their next bit is predicted once."""
    out = np.zeros(len(s.key))
    for a in range(0, len(s.key), STEP):
        part = slice(a, a + STEP)
        keys, byte = s.key[part], s.byte[part]
        lookup = Lookup(table, s.ctx[:, part], byte, s.left_out[part], piece_bits)
        for k in range(8):
            # a left-out case differs from its neighbours by its own bit
            at = _heads(keys >> tx.U64(7 - k))
            x, g, bit = lookup.bit(k, at)
            p = mixer.refine(mixer.logit(x, g), k)
            out[part] += np.repeat(np.log10(np.where(bit > 0, p, 1 - p)), np.diff(np.append(at, len(keys))))
    return out


def _spell(model, state: np.ndarray, piece_bits: int):
    """To each block its words' counts in training and log10 probabilities when spelt: with all counts where held-out
    documents hold the word, with one occurrence left out where others do, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(state)
        for row in _rows(batches):
            kind, use, c = stretch(row["c"], np.uint8), stretch(row["f"], np.uint8), stretch(row["e"], np.int64)
            lp = np.zeros((2, len(kind)), np.float32)
            for left in (0, 1):
                for some, spelt, off in _parts(row, np.flatnonzero(use & (1 if left else 2))):
                    s = Spelling(spelt, off, kind[some], np.full(len(some), left, np.uint8))
                    lp[left, some] = np.add.reduceat(log10_of(model.value, mixer, s, piece_bits)[s.which], off[:-1])
            places = [stretch(x, np.uint32).astype(np.int64) for x in row["places"]]
            cols = [pa.array(row["blocks"], pa.int64()), pa.array([row["bucket"]] * len(places), pa.int32())]
            cols += [pa.array([squeeze(x[p]) for p in places], pa.binary()) for x in (c, lp[0].view(np.uint32), lp[1].view(np.uint32))]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "bucket", "n", "whole", "left"])

    return run


# scores

READ = "id long, n_tokens long, n_known long, base_score double, spelt double, size long, learnt boolean, kind int, keys array<int>, times array<int>"


def _read(guess_bits: int, held: int, total: int, distinct: int, batch: pa.RecordBatch, told: list | None, guessed: list | None) -> pa.RecordBatch:
    """A block's documents, scored but for the bits of their guesses, of which `keys` and `times` hold how many of which
    kind there are: twice the key, and 1 if true."""
    t, learnt = Tokens(batch.column(2)), np.asarray(batch.column(1)) != held
    _, which, _ = t.entries()
    told = sorted(told, key=lambda r: r["bucket"])
    c = np.concatenate([stretch(r["n"], np.int64) for r in told])[which]
    whole, left = (np.concatenate([stretch(r[x], np.uint32) for r in told]).view(np.float32)[which] for x in ("whole", "left"))
    key, right = guess_keys(t, learnt, guessed or [], guess_bits)
    lp = np.where(learnt[t.doc], left, whole).astype(np.float64)
    per_doc = lambda x: np.bincount(t.doc, weights=x, minlength=t.n)
    has = key >= 0
    both = (t.doc[has] * (2 * FLAG_KEYS) + 2 * key[has] + right[has]).astype(np.int64)
    both, times = np.unique(both, return_counts=True)
    doc = both // (2 * FLAG_KEYS)
    off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.n))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x, pa.int32())) for x in (both % (2 * FLAG_KEYS), times)]
    ints = [t.count, per_doc(c > 0)]
    cols = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in ints), pa.array(per_doc(np.log10((c + 1) / (total + distinct + 1)))), pa.array(per_doc(np.where(right, 0, lp)))]
    cols += [pa.array(t.size.astype(np.int64)), pa.array(learnt), pa.array(t.kind.astype(np.int32)), *lists]
    return pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "n_known", "base_score", "spelt", "size", "learnt", "kind", "keys", "times"])


def _finish(flags: np.ndarray, kinds: np.ndarray):
    """flags: log10 probability of each key's two outcomes; kinds: of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            score = np.asarray(b.column(4)) + kinds[np.asarray(b.column(7))]
            lists = b.column(8)
            doc = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
            score = score + np.bincount(doc, weights=flags[np.asarray(lists.flatten())] * np.asarray(b.column(9).flatten()), minlength=n)
            bits = -score * np.log2(10) / np.asarray(b.column(5))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(score), pa.array(bits)], names=["id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    return run


def _remainder(i: Column, folds: int) -> Column:
    return F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(folds))


def _bits(entries: float) -> int:
    """Leading bits that give buckets of about BUCKET_ENTRIES."""
    return min(30, max(1, int(np.ceil(np.log2(max(2.0, entries / BUCKET_ENTRIES))))))


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs; ids are numbers.

    Documents whose crc32(id as text) mod `folds` is `held` are scored only; the model learns from all others.
    base_score is the add-one unigram log10 probability of the lower-cased words and one end token; score is the
    model's log10 probability of the same sequence, spelt in bytes; a document that is learnt from has one occurrence
    of each of its own tokens left out of the counts. Null text is empty: the end alone. A null id is scored and not learnt
    from, held_out false. Repeated rows count as often as they come. Nothing to learn from: every bit has probability
    one half. No rows: none. Other columns are ignored.
    """
    spark = docs.sparkSession
    i = F.col(id_col).cast("long")
    src = docs.select(i.alias("id"), F.coalesce(_remainder(i, folds), F.lit(held)).cast("int").alias("fold"), F.col(text_col).cast("string").alias("text"))
    blocks = write_blocks(src, {"id": "long", "fold": "int", "text": "string"})
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0

    # words and contexts
    word_bits, guess_bits = _bits(n_bytes * 0.04), _bits(n_bytes * 0.15)
    asked = blocks.select("block", "data").mapInArrow(_emit(word_bits, guess_bits, held), EMITTED)
    gathered = cut(asked.groupBy("kind", "bucket").applyInArrow(_gather, GATHERED), "gathered", "kind")
    words, guesses = gathered.where("kind = 0"), gathered.where("kind = 1")
    distinct, total, spelt = (x or 0 for x in words.agg(F.sum("v"), F.sum("total"), F.sum("n_bytes")).first())

    # the model's counts
    slot_bits = min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, int(4 * spelt).bit_length()))
    piece_bits = min(slot_bits - 6, _bits(2.0 * spelt))
    counts = words.select("a", "b", "c", "d").mapInArrow(_count(piece_bits), "piece int, h binary, n binary")
    slots = counts.groupBy("piece").applyInArrow(_piece(piece_bits, slot_bits), "slot binary, value binary")
    table = np.zeros(1 << slot_bits, np.uint32)
    for row in slots.collect():  # 2**MAX_SLOT_BITS slots at most
        table[stretch(row["slot"], np.uint32)] = stretch(row["value"], np.uint32)
    model = spark.sparkContext.broadcast(table)

    # the mixing weights: the mean of the buckets' online runs, and the sum of their maps
    runs = words.select("a", "b", "c", "d").mapInArrow(_fit(model, piece_bits), "state array<long>")
    sums = runs.select(F.posexplode("state").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()
    fresh = Mixer()
    state = fresh.state()
    if sums:
        state = np.array([float(r["x"]) for r in sums])
        state[: fresh.size] /= UNIT * sums[0]["n"]

    # each word is spelt once; each document is read once
    told = words.select("bucket", "a", "b", "c", "e", "f", "blocks", "places").mapInArrow(_spell(model, state, piece_bits), "block long, bucket int, n binary, whole binary, left binary")
    told = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "whole", "left")).alias("told"))
    guessed = guesses.groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b", "c", "d")).alias("guessed"))
    joined = blocks.join(told, "block", "left").join(guessed, "block", "left")
    read = cut(of_blocks(joined, partial(_read, guess_bits, held, total, distinct), READ, ("told", "guessed")), "read")
    drop(blocks, gathered)

    # whether guesses come true
    flags = np.zeros((2, FLAG_KEYS))
    heard = read.where("learnt").select(F.explode(F.arrays_zip("keys", "times")).alias("e")).groupBy("e.keys").agg(F.sum("e.times").alias("n"))
    for row in heard.collect():  # 2 * FLAG_KEYS rows at most
        flags[row["keys"] % 2, row["keys"] // 2] = row["n"]
    p = fit_flags(flags)
    kinds = np.zeros(256)
    for row in read.where("learnt").groupBy("kind").count().collect():
        kinds[row["kind"]] = row["count"]
    kinds = np.log10((kinds + 1) / (kinds.sum() + 256)) if kinds.any() else np.zeros(256)
    out = read.mapInArrow(_finish(np.log10(np.stack([1 - p, p], axis=1)).ravel(), kinds), "id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select(
        "id", F.coalesce(_remainder(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"
    )
