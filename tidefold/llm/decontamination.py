"""Benchmark decontamination: a BM25 index of test items with block-max bounds, queried by every training passage.

The index holds pieces of items. A piece's impacts are divided by its score for itself, so one threshold fits
all. A passage (PASSAGE words, every half of it a new one) is tested in three steps, each exact in what it
drops: the sum of its rare terms' greatest impacts; the bound of each block of pieces; the scores themselves.
All pieces at or over the threshold are retrieved, and then the documents are compared with the questions and
answers of their items word run by word run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import cut

#: Item text in one index. More of it is searched by several indexes in turn, each of its own share of the items; weights come
#: from all items, so that the shares change no score.
INDEX_BYTES = 8 << 20
PIECE, PASSAGE, BLOCK = 48, 96, 16
K1, B = 1.2, 0.75
RUN = 3
#: Passages whose terms are expanded at once, which bounds memory.
AT_ONCE = 1024
RETRIEVE, QUESTION, ANSWER = 0.5, 0.5, 0.5
#: ASCII letters and digits are words, as is all beyond ASCII; the rest separates them.
FOLD = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    FOLD[_b] = _b
FOLD[65:91] = np.arange(97, 123)


def folded(texts: pa.Array) -> tx.Words:
    data, off = tx.raw(pc.utf8_lower(texts))
    return tx.words(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(FOLD[data])))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    if len(h) < n:
        return np.zeros(0, tx.U64)
    out = np.zeros(len(h) - n + 1, tx.U64)
    for j in range(n):
        out = out * tx.U64(0x9FB21C651E98DF25) + tx.mix(h[j : len(h) - n + 1 + j] + tx.U64(j + 1))
    return tx.mix(out)


def answer_start(t: str) -> int:
    """Where an item's answer begins: after a line-initial "A:" or "Answer:", or else its last sentence."""
    mark = re.search(r"(?:^|\n)[ \t]*(?:a|answer)[ \t]*:", t, re.I)
    if mark:
        return mark.end()
    ends = [m.end() for m in re.finditer(r"[.?!]\s+(?=\S)", t)]
    if ends:
        return ends[-1]
    word = re.search(r"\s\S", t[len(t) * 3 // 4 :])  # one sentence: its last quarter, from a word on
    return len(t) * 3 // 4 + word.start() if word else 0


@dataclass
class Index:
    terms: np.ndarray  #: ascending word hashes
    top: np.ndarray  #: greatest impact of a term that counts in the first step, else 0
    spare: float  #: what all other terms may add
    first: np.ndarray  #: offsets into piece and impact, by term
    piece: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  #: offsets into block and bound, by term
    block: np.ndarray
    bound: np.ndarray
    item: np.ndarray  #: of each piece
    ids: list
    question: list  #: distinct runs, by item
    answer: list
    size: list  #: words to a run, by item


def pieces(h: np.ndarray) -> list[np.ndarray]:
    """An item's words in pieces of PIECE at most."""
    return np.array_split(h, -(-len(h) // PIECE))


@dataclass
class Weights:
    """What all pieces of all items say of a term's rarity and a piece's length."""

    count: int  #: pieces
    mean: float  #: words of a piece
    holders: dict[int, int]  #: pieces that hold each term

    @staticmethod
    def of(bags: list[Counter]) -> Weights:
        return Weights(len(bags), sum(sum(b.values()) for b in bags) / max(1, len(bags)), Counter(t for b in bags for t in b))


def build(rows: list[tuple[int, str]], weights: Weights | None = None) -> Index:
    """An index of (item id, text) rows; items without words are left out. weights: of all items, if these aren't all."""
    ids, question, answer, size, item, bags = [], [], [], [], [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        t = t or ""
        at = answer_start(t)
        w = folded(pa.array([t[:at], t[at:]], pa.large_string()))
        h, q = w.hash, int(w.first[1])
        if not len(h):
            continue
        n = min(RUN, len(h))
        g = runs(h, n)
        begins = np.arange(len(g))
        ids.append(i)
        size.append(n)
        question.append(np.unique(g[begins + n <= q] if q >= n else g[:1]))
        answer.append(np.unique(g[begins + n > q]))
        for part in pieces(h):
            item.append(len(ids) - 1)
            bags.append(Counter(part.tolist()))
    all_ = weights or Weights.of(bags)
    terms = np.array(sorted({t for b in bags for t in b}), tx.U64)
    posts: dict[int, list] = {t: [] for t in terms.tolist()}
    for k, b in enumerate(bags):
        length = sum(b.values())
        raw = {t: np.log(1 + (all_.count - all_.holders[t] + 0.5) / (all_.holders[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / all_.mean)) for t, f in b.items()}
        total = sum(raw.values())
        for t, x in raw.items():
            posts[t].append((k, x / total))
    lists = [posts[t] for t in terms.tolist()]
    first = np.cumsum([0, *map(len, lists)])
    piece = np.array([k for p in lists for k, _ in p], np.int64)
    impact = np.array([x for p in lists for _, x in p])
    blocks = [sorted({k // BLOCK: max(x for j, x in p if j // BLOCK == k // BLOCK) for k, _ in p}.items()) for p in lists]
    top = np.array([max(x for _, x in p) for p in lists])
    # the terms of least impact that together stay under half the threshold decide nothing alone
    order = np.argsort(top, kind="stable")
    weak = order[: int(np.searchsorted(np.cumsum(top[order]), RETRIEVE / 2))]
    spare = float(top[weak].sum())
    top = top.copy()
    top[weak] = 0
    return Index(terms, top, spare, first, piece, impact, np.cumsum([0, *map(len, blocks)]), np.array([b for x in blocks for b, _ in x], np.int64), np.array([y for x in blocks for _, y in x]), np.array(item, np.int64), ids, question, answer, size)


def _sums(rows: np.ndarray, columns: np.ndarray, width: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sum of x) of the distinct pairs."""
    key = rows * width + columns
    order = np.argsort(key, kind="stable")
    key, x = key[order], x[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at] // width, key[at] % width, np.add.reduceat(x, at) if len(at) else x


def retrieve(w: tx.Words, ix: Index, threshold: float = RETRIEVE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, score) of every passage and piece that reach the threshold; a pair's best score."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    n = len(w.hash)
    if not n or not len(ix.terms):
        return none
    at = np.minimum(np.searchsorted(ix.terms, w.hash), len(ix.terms) - 1)
    term = np.where(ix.terms[at] == w.hash, at, -1)
    sums = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, ix.top[term], 0.0))])
    half = PASSAGE // 2
    per = np.maximum(-(-w.count // half) - 1, (w.count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(per)), per)
    start = w.first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * half
    end = np.minimum(start + PASSAGE, w.first[1:][doc])
    alive = np.flatnonzero(sums[end] - sums[start] + ix.spare >= threshold - 1e-9)
    if not len(alive):
        return none
    found = [_search(term, ix, threshold, doc[part], start[part], (end - start)[part]) for part in np.array_split(alive, -(-len(alive) // AT_ONCE))]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search(term: np.ndarray, ix: Index, threshold: float, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """retrieve's other steps for some passages of a document, a start and a length each; term: of every word, or -1."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    passage = np.repeat(np.arange(len(doc)), length)
    t = term[tx.ranges(start, length)]
    key = np.sort((passage * len(ix.terms) + t)[t >= 0])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    passage, t = key // len(ix.terms), key % len(ix.terms)
    # the same bound again, now with each term once
    alive_ = np.bincount(passage, ix.top[t], minlength=len(doc)) + ix.spare >= threshold - 1e-9
    passage, t = passage[alive_[passage]], t[alive_[passage]]

    def against(first: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, p: np.ndarray, t: np.ndarray, keep=None):
        count = first[t + 1] - first[t]
        k = tx.ranges(first[t], count)
        rows = np.repeat(p, count)
        if keep is not None:
            good = keep(rows, column[k])
            rows, k = rows[good], k[good]
        a, b, s = _sums(rows, column[k], width, value[k])
        reach = s >= threshold - 1e-9
        return a[reach], b[reach], s[reach]

    n_blocks = int(ix.block.max()) + 1
    p, block, _ = against(ix.block_first, ix.block, ix.bound, n_blocks, passage, t)
    if not len(p):
        return none
    open_ = np.unique(p * n_blocks + block)
    some = np.isin(passage, p)
    p, piece, score = against(ix.first, ix.piece, ix.impact, len(ix.item), passage[some], t[some], lambda r, c: np.isin(r * n_blocks + c // BLOCK, open_))
    return doc[p], piece, score


def leaks(texts: pa.Array, ix: Index) -> list[tuple[int, int, float, float, float]]:
    """(row, item number, best score, question overlap, answer overlap) of the confirmed leaks, by row and item."""
    w = folded(texts)
    doc, piece, score = retrieve(w, ix)
    best: dict[tuple[int, int], float] = {}
    for d, k, s in zip(doc.tolist(), ix.item[piece].tolist() if len(piece) else [], score.tolist(), strict=True):
        best[d, k] = max(best.get((d, k), 0.0), s)
    out, held = [], (-1, {})
    for (d, k), s in sorted(best.items()):
        if held[0] != d:
            held = (d, {})
        n = ix.size[k]
        if n not in held[1]:
            held[1][n] = np.unique(runs(w.hash[w.first[d] : w.first[d + 1]], n))
        shares = [float(np.isin(g, held[1][n]).mean()) if len(g) else 1.0 for g in (ix.question[k], ix.answer[k])]
        if shares[0] >= QUESTION and shares[1] >= ANSWER:
            out.append((d, k, s, *shares))
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, pieces that hold it) of each item; the term null counts the pieces, -1 pieces stand for words."""
    for batch in batches:
        for some in tx.blocks(batch, "t"):
            parts, terms, n, words = [], [], [], []
            for p, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                at = answer_start(t)
                h = folded(pa.array([t[:at], t[at:]], pa.large_string())).hash
                if not len(h):
                    continue
                bags = pieces(h)
                held, times = np.unique(np.concatenate([np.unique(b) for b in bags]), return_counts=True)
                parts += [p] * (len(held) + 1)
                terms += [*held.view(np.int64).tolist(), None]
                n += [*times.tolist(), len(bags)]
                words += [*[0] * len(held), len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(terms, pa.int64()), pa.array(n, pa.int64()), pa.array(words, pa.int64())], names=["part", "term", "n", "words"])


def indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of all items. Each holds about INDEX_BYTES of text at most, so its broadcast is bounded; more items
    make more indexes, dealt by a hash and weighted by what all of them hold."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // INDEX_BYTES)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1))).cast("int")
    if n > 1:
        counted = items.select(part.alias("part"), "t").mapInArrow(_count_terms, "part int, term long, n long, words long")
        counted = cut(counted.groupBy("part", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")
        every, words = counted.where("term is null").agg(F.sum("n"), F.sum("words")).first()
        held = cut(counted.where("term is not null").groupBy("term").agg(F.sum("n").alias("holders")), "terms")
    for k in range(n):
        weights = None
        if n > 1:  # the terms of one part, as few as its text has
            own = counted.where((F.col("part") == k) & F.col("term").isNotNull()).join(held, "term").select("term", "holders").collect()
            weights = Weights(every, words / every, {r[0] % (1 << 64): r[1] for r in own})
        yield build([tuple(r) for r in items.where(part == k).collect()], weights)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) of every document and item it leaks; no shuffle.

    Words are runs of letters and digits, in lower case. A leak is retrieved by BM25 at RETRIEVE of the score
    that a piece has for itself, and confirmed if the document holds QUESTION of the question's and ANSWER of the
    answer's distinct RUN-word runs (an item of fewer words: the whole). Clean documents give no row. Null or
    empty text on either side leaks nothing; null ids are returned as they are; repeated rows give repeated rows. Ids are
    numbers.
    Other columns are ignored. No items: no rows.
    """
    schema = "id long, item_id long, score double, question_overlap double, answer_overlap double"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None

    def finder(ix: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.blocks(batch):
                    found = leaks(part.column(1), ix)
                    if found:
                        cols = list(zip(*found, strict=True))
                        ids = part.column(0).take(pa.array(cols[0]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([ix.ids[k] for k in cols[1]], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=[c.split()[0] for c in schema.split(", ")])

        return run

    for ix in indexes(benchmark, item_id, item_text):
        more = src.mapInArrow(finder(ix), schema)
        out = more if out is None else out.unionByName(more)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with all their columns; no shuffle and no join. Null and empty texts leak nothing and
    stay, and so do rows of null id without a leak; repeated rows stay or go together. No items: all rows stay."""

    def cleaner(ix: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.blocks(batch, text_col):
                    bad = {row for row, *_ in leaks(part.column(part.schema.get_field_index(text_col)), ix)}
                    yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_())) if bad else part

        return run

    for ix in indexes(benchmark, item_id, item_text):
        docs = docs.mapInArrow(cleaner(ix), docs.schema)
    return docs
