"""Incremental removal of repeated word windows with a log-structured index of fingerprints.

The index is a folder: immutable runs of fingerprints sorted by hash, the blocks of text that they come from, and a
manifest that names both. A window's fingerprint is the least hash of the `GRAM`-word runs inside it, so equal windows
have equal fingerprints and a fingerprint is stored about every fourth word only. A new batch is written as blocks,
its fingerprints are merged with the buckets of the runs that it touches, and those that two documents hold lead to
the windows to verify: their 128-bit hashes are compared over the blocks that hold them, historical ones included. The
batch's own fingerprints then become a run. MOST_RUNS runs of one level are merged into one of the next and deleted, so
an entry is rewritten as often as the index grows by that factor; merged buckets that have grown too large are split.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from ..sources.files import Files
from .exchange import BLOCK_SCHEMA, BUCKET_ENTRIES, PLACE_BITS, TASK_BITS, answers, of_blocks, send, squeeze, stretch, write_blocks
from .scratch import cut, new_path

#: Runs of a level before they are merged into one of the next.
MOST_RUNS = 4
RUN_SCHEMA = "bucket int, h binary, owners binary, blocks array<long>"
BATCH_BITS = TASK_BITS + PLACE_BITS
#: Entries to a byte of text, about.
DENSITY = 0.045


def _gram(window: int) -> int:
    return max(1, window // 2)


def _prefix_hash(h: np.ndarray, at: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of the n words from each position."""
    p, inv = tx.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, tx.U64)
    np.cumsum(tx.mix(h + tx.U64(salt)) * p[:-1], out=sums[1:])
    return tx.mix((sums[at + n] - sums[at]) * inv[at])


def _windows(texts: pa.Array, window: int) -> tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each window, its document, its fingerprint with the lowest bit clear)."""
    w = tx.words(texts)
    n, gram = len(w.hash), _gram(window)
    last = np.repeat(w.first[1:], w.count)
    at = np.flatnonzero(np.arange(n) + window <= last)
    if not len(at):
        return w, at, at, np.zeros(0, tx.U64)
    low = _prefix_hash(w.hash, np.arange(n - gram + 1), gram, 3)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return w, at, w.doc[at], low[at] & ~tx.U64(1)


def _fingerprints(window: int, block: int, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Distinct fingerprints of a block, with bit 0 set where two of its documents hold one."""
    _, _, doc, low = _windows(batch.column(1), window)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    known = ~np.asarray(batch.column(0).is_null())[doc]
    doc, low = doc[known], low[known]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    doc, low = doc[new], low[new]
    order = np.argsort(low, kind="stable")
    doc, low = doc[order], low[order]
    bounds = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]])) if len(low) else np.zeros(1, np.int64)
    many = ids[doc[bounds[:-1]]] != ids[doc[bounds[1:] - 1]]
    return (low[bounds[:-1]] | many.astype(tx.U64),)


def _entries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with their mark, owner of each as a place in names, names) of rows of a run, or of what blocks sent."""
    hashes, owner, blocks = [], [], []
    for row in rows:
        h = stretch(row["h"], tx.U64)
        own, names = (np.zeros(len(h), np.int64), [row["block"]]) if row["blocks"] is None else (stretch(row["owners"], np.uint32).astype(np.int64), row["blocks"])
        hashes.append(h)
        owner.append(own + len(blocks))
        blocks += names
    names, dense = np.unique(np.array(blocks, np.int64), return_inverse=True)
    return np.concatenate(hashes), dense[np.concatenate(owner)], names


def _run_row(bucket: int, h: np.ndarray, own: np.ndarray, names: np.ndarray) -> dict:
    used, dense = np.unique(own, return_inverse=True)
    return {"bucket": bucket, "h": squeeze(h), "owners": squeeze(dense.astype(np.uint32)), "blocks": names[used].tolist()}


def _sorted(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((own, h >> tx.U64(1)))
    return h[order], own[order]


MERGED = "kind int, " + RUN_SCHEMA + ", block long, hits binary"
_MERGED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("h", pa.binary()), ("owners", pa.binary()), ("blocks", pa.list_(pa.int64())), ("block", pa.int64()), ("hits", pa.binary())])


def _merge(table: pa.Table) -> pa.Table:
    """One bucket: the batch's fingerprints and those of the runs. Kind 0: what two documents hold, the batch among them, to every
    block that holds it; kind 1: the batch's own as a run."""
    rows = table.to_pylist()
    rows.sort(key=lambda r: (r["block"] is None, r["block"] or 0, r["blocks"] or []))
    bucket, fresh = rows[0]["bucket"], sum(r["block"] is not None for r in rows)
    if not fresh:
        return _MERGED.empty_table()
    h, own, names = _entries(rows)
    new = np.arange(len(h)) < sum(len(stretch(r["h"], tx.U64)) for r in rows[:fresh])
    mine = _sorted(h[new], own[new])
    out = [{"kind": 1, **_run_row(bucket, *mine, names)}]
    order = np.lexsort((own, h >> tx.U64(1)))
    h, own, new = h[order], own[order], new[order]
    key = h >> tx.U64(1)
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    count = np.diff(bounds)
    hot = (count > 1) | (np.maximum.reduceat(h & tx.U64(1), bounds[:-1]) > 0)
    hot = np.repeat(hot & np.logical_or.reduceat(new, bounds[:-1]), count)
    by, value = own[hot], h[hot] & ~tx.U64(1)
    order = np.argsort(by, kind="stable")
    by, value = by[order], value[order]
    edges = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1], [True]])) if len(by) else np.zeros(1, np.int64)
    out += [{"kind": 0, "block": int(names[by[a]]), "hits": squeeze(value[a:b])} for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.Table.from_pylist(out, _MERGED)


def _finer(by: int, batches):
    """Rows of a run dealt anew, by `by` leading bits."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            h, own, names = _entries([row])
            part = (h >> tx.U64(64 - by)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            out += [_run_row(int(part[a]), h[a:b], own[a:b], names) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("owners", pa.binary()), ("blocks", pa.list_(pa.int64()))]))


def _compact(table: pa.Table) -> pa.Table:
    """One bucket of several runs as one row."""
    rows = table.to_pylist()
    rows.sort(key=lambda r: r["blocks"])
    h, own, names = _entries(rows)
    return pa.Table.from_pylist([_run_row(rows[0]["bucket"], *_sorted(h, own), names)], pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("owners", pa.binary()), ("blocks", pa.list_(pa.int64()))]))


def _joined(blobs: list | None) -> np.ndarray:
    return np.unique(np.concatenate([stretch(b, tx.U64) for b in blobs])) if blobs else np.zeros(0, tx.U64)


def _member(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)
    return ascending[at] == x


def _candidates(window: int, batch: pa.RecordBatch, hits: list | None):
    """(words, first word, row, two hashes) of the windows whose fingerprint is shared."""
    w, at, doc, low = _windows(batch.column(1), window)
    some = _member(low, _joined(hits)) & ~np.asarray(batch.column(0).is_null())[doc]
    at, doc = at[some], doc[some]
    return w, at, doc, _prefix_hash(w.hash, at, window, 11), _prefix_hash(w.hash, at, window, 12)


def _claims(window: int, block: int, batch: pa.RecordBatch, hits: list | None, old: bool) -> tuple[np.ndarray, ...]:
    """Distinct shared windows of a block and the least id that holds each; a historical block precedes all ids."""
    _, _, doc, a, b = _candidates(window, batch, hits)
    ids = batch.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64)
    order = np.lexsort((b, a))  # stable: of equal ones the least id comes first
    a, b, ids = a[order], b[order], ids[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    ids = ids[first]
    return a[first], b[first], np.full(len(ids), np.iinfo(np.int64).min) if old else ids


def _judge(table: pa.Table) -> pa.Table:
    """One bucket of claims: each block learns which of its windows a smaller id outside it holds."""
    rows = table.select(["block", "h", "p0", "p1"]).to_pylist()
    a = np.concatenate([stretch(r["h"], tx.U64) for r in rows])
    b = np.concatenate([stretch(r["p0"], tx.U64) for r in rows])
    ids = np.concatenate([stretch(r["p1"], np.int64) for r in rows])
    own = np.repeat(np.arange(len(rows)), [len(stretch(r["h"], tx.U64)) for r in rows])
    order = np.lexsort((b, a))
    a, b, ids, own = a[order], b[order], ids[order], own[order]
    bounds = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
    least = np.repeat(np.minimum.reduceat(ids, bounds[:-1]), np.diff(bounds))
    lost = np.flatnonzero(least < ids)
    lost = lost[np.argsort(own[lost], kind="stable")]
    edges = np.searchsorted(own[lost], np.arange(len(rows) + 1))
    out = [{"block": r["block"], "taken": squeeze(a[x]), "taken2": squeeze(b[x])} for k, r in enumerate(rows) if len(x := lost[edges[k] : edges[k + 1]])]
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("taken", pa.binary()), ("taken2", pa.binary())]))


def _strip(window: int, texts: bool, batch: pa.RecordBatch, hits: list | None, taken: list | None) -> pa.RecordBatch:
    closed = pc.binary_join_element_wise(batch.column(1), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    batch = batch.set_column(1, "text", closed)  # white space now follows every word within its document
    w, at, doc, a, b = _candidates(window, batch, hits)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    covered = np.zeros(len(w.hash) + 1, np.int32)
    if len(at):
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        head = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
        least = ids[doc[order]][head][np.cumsum(head) - 1]
        gone = np.zeros(len(at), bool)
        gone[order] = ids[doc[order]] > least
        if taken:
            ta = np.concatenate([stretch(t["taken"], tx.U64) for t in taken])
            tb = np.concatenate([stretch(t["taken2"], tx.U64) for t in taken])
            up = np.argsort(ta, kind="stable")
            ta, tb = ta[up], tb[up]
            k = np.minimum(np.searchsorted(ta, a), len(ta) - 1)
            gone |= (ta[k] == a) & (tb[k] == b)
        at = at[gone]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    keep = np.cumsum(covered[:-1]) == 0
    removed = np.bincount(w.doc[~keep], minlength=batch.num_rows)
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start[keep]] += 1
    edge[w.end[keep] + 1] -= 1
    data = w.data.copy()
    data[w.end] = 32
    kept = data[np.cumsum(edge[:-1]) > 0].tobytes()
    size = np.bincount(w.doc[keep], weights=(w.end - w.start + 1)[keep], minlength=batch.num_rows).astype(np.int64)
    ends = np.cumsum(size)
    views = [kept[e - s : max(e - s, e - 1)] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
    cols = {"id": batch.column(0), "n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(v).hexdigest() for v in views])}
    if texts:
        cols["kept_text"] = pa.array([v.decode() for v in views], pa.string())
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


@dataclass(frozen=True)
class Run:
    path: str
    level: int
    bits: int  #: leading bits of a hash that name its bucket
    entries: int


@dataclass
class Manifest:
    """What an index holds; a new one replaces the last when all that it names is written."""

    window: int
    batches: int = 0
    version: int = 0  #: a file's name
    runs: tuple[Run, ...] = ()
    blocks: tuple[tuple[int, str], ...] = ()  #: (batch, folder)


class FingerprintIndex:
    """Runs and blocks of what has been seen. Batches are added in turn; earlier ones take precedence.

    path: the index's folder, which all executors share. An index that is there is opened as its last manifest says. Without a
    path it lives in a new folder of the shared ones. One writer at a time; a batch whose add() failed can be added again.
    """

    def __init__(self, spark: SparkSession, window: int = 13, path: str | None = None):
        self.spark, self.files = spark, Files(spark)
        self.path = (path or new_path(spark, "index")).rstrip("/")
        known = [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        self.held = Manifest(window)
        if known:
            m = json.loads(self.files.read(f"{self.path}/manifest/{max(known)}"))
            self.held = Manifest(m["window"], m["batches"], m["version"], tuple(Run(**r) for r in m["runs"]), tuple((b, p) for b, p in m["blocks"]))
            if self.held.window != window:
                raise ValueError(f"the index is of windows of {self.held.window} words")

    def _commit(self, new: Manifest) -> None:
        new.version = self.held.version + 1
        text = json.dumps({"window": new.window, "batches": new.batches, "version": new.version, "runs": [asdict(r) for r in new.runs], "blocks": new.blocks})
        self.files.write(f"{self.path}/manifest/{new.version:012d}.json", text)
        gone = {r.path for r in self.held.runs} - {r.path for r in new.runs}
        self.held = new
        for p in gone:
            self.files.delete(p)
        for old in [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")][:-2]:
            self.files.delete(f"{self.path}/manifest/{old}")

    def _rows(self, run: Run, bits: int) -> DataFrame:
        """A run's rows by buckets of `bits`."""
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(run.path)
        return rows if run.bits == bits else rows.mapInArrow(partial(_finer, bits), RUN_SCHEMA)

    def _touched(self, run: Run, asked: DataFrame, bits: int) -> DataFrame:
        """The rows of a run that share a bucket with the batch. asked: the batch's (bucket) by `bits`, distinct."""
        wide = min(bits, run.bits)
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(run.path)
        own = asked.select(F.shiftright("bucket", bits - wide).alias("asked")).distinct()
        rows = rows.join(own, F.shiftright("bucket", run.bits - wide) == F.col("asked"), "left_semi")
        return rows if run.bits == bits else rows.mapInArrow(partial(_finer, bits), RUN_SCHEMA)

    def _text(self, hits: DataFrame, number: int) -> DataFrame | None:
        """The historical blocks that hold hits: only folders of their batches are read."""
        found = {r[0] for r in hits.where(F.col("block") < number << BATCH_BITS).select(F.shiftright("block", BATCH_BITS).alias("b")).distinct().collect()}
        paths = [p for b, p in self.held.blocks if b in found]
        if not paths:
            return None
        return self.spark.read.schema(BLOCK_SCHEMA).parquet(*paths).join(hits.select("block"), "block", "left_semi")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
        """(id, n_words, n_removed, kept_sha256[, kept_text]) for every row of docs, which joins the index.

        A window is `window` consecutive words (unchanged) of one document. Each word covered by a window that
        also starts in an earlier document is removed; earlier is a former batch, or a smaller id in this one.
        Windows are judged on the input. Null text: no words. Null id: its row is returned unchanged and nothing
        is judged by it. Rows that repeat an id do not remove each other's words. Other columns are ignored. Ids are numbers.
        No rows: none. The result is to be read or written before the next batch is added.
        """
        window, number = self.held.window, self.held.batches
        src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        if number:  # what the last batch's result was read from
            self.files.delete(f"{self.path}/merged/{number - 1}/kind=0")
            self.files.delete(f"{self.path}/tmp/{number - 1}")
        blocks, tmp = f"{self.path}/blocks/{number}", f"{self.path}/tmp/{number}"
        new = write_blocks(src, {"id": "long", "text": "string"}, path=blocks, number=number)
        n_bytes = new.agg(F.sum("n_bytes")).first()[0] or 0
        entries = int(n_bytes * DENSITY) + sum(r.entries for r in self.held.runs)
        bits = min(30, max(6, (entries // BUCKET_ENTRIES).bit_length(), *(r.bits for r in self.held.runs)))

        sent = send(new, partial(_fingerprints, window), bits, 0)
        if self.held.runs:  # the batch's buckets are asked of the runs, and then merged
            sent = cut(sent, "sent", path=f"{tmp}/sent")
        both = sent.select("bucket", "h", F.lit(None).cast("binary").alias("owners"), F.lit(None).cast("array<long>").alias("blocks"), "block")
        asked = sent.select("bucket").distinct()
        for run in self.held.runs:
            both = both.unionByName(self._touched(run, asked, bits).withColumn("block", F.lit(None).cast("long")))
        merged = cut(both.groupBy("bucket").applyInArrow(_merge, MERGED), "merged", "kind", f"{self.path}/merged/{number}")
        hits = answers(merged.where("kind = 0"), "hits")
        everything = new.withColumn("old", F.lit(False))
        old = self._text(hits, number) if self.held.runs else None
        if old is not None:
            everything = everything.unionByName(old.withColumn("old", F.lit(True)))
        held = everything.join(hits, "block")
        claims = send(held, partial(_claims, window), bits, 2, ("hits", "old"))
        judged = cut(claims.groupBy("bucket").applyInArrow(_judge, "block long, taken binary, taken2 binary"), "judged", path=f"{tmp}/judged")
        taken = judged.groupBy("block").agg(F.collect_list(F.struct("taken", "taken2")).alias("taken"))
        ready = new.join(hits, "block", "left").join(taken, "block", "left")
        schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
        out = of_blocks(ready, partial(_strip, window, texts), schema, ("hits", "taken"))
        self._remember(blocks, bits, int(n_bytes * DENSITY))
        return out

    def _remember(self, blocks: str, bits: int, entries: int) -> None:
        """The batch becomes a run of level 0, and full levels are merged."""
        number = self.held.batches
        run = Run(f"{self.path}/merged/{number}/kind=1", 0, bits, entries)
        runs = (*self.held.runs, run) if self.files.exists(run.path) else self.held.runs
        self._commit(Manifest(self.held.window, number + 1, runs=runs, blocks=(*self.held.blocks, (number, blocks))))
        level = 0
        while len(full := [r for r in self.held.runs if r.level == level]) >= MOST_RUNS:
            path, total = f"{self.path}/run/{number}-{level + 1}", sum(r.entries for r in full)
            finer = min(30, max(*(r.bits for r in full), (total // BUCKET_ENTRIES).bit_length()))
            rows = None
            for r in full:
                more = self._rows(r, finer)
                rows = more if rows is None else rows.unionByName(more)
            rows.groupBy("bucket").applyInArrow(_compact, RUN_SCHEMA).write.mode("overwrite").parquet(path)
            left = tuple(r for r in self.held.runs if r not in full)
            self._commit(Manifest(self.held.window, self.held.batches, runs=(*left, Run(path, level + 1, finer, total)), blocks=self.held.blocks))
            level += 1


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """FingerprintIndex.add of one batch to an empty index."""
    return FingerprintIndex(docs.sparkSession, window).add(docs, id_col, text_col, texts)
