"""Near-duplicate documents by min-max hashing.

Each permutation keeps both its minimum and its maximum over a document's shingle set, so a signature of
`2 * permutations` values costs half the hash evaluations; bands are runs of those values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .scratch import cut, drop

#: 24 bands of 4 values (minimum and maximum under 2 permutations). A pair at similarity 0.85 shares no band
#: with probability (1 - 0.85**4)**24 < 3e-8; at 0.8, 3e-6.
BANDS, PERMS_PER_BAND = 24, 2
#: Buckets of at most so many texts are paired in full, larger ones through a hub first.
SMALL = 8
#: Texts of a large bucket compared in one task at most; more are dealt out as pairs of blocks.
GROUP = 600
_rng = np.random.Generator(np.random.PCG64(7))
MULT = _rng.integers(0, 2**32, BANDS * PERMS_PER_BAND, dtype=np.uint32) | np.uint32(1)
FLIP = _rng.integers(0, 2**32, BANDS * PERMS_PER_BAND, dtype=np.uint32)


def signatures(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Band hashes (documents x BANDS) of shingle sets as set_keys() gives them; rows of empty sets mean nothing."""
    out = np.zeros((len(size), BANDS), tx.U64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    first = (np.cumsum(size) - size)[full]
    x = (key >> tx.U64(20)).astype(np.uint32)
    for band in range(BANDS):
        h = np.full(len(full), band + 1, tx.U64)
        for k in range(band * PERMS_PER_BAND, (band + 1) * PERMS_PER_BAND):
            y = (x ^ FLIP[k]) * MULT[k]
            low, high = np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
            h = tx.mix(h + (low.astype(tx.U64) | (high.astype(tx.U64) << tx.U64(32))))
        out[full, band] = h
    return out


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch):
                w = tx.words(part.column(1), lower=True)
                key, size = tx.set_keys(w, shingle)
                bands = signatures(key, size).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(tx.fold(w, 1).view(np.int64)), pa.array(tx.fold(w, 2).view(np.int64)), pa.array(size, pa.int64()), lists],
                    names=["id", "k1", "k2", "n", "bands"],
                )

    return run


def _linked(inter, na, nb, percent: int):
    return 100 * inter >= percent * (na + nb - inter)


def _verify(shingle: int, percent: int):
    """Keep the rows (a, b, ta, tb) whose full shingle sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer in tx.blocks(batch, "ta"):
                for part in tx.blocks(outer, "tb"):
                    ka, na = tx.set_keys(tx.words(part.column(2), lower=True), shingle)
                    kb, nb = tx.set_keys(tx.words(part.column(3), lower=True), shingle)
                    both = np.intersect1d(ka, kb, assume_unique=True)
                    inter = np.bincount((both >> tx.SET_BITS).astype(np.int64), minlength=part.num_rows)
                    good = pa.array(_linked(inter, na, nb, percent) & (na > 0) & (nb > 0))
                    yield part.select(["a", "b"]).filter(good)

    return run


def _group_links(shingle: int, percent: int):
    """Links between different components in a block of a large bucket: all pairs by matrix products, exact."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
        keys, sizes = [], []
        for batch in table.select(["text"]).to_batches():
            for part in tx.blocks(batch):
                key, n = tx.set_keys(tx.words(part.column(0), lower=True), shingle)
                keys.append((key & tx.SET_MASK, n))
        size = np.concatenate([n for _, n in keys])
        value, inverse = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        row = np.repeat(np.arange(len(size)), size)
        frequency = np.bincount(inverse)
        column = np.cumsum(frequency > 1) - 1
        keep = frequency[inverse] > 1  # the others are in no intersection
        row, col = row[keep], column[inverse[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        n = len(size)
        inter = np.zeros((n, n), np.float32)
        width = 2048
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            lo, hi = np.searchsorted(col, [at, at + width])
            rows, local = np.unique(row[lo:hi], return_inverse=True)
            m = np.zeros((len(rows), width), np.float32)
            m[local, col[lo:hi] - at] = 1
            inter[np.ix_(rows, rows)] += m @ m.T
        a, b = np.nonzero(np.triu(_linked(inter, size[:, None].astype(np.float32), size[None, :].astype(np.float32), percent), 1))
        differ = (comp[a] != comp[b]) & ((side.max() == side.min()) | (side[a] != side[b]))
        a, b = a[differ], b[differ]
        _, once = np.unique(np.stack([comp[a], comp[b]]), axis=1, return_index=True)
        return pa.table({"a": ids[a[once]], "b": ids[b[once]]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Words are lower-cased (A-Z). Two documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of distinct `shingle`-word runs; candidates come from min-max bands, links are confirmed on the
    full sets, and component_id is the least id reachable. Texts of one word sequence are one node from the
    start. In a bucket of more than SMALL texts all are compared with its hub, the text that most and largest
    buckets hold; where that leaves several components, all pairs between them are compared in blocks, so no
    link within a bucket is lost and none is drawn twice between copies.

    Null or empty text: n_shingles 0, its own component. Null id: its row is returned with component_id null
    and kept true, and links nothing. Rows that repeat an id are one document. No rows: none. Other
    columns are ignored. Ids are numbers.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = cut(src.mapInArrow(_features(shingle), "id long, k1 long, k2 long, n long, bands array<long>"), "marks")
    solid = marks.where("id is not null and n > 0")
    classes = cut(solid.groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "bands")).alias("r")).select("k1", "k2", "r.*"), "classes")
    rows = classes.select("id", "n", F.explode("bands").alias("bucket"))
    # what is counted or chosen by bucket is written before rows are joined with it: such a join stands alone in its stage, and a
    # hot bucket can be split there
    sizes = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sizes")
    rows = cut(rows.join(sizes, "bucket"), "buckets")
    drop(sizes)

    small = rows.where(F.col("members") <= SMALL).select("bucket", "id", "n")
    other = small.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"))
    alike = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent
    pairs = small.join(other, "bucket").where((F.col("id") < F.col("b")) & alike).select(F.col("id").alias("a"), "b")
    large = rows.where(F.col("members") > SMALL)
    weight = large.groupBy("id").agg(F.sum("members").alias("weight"))
    hubs = cut(large.join(weight, "id").groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "id", "n")).alias("h")), "hubs")
    stars = large.join(hubs, "bucket").select("id", "n", F.col("h.id").alias("b"), F.col("h.n").alias("nb")).where((F.col("id") != F.col("b")) & alike)
    pairs = pairs.unionByName(stars.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))).distinct()

    texts = src.where("id is not null")
    dealt = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    links = cut(dealt.select("a", "b", "ta", "tb").mapInArrow(_verify(shingle, percent), "a long, b long"), "links")

    found = components(links)
    held = large.join(found, "id", "left").select("bucket", "id", "members", F.coalesce("component", "id").alias("component"))
    open_ = cut(held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"), "open")
    rest = held.join(open_, "bucket").withColumn("of", F.ceil(F.col("members") / GROUP)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")))
    # blocks i <= j of one bucket meet in task (i, j)
    rest = rest.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    rest = rest.select("bucket", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), F.col("own").alias("side"), "id", "component")
    rest = rest.join(texts, "id")
    more = cut(rest.groupBy("bucket", "i", "j").applyInArrow(_group_links(shingle, percent), "a long, b long"), "links")
    if more.isEmpty():
        whole = found
    else:
        whole = components(links.unionByName(more))

    # id -> least id of its class -> component
    labels = classes.select("k1", "k2", F.col("id").alias("rep")).join(whole.withColumnRenamed("id", "rep"), "rep", "left")
    labels = labels.select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = marks.join(labels, ["k1", "k2"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id")
    )
    drop(rows)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns: one document of each group, and rows of null id. Null and
    empty texts stay, each being a group; rows that repeat the id that stays, stay. No rows: none."""
    found = near_duplicates(docs, id_col, text_col, shingle, percent)
    kept = cut(found.where("kept and id is not null").select("id").distinct(), "kept")
    name = "id"
    while name in docs.columns:  # no name of docs' own
        name += "_"
    kept = kept.withColumnRenamed("id", name)
    solid = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col).cast("long") == F.col(name), "left_semi")
    return solid.unionByName(docs.where(F.col(id_col).isNull()))
