"""Token ids in files: Re-Pair grammar compression per shard, with random access to documents.

A shard is one row of a Parquet table: its documents' ids, the grammar's rules, each rule's expansion
length, the sequence of terminals and nonterminals, and how many symbols each document has. No rule
crosses the end id, so a document is a run of whole symbols and is decoded without its neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .bpe import default_vocabulary, encoder
from .scratch import new_path

#: Ids to a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
#: A rule costs 12 bytes and saves 3 for each occurrence, so it is made from so many on.
LEAST_COUNT = 6
TERMINALS = 1 << 20
#: Stands for a document's end in a sequence, as the end id may occur inside a text too.
STOP = TERMINALS - 1
SCHEMA = "part int, shard int, end_id int, n_ids long, doc_ids array<long>, doc_symbols array<int>, rules binary, rule_lengths binary, low binary, high binary"
_TAG_BITS = 17


def _lengths_of(s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(s), np.int64)
    nt = s >= TERMINALS
    out[nt] = lengths[s[nt].astype(np.int64) - TERMINALS]
    return out


def _tag(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint32(0x9E3779B1)
    x ^= right * np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE3D)
    return x >> np.uint32(32 - _TAG_BITS)


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules as pairs of symbols, expansion lengths). Symbol TERMINALS + k stands for rule k.

    Each round counts adjacent pairs, makes rules of those at least a tenth as frequent as the most frequent one, and
    replaces their occurrences left to right; where they overlap, every other one of the run is taken. It ends when no
    pair comes LEAST_COUNT times. Of a later round only pairs can come so often that hold a symbol of the round before, or
    that came so often then: the others are not counted again.
    """
    s = ids.astype(np.uint32)
    rules = np.zeros((0, 2), np.uint32)
    lengths = np.zeros(0, np.uint32)
    often = np.ones(1 << _TAG_BITS, bool)  # by tag: whether a pair may come often without a new symbol
    newest = TERMINALS
    while len(s) > 1:
        stop, new = s == STOP, s >= newest
        tag = _tag(s[:-1], s[1:])
        live = np.flatnonzero((often.take(tag) | new[:-1] | new[1:]) & ~(stop[:-1] | stop[1:]))
        key = (s[live].astype(tx.U64) << tx.U64(32)) | s[live + 1]
        ordered = np.sort(key)
        if not len(ordered):
            break
        bounds = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
        count = np.diff(bounds)
        many = np.flatnonzero(count >= LEAST_COUNT)
        if not len(many):
            break
        pairs, count = ordered[bounds[many]], count[many]
        tags = _tag((pairs >> tx.U64(32)).astype(np.uint32), (pairs & tx.U64(0xFFFFFFFF)).astype(np.uint32))
        often[:] = False
        often[tags] = True
        top = np.flatnonzero(count >= count.max() // 10)
        pairs, tags = pairs[top], tags[top]
        table = np.full(1 << _TAG_BITS, -1, np.int32)
        table[tags] = np.arange(len(pairs), dtype=np.int32)
        own = table[tags] == np.arange(len(pairs))  # others that share a tag wait for another round
        pairs = pairs[own]
        table[tags[own]] = np.arange(len(pairs), dtype=np.int32)
        rule = table.take(tag[live])
        hit = np.flatnonzero(rule >= 0)
        hit = hit[pairs[rule[hit]] == key[hit]]
        at, rule = live[hit], rule[hit]
        head = np.concatenate([[True], np.diff(at) != 1])
        run = at[head][np.cumsum(head) - 1]
        even = (at - run) % 2 == 0
        at, newest = at[even], TERMINALS + len(rules)
        s[at] = newest + rule[even]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        made = np.stack([pairs >> tx.U64(32), pairs & tx.U64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        lengths = np.concatenate([lengths, (_lengths_of(made[:, 0], lengths) + _lengths_of(made[:, 1], lengths)).astype(np.uint32)])
        rules = np.concatenate([rules, made])
    return s, rules, lengths


def needed(s: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same sequence with those rules only that its expansion takes."""
    held, more = np.zeros(len(rules), bool), np.unique(s[s >= TERMINALS] - np.uint32(TERMINALS))
    while len(more):
        held[more] = True
        below = rules[more].ravel()
        more = np.unique(below[below >= TERMINALS] - np.uint32(TERMINALS))
        more = more[~held[more]]
    place = (np.cumsum(held) - 1 + TERMINALS).astype(np.uint32)

    def renamed(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        out[x >= TERMINALS] = place[x[x >= TERMINALS] - TERMINALS]
        return out

    return renamed(s), renamed(rules[held]), lengths[held]


def expand(s: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of a sequence, or of any slice of one."""
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    pool = np.zeros(int(lengths.sum()), np.uint32)
    done = 0
    while done < len(rules):
        # rules of one round refer to earlier rounds only: all up to the first that needs a later one
        need = np.where(rules[done:] >= TERMINALS, rules[done:].astype(np.int64) - TERMINALS, -1).max(axis=1)
        to = done + int(np.argmax(need >= done)) if (need >= done).any() else len(rules)
        left, right = (rules[done:to, k].astype(np.int64) for k in (0, 1))
        place = start[done:to].copy()
        for side in (left, right):
            long_ = side >= TERMINALS
            pool[place[~long_]] = side[~long_]
            ref = side[long_] - TERMINALS
            pool[tx.ranges(place[long_], lengths[ref].astype(np.int64))] = pool[tx.ranges(start[ref], lengths[ref].astype(np.int64))]
            place = place + np.where(long_, lengths[np.where(long_, side - TERMINALS, 0)], 1)
        done = to
    out_len = _lengths_of(s, lengths)
    nt = s >= TERMINALS
    ref = s[nt].astype(np.int64) - TERMINALS
    out = np.zeros(int(out_len.sum()), np.uint32)
    place = np.cumsum(out_len) - out_len
    out[place[~nt]] = s[~nt]
    out[tx.ranges(place[nt], out_len[nt])] = pool[tx.ranges(start[ref], lengths[ref].astype(np.int64))]
    return out


def _shard_row(part: int, shard: int, doc_ids: list, ids: np.ndarray, end: int) -> pa.RecordBatch:
    s, rules, lengths = compress(ids)
    stops = np.flatnonzero(s == STOP)
    cols = [
        pa.array([part], pa.int32()),
        pa.array([shard], pa.int32()),
        pa.array([end], pa.int32()),
        pa.array([len(ids)], pa.int64()),
        pa.array([doc_ids], pa.list_(pa.int64())),
        pa.array([np.diff(stops, prepend=-1)], pa.list_(pa.int32())),
        *(pa.array([x.tobytes()], pa.binary()) for x in (rules, lengths, (s & np.uint32(0xFFFF)).astype("<u2"), (s >> np.uint32(16)).astype(np.uint8))),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


def _encode(path: str, end: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, shard = encoder(path, special_as_text), TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for block in tx.blocks(batch, limit=1 << 20):
                ids, count = enc.encode(block.column(1))
                out = np.full(len(ids) + len(count), STOP, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                docs += block.column(0).to_pylist()
                held.append(out)
                size += len(out)
                if size >= SHARD_IDS:
                    yield _shard_row(part, shard, docs, np.concatenate(held), end)
                    docs, held, size, shard = [], [], 0, shard + 1
        if docs:
            yield _shard_row(part, shard, docs, np.concatenate(held), end)

    return run


def decode_row(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the shard, ids of each document), from a row as a dict of Python and bytes values."""
    s = np.frombuffer(row["low"], "<u2").astype(np.uint32) | (np.frombuffer(row["high"], np.uint8).astype(np.uint32) << np.uint32(16))
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    lengths = np.frombuffer(row["rule_lengths"], np.uint32)
    sums = np.concatenate([[0], np.cumsum(_lengths_of(s, lengths))])
    stops = np.concatenate([[0], np.cumsum(row["doc_symbols"])]).astype(np.int64)
    ids = expand(s, rules, lengths)
    ids[ids == STOP] = row["end_id"]
    return ids, np.diff(sums[stops])


def document_ids(row: dict, k: int) -> np.ndarray:
    """The ids of document k of a shard alone: random access, by the rules that it takes and no others."""
    a = int(np.sum(row["doc_symbols"][:k]))
    b = a + int(row["doc_symbols"][k])
    s = np.frombuffer(row["low"][2 * a : 2 * b], "<u2").astype(np.uint32) | (np.frombuffer(row["high"][a:b], np.uint8).astype(np.uint32) << np.uint32(16))
    ids = expand(*needed(s, np.frombuffer(row["rules"], np.uint32).reshape(-1, 2), np.frombuffer(row["rule_lengths"], np.uint32)))
    ids[ids == STOP] = row["end_id"]
    return ids


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, count = decode_row(row)
            data, to = memoryview(ids.astype("<u4").tobytes()), np.cumsum(count)
            crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(to.tolist(), count.tolist(), strict=True)]
            n = len(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in (([row["part"]] * n, pa.int32()), ([row["shard"]] * n, pa.int32()), (row["doc_ids"], pa.int64()), (to - count, pa.int64()), (count, pa.int64()), (crc, pa.int64()))],
                names=["part", "shard", "id", "off", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 0, special_as_text: bool = False) -> None:
    """Encode every text, append `end`, and write shards in ascending id order to `path`.

    Null or empty text: the end id alone. Null ids come first; rows that repeat an id follow each other in
    order of text. The end id inside a text ends nothing. Other columns are ignored. Special tokens' strings become special ids unless special_as_text.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = src.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    dealt.mapInArrow(_encode(vocabulary or default_vocabulary(), end, special_as_text), SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in files that write_tokens wrote, decoded from them."""
    table = spark.read.schema(SCHEMA).parquet(path)
    total = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    shards = table.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("before"))
    place = shards.join(base, "part").select("part", "shard", (F.col("before") + F.col("base")).alias("at"))
    docs = table.mapInArrow(_digest, "part int, shard int, id long, off long, n_tokens long, ids_crc32 long")
    return docs.join(place, ["part", "shard"]).select(F.col("id").alias("doc_id"), (F.col("at") + F.col("off")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """write_tokens then read_tokens; without a path the files go to the shared folder. Null and empty texts are the end id
    alone; null ids come first; repeated rows are encoded each; no rows give none. Ids are numbers."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
