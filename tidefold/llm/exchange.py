"""Blocks of documents, and packed hashes that travel between blocks and buckets.

An operator that must know something of every hash of a corpus first writes the corpus as blocks: rows of some
megabytes of text each. A block sends each of its distinct hashes once to the bucket of the hash's leading
bits, and a bucket answers per block. So a hash that a third of all documents hold costs its bucket one entry
per block, never one per document, and all buckets are alike in size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import cut

#: Text of a block, in bytes; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Entries of a bucket, about.
BUCKET_ENTRIES = 1 << 19
BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, data binary"


def squeeze(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes, which suits sorted hashes and small numbers."""
    width = x.dtype.itemsize
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def stretch(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpack(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)) as f:
        return f.read_next_batch()


#: A block's number is its task << PLACE_BITS, plus its place there.
PLACE_BITS, TASK_BITS = 16, 20


def write_blocks(docs: DataFrame, columns: dict[str, str], label: str = "blocks", path: str | None = None, number: int = 0) -> DataFrame:
    """A table of blocks of the columns {name: type} of docs, the last of which is the text. Within a block the
    rows are in order of the first column, null last. Null text is kept as empty. Blocks of different `number`s differ in
    their numbers. path: where to write, if not to a new folder."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pa.compute.sort_indices(table, [(names[0], "ascending")]))
            at = table.schema.get_field_index(names[-1])
            text = table.column(at).combine_chunks().cast(pa.large_string())
            table = table.set_column(at, names[-1], text.fill_null("") if text.null_count else text).combine_chunks()
            row = [[(number << TASK_BITS + PLACE_BITS) | (part << PLACE_BITS) | seq], [table.num_rows], [size], [pack(table.to_batches()[0])]]
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "n_docs", "n_bytes", "data"])

        for batch in batches:
            for piece in tx.blocks(batch, names[-1], BLOCK_BYTES):
                more = int(tx.raw(piece.column(len(names) - 1))[1][-1])
                if held and (size + more > BLOCK_BYTES or sum(b.num_rows for b in held) + piece.num_rows > 4 * tx.BLOCK_DOCS):
                    yield flush()
                held.append(piece)
                size += more
        if held:
            yield flush()

    src = docs.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))
    return cut(src.mapInArrow(run, BLOCK_SCHEMA), label, path=path)


def split_at(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of ascending hashes: bucket b holds h[bounds[b] : bounds[b + 1]]; empty buckets are left out."""
    b = (h >> tx.U64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return b[first], np.append(first, len(h))


def send(blocks: DataFrame, emit: Callable, bits: int, payloads: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, block, h, p0, p1, ...) of every block. emit(block id, batch, *extra columns) gives ascending distinct
    hashes and `payloads` integer arrays along them."""
    schema = "bucket int, block long, h binary" + "".join(f", p{k} binary" for k in range(payloads))
    names = ["bucket", "block", "h", *(f"p{k}" for k in range(payloads))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                row = rows.slice(k, 1)
                block = row.column(0)[0].as_py()
                h, *more = emit(block, unpack(row.column(1)[0].as_py()), *(row.column(2 + j)[0].as_py() for j in range(len(extra))))
                buckets, bounds = split_at(h, bits)
                if not len(buckets):
                    continue
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                cols = [pa.array(buckets, pa.int32()), pa.array(np.full(len(buckets), block), pa.int64())]
                cols += [pa.array([squeeze(x[a:b]) for a, b in spans], pa.binary()) for x in (h, *more)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return blocks.select("block", "data", *extra).mapInArrow(run, schema)


def answers(found: DataFrame, value: str) -> DataFrame:
    """(block, value) with all buckets' answers to a block in one array."""
    return found.groupBy("block").agg(F.collect_list(value).alias(value))


def of_blocks(blocks: DataFrame, run: Callable, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """run(batch, *extra columns) -> record batch, for every block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                row = rows.slice(k, 1)
                out = run(unpack(row.column(0)[0].as_py()), *(row.column(1 + j)[0].as_py() for j in range(len(extra))))
                if out is not None and out.num_rows:
                    yield out

    return blocks.select("data", *extra).mapInArrow(each, schema)
