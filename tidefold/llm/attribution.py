"""Token counts of fields and sections: a document is encoded once, and its tokens' spans are joined to the sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .bpe import default_vocabulary, encoder

RULES = ("first", "last", "majority")


def owners(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section that owns each token, whether the token crosses a boundary). bounds: ascending starts of sections.

    first: the section of its first byte; last: of its last byte; majority: the one with most of its bytes, the
    earlier on a tie.
    """
    a, b = np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, end - 1, "right") - 1
    own = a if rule == "first" else b
    if rule == "majority":
        own = a.copy()
        for i in np.flatnonzero(a != b):
            edges = np.clip(np.append(bounds[a[i] : b[i] + 1], end[i]), start[i], end[i])
            own[i] = a[i] + int(np.argmax(np.diff(edges)))
    return own, a != b


def _attribute(path: str, rule: str, special_as_text: bool, carry: bool = False):
    """Of (id, text[, starts][, fields]); with `carry` the last column goes on with its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special_as_text)
        width = enc.byte_lengths()
        for batch in batches:
            for part in tx.blocks(batch):
                data, off = tx.raw(part.column(1))
                ids, count = enc.encode(part.column(1))
                end = np.cumsum(width[ids])
                start = end - width[ids]
                n = part.num_rows
                if part.num_columns - carry > 2:  # starts in code points, to bytes
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    base = np.searchsorted(lead, off)
                    given = []
                    for i, x in enumerate(part.column(2).to_pylist()):
                        inside = sorted({p for p in x or () if p is not None and 0 < p < base[i + 1] - base[i]})
                        given.append(lead[base[i] + np.array(inside, np.int64)] if inside else np.zeros(0, np.int64))
                    inner = np.concatenate(given) if given else np.zeros(0, np.int64)
                else:  # lines: one begins after each line feed that something follows
                    inner = np.flatnonzero(data == 10) + 1
                    inner = inner[~np.isin(inner, off)]
                full = np.diff(off) > 0
                bounds = np.union1d(off[:-1][full], inner)
                sections = np.diff(np.searchsorted(bounds, off))
                own, crossing = owners(start, end, bounds, rule)
                per = np.bincount(own, minlength=len(bounds)) if len(bounds) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(n), count)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sections)]), pa.int32()), pa.array(per, pa.int64()))
                cols = [part.column(0), pa.array(count, pa.int64()), pa.array(sections, pa.int64()), pa.array(np.bincount(doc[crossing], minlength=n), pa.int64()), lists]
                names = ["id", "n_tokens", "n_sections", "n_crossing", "section_tokens"]
                if carry:
                    cols, names = [*cols, part.column(part.num_columns - 1)], [*names, "fields"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def section_tokens(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", starts_col: str | None = None, rule: str = "first", special_as_text: bool = False
) -> DataFrame:
    """(id, n_tokens, n_sections, n_crossing, section_tokens) for every row of docs; no shuffle. Ids are numbers.

    Sections begin at 0 and at the code points in starts_col (an array; null, repeated and outside positions are
    ignored), or without it at each line. A token across a boundary goes to one section by `rule`, so
    section_tokens always sums to n_tokens; n_crossing counts such tokens. Null or empty text has no section.
    A null id is kept. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    if starts_col:
        cols.append(F.col(starts_col).cast("array<long>").alias("starts"))
    run = _attribute(vocabulary or default_vocabulary(), rule, special_as_text)
    return docs.select(*cols).mapInArrow(run, "id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def field_tokens(docs: DataFrame, fields: list[str], vocabulary: str | None = None, id_col: str = "doc_id", rule: str = "first") -> DataFrame:
    """section_tokens over several string columns: they are joined, encoded once, and each field is a section.

    A null or empty field has no characters, so no section stands for it; `fields` in the result names those that
    do, beside section_tokens, row by row: repeated and null ids keep their own. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    sizes = [F.length(p).cast("long") for p in parts]
    starts, at = [], F.lit(0).cast("long")
    for size in sizes:
        starts.append(at)
        at = at + size
    named = F.filter(F.array(*(F.when(s > 0, F.lit(f)) for s, f in zip(sizes, fields, strict=True))), lambda x: x.isNotNull())
    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.concat(*parts).alias("text"), F.array(*starts).alias("starts"), named.alias("fields"))
    run = _attribute(vocabulary or default_vocabulary(), rule, False, True)
    return joined.mapInArrow(run, "id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>, fields array<string>")
