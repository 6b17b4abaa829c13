"""Quality classifier by compression: text is likelier good the better a dictionary of good text compresses it.

Two zstandard dictionaries are trained on half of a bounded sample of labelled texts, one per class. A text is
cut into chunks, each compressed with both; the size differences, divided by the sizes, are calibrated into a
probability by logistic regression on the other half of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: The bounded sample that the model is fitted on: labelled rows per class, and characters of a text. A longer text is
#: stood for by so many characters from a place that a hash of its id sets.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
CHUNK, DICTIONARY, LEVEL = 1024, 112_640, 3
FEATURES = 4


def _dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks, level=LEVEL)
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return zstandard.ZstdCompressionDict(b"".join(chunks)[-DICTIONARY:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _compressor(d: zstandard.ZstdCompressionDict) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: tuple[bool, bool]
    center: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def tools(self) -> tuple:
        kinds = [zstandard.DICT_TYPE_RAWCONTENT if r else zstandard.DICT_TYPE_FULLDICT for r in self.raw]
        dicts = [zstandard.ZstdCompressionDict(d, dict_type=k) for d, k in zip((self.good, self.bad), kinds, strict=True)]
        for d in dicts:
            d.precompute_compress(level=LEVEL)
        return tuple(map(_compressor, dicts))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def features(t: bytes, tools: tuple) -> tuple[float, ...]:
    """Of a text: the mean size difference, those of its best and worst chunk, and the compressed share. All of the text is
    compressed; a last chunk under a quarter of CHUNK counts in the means, but is not asked to be best or worst."""
    if not t:
        return (0.0,) * FEATURES
    good, bad = tools
    chunks = [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)]
    g, b, n = [len(good.compress(c)) for c in chunks], [len(bad.compress(c)) for c in chunks], [len(c) for c in chunks]
    each = [(y - x) / m for x, y, m in zip(g, b, n, strict=True) if m >= CHUNK // 4 or len(n) == 1]
    return (sum(b) - sum(g)) / sum(n), min(each), max(each), min(sum(g), sum(b)) / sum(n)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for ridge logistic regression; the intercept is not shrunk."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[int, str, int]]) -> Model | float:
    """A model of (id, text, label) rows, or the constant score where only one class or none is known."""
    rows = sorted({(i, t or "", int(y)) for i, t, y in rows})
    labels = np.array([y for _, _, y in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return float(labels.mean()) if len(rows) else 0.5
    halves: dict[int, list] = {0: [], 1: []}
    seen = [0, 0]
    for i, t, y in rows:  # each class is halved, so both halves know it
        halves[seen[y] % 2].append((t.encode(), y))
        seen[y] += 1
    if len({y for _, y in halves[1]}) < 2:
        halves[1] = halves[0]
    dicts = [_dictionary([t for t, y in halves[0] if y == c]) for c in (1, 0)]
    raw = tuple(not d.dict_id() for d in dicts)
    model = Model(dicts[0].as_bytes(), dicts[1].as_bytes(), raw)
    tools = model.tools()
    x = np.array([features(t, tools) for t, _ in halves[1]])
    y = np.array([y for _, y in halves[1]], float)
    model.center, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    model.weights = _logistic((x - model.center) / model.scale, y)
    return model


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str) -> list[tuple[int, str, int]]:
    """At most SAMPLE_ROWS labelled rows of each class, those of least id hash, with SAMPLE_CHARS characters of a text at
    most. An id with both labels is passed over; one that several documents have gives each of them."""
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).alias("other")).where("y = other").select("id", "y")
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS) for y in (0, 1)]
    picked = [tuple(r) for p in picks for r in p.collect()]
    ids = docs.sparkSession.createDataFrame(picked, "id long, y int")
    text = F.col(text_col).cast("string")
    spare = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0))
    part = F.substring(text, (F.pmod(F.xxhash64(F.col(id_col).cast("long")), spare + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    # the ids are 2 * SAMPLE_ROWS rows at most
    found = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("text")).join(F.broadcast(ids), "id")
    return [(r[0], r[1], r[2]) for r in found.orderBy("id", "text").limit(2 * SAMPLE_ROWS).select("id", "text", "y").collect()]


def apply(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs; no shuffle. The model, of a fixed size, travels with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.tools() if isinstance(model, Model) else None
        for batch in batches:
            for part in tx.blocks(batch):
                if tools:
                    data, off = tx.raw(part.column(1))
                    whole, at = data.tobytes(), off.tolist()
                    x = np.array([features(whole[a:b], tools) for a, b in zip(at, at[1:])]).reshape(-1, FEATURES)
                    s = model.score(x)
                else:
                    s = np.full(part.num_rows, model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    Labels are learnt only from rows whose crc32(id as text) mod `folds` is not `held`, on a sample bounded by
    SAMPLE_ROWS and SAMPLE_CHARS; every document is scored on its whole text alone. Ids are numbers; an id with
    contradicting labels teaches nothing, and repeated rows are scored each. Null or empty text has all
    features 0. With no label, or of one class only, the score is that class's share (0.5 without labels). Labels
    other than 0 and 1 and null ids in labels are passed over; a null id in docs is scored, held_out false.
    """
    model = fit(sample(docs, labels, fold(F.col(id_col).cast("long"), folds) != held, id_col, text_col, label_col))
    out = apply(docs, model, id_col, text_col)
    return out.select("id", F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
