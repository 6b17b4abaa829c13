"""Quality rules on tokeniser fertility: how a public vocabulary takes a text apart tells prose from junk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import text as tx
from .bpe import default_vocabulary, encoder, spelling
from .scratch import cut

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "other")
#: Script by lead byte of UTF-8, as an index into SCRIPTS; -1 for bytes that tell none.
SCRIPT_OF = np.full(256, -1, np.int8)
for _span, _script in (((65, 91), 0), ((97, 123), 0), ((0xC3, 0xCA), 0), ((0xCE, 0xD0), 1), ((0xD0, 0xD4), 2), ((0xD6, 0xDD), 3), ((0xE0, 0xE1), 4), ((0xE3, 0xEE), 5), ((0xF0, 0xF5), 6)):
    SCRIPT_OF[slice(*_span)] = _script


@dataclass(frozen=True)
class Band:
    """What a text of some group may be."""

    chars_low: float  #: characters per token
    chars_high: float
    fallback_high: float  #: share of tokens that are no whole characters
    entropy_low: float  #: bits per token


#: Texts under so many tokens are too short to judge; a band holds for texts from one of these sizes to the next.
MIN_TOKENS = 40
SIZES = (MIN_TOKENS, 120, 360, 1080)
#: Fewer documents of a group and size than this leave it the wide band.
LEAST = 50
#: A band reaches so many interquartile ranges beyond the quartiles, and this far at least.
#: The least leaves room for a passage in another language.
REACH, NARROWEST = 3.0, {"chars_per_token": 0.3, "fallback_share": 0.15, "token_entropy": 0.0}
#: For groups too rare to fit: prose of a script lies well inside, whatever its language. A byte-level vocabulary made for
#: English gives other scripts fewer characters per token and more fragments.
WIDE = {
    "latin": Band(1.75, 8.0, 0.25, 3.5),
    "greek": Band(0.6, 6.0, 0.9, 3.0),
    "cyrillic": Band(0.6, 6.0, 0.9, 3.0),
    "semitic": Band(0.6, 6.0, 0.9, 3.0),
    "indic": Band(0.25, 5.0, 1.0, 2.5),
    "east_asian": Band(0.25, 5.0, 1.0, 2.5),
    "other": Band(0.2, 8.0, 1.0, 2.5),
}
Bands = dict[tuple[str, int], Band]
#: Bands that are broadcast at most, some 100 bytes each.
MOST_BANDS = 1 << 14
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
#: Bands are found from counts by cells of this width; a measure over CELLS widths counts as that.
WIDTH, CELLS = 1 / 1024, 1 << 16
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = ", ".join([*(f"{x} long" for x in BASE), "base_failed boolean", "n_tokens long", *(f"{x} double" for x in MEASURES), "script string", "group string", "size int"])


def size_class(n_tokens: np.ndarray) -> np.ndarray:
    return np.searchsorted(SIZES, n_tokens, "right")


def base_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = tx.words(texts)
    n, data, off = len(texts), w.data, w.off
    sums = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum(~tx.SPACE[data] & ((data & 0xC0) != 0x80), out=sums[0, 1:])
    np.cumsum(SYMBOLS[data], out=sums[1, 1:])
    chars, symbols = sums[:, off[1:]] - sums[:, off[:-1]]

    # lines: between line feeds and document edges
    cuts = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], cuts + 1]))
    end = np.sort(np.concatenate([cuts, off[1:]]))
    line_doc = np.repeat(np.arange(n), np.diff(np.searchsorted(cuts, off)) + 1)
    with_word = sums[0, end] > sums[0, start]
    start, end, line_doc = start[with_word], end[with_word], line_doc[with_word]
    h = tx.span_hash(data, start, end)
    order = np.lexsort((h, line_doc))
    same = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = np.bincount(line_doc[order][1:][same], minlength=n)

    # windows found twice or more
    total = len(w.hash)
    at = np.flatnonzero(np.arange(total) + WINDOW <= np.repeat(w.first[1:], w.count))
    repeat = np.zeros(n, np.int64)
    if len(at):
        p, inv = tx.powers(total + 1)
        run = np.zeros(total + 1, tx.U64)
        np.cumsum(w.hash * p[:-1], out=run[1:])
        doc = w.doc
        # a hash of window and document: equal windows of one text are equal keys
        key = tx.mix((run[at + WINDOW] - run[at]) * inv[at] + tx.mix(doc[at].astype(tx.U64) + tx.U64(1)))
        order = np.argsort(key, kind="stable")
        twice = np.zeros(len(at), bool)
        equal = key[order][1:] == key[order][:-1]
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        cover = np.zeros(total + 1, np.int32)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {"n_words": w.count, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def fertility(texts: pa.Array, enc, fragment: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens, chars_per_token, fallback_share, token_entropy and script (index) of each text; zeros without tokens."""
    n = len(texts)
    data, off = tx.raw(texts)
    ids, count = enc.encode(texts)
    chars = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off])
    some = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), count)
    share = np.bincount(doc[fragment[ids]], minlength=n) / some
    key = (doc.astype(np.int64) << 20) | ids
    key.sort()
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    times = np.diff(bounds)
    owner = key[bounds[:-1]] >> 20
    entropy = np.log2(some) - np.bincount(owner, weights=times * np.log2(times), minlength=n) / some
    tally = np.zeros((n, len(SCRIPTS)), np.int64)
    kind = SCRIPT_OF[data]
    for s in range(len(SCRIPTS)):
        tally[:, s] = np.diff(np.concatenate([[0], np.cumsum(kind == s)])[off])
    return {"n_tokens": count, "chars_per_token": chars / some, "fallback_share": share, "token_entropy": np.maximum(entropy, 0.0), "script": tally.argmax(axis=1)}


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])


def _measures(texts: pa.Array, given: pa.Array, enc, fragment: np.ndarray) -> list[pa.Array]:
    """The columns MEASURED of some texts. A text's group is what is given, such as its language, or else its main script."""
    base, f = base_measures(texts), fertility(texts, enc, fragment)
    script = pa.array([SCRIPTS[s] for s in f["script"]], pa.string())
    group = pc.coalesce(given, script)
    cols = [*(pa.array(base[k], pa.int64()) for k in BASE), pa.array(base_failed(base)), pa.array(f["n_tokens"], pa.int64())]
    return [*cols, *(pa.array(f[k], pa.float64()) for k in MEASURES), script, group, pa.array(size_class(f["n_tokens"]), pa.int32())]


def measured(docs: DataFrame, name: str, text_col: str, group_col: str | None, vocabulary: str | None, special_as_text: bool) -> DataFrame:
    """docs with a struct column `name` of MEASURED; one pass, no shuffle."""
    path = vocabulary or default_vocabulary()
    fields = [c.split()[0] for c in MEASURED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special_as_text)
        fragment = _fragments(enc)
        for batch in batches:
            for part in tx.blocks(batch, text_col):
                given = part.column(part.schema.get_field_index(group_col)).cast(pa.string()) if group_col else pa.nulls(part.num_rows, pa.string())
                cols = _measures(part.column(part.schema.get_field_index(text_col)), given, enc, fragment)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(cols, fields)], names=[*part.schema.names, name])

    kind = docs.sparkSession.createDataFrame([], MEASURED).schema
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, kind)]))


def fit_bands(rows: DataFrame, name: str) -> Bands:
    """A band for each group (language, or script) and size class, from the quartiles of all documents that the base rules keep;
    rows as measured() gives them. Counts by cell are added up on the map side, and reach the driver: CELLS to a measure, group
    and size at most. No documents: no bands."""
    m = F.col(name)
    cell = lambda x: F.least(F.floor(m[x] / F.lit(WIDTH)), F.lit(CELLS)).cast("long")
    each = rows.where(~m["base_failed"] & (m["size"] > 0)).select(m["group"].alias("group"), m["size"].alias("size"), F.posexplode(F.array(*map(cell, MEASURES))).alias("measure", "cell"))
    found: dict[tuple[str, int], list[list[tuple[int, int]]]] = {}
    for r in each.groupBy("group", "size", "measure", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault((r["group"], r["size"]), [[], [], []])[r["measure"]].append((r["cell"], r["n"]))
    return {k: _band(v) for k, v in found.items() if sum(n for _, n in v[0]) >= LEAST}


def _band(cells: list[list[tuple[int, int]]]) -> Band:
    low, high = np.array([_quartiles(c) for c in cells]).T
    reach = np.maximum(REACH * (high - low), [NARROWEST[m] for m in MEASURES])
    return Band(float(low[0] - reach[0]), float(high[0] + reach[0]), float(high[1] + reach[1]), float(low[2] - reach[2]))


def _quartiles(cells: list[tuple[int, int]]) -> tuple[float, float]:
    """The middles of the cells that hold a quarter and three quarters of the way."""
    at, n = np.array(sorted(cells)).T
    upto = np.cumsum(n)
    return tuple((at[np.searchsorted(upto, q * upto[-1])] + 0.5) * WIDTH for q in (0.25, 0.75))


def within(name: str, bands: Bands, spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows with a column `kept_`: whether the base rules pass them and their band holds them. Up to MOST_BANDS
    bands are broadcast; more are joined by shuffle, where a hot group can be split."""
    table = [(g, k, *astuple(b)) for (g, k), b in bands.items()]
    wide = [(s, *astuple(b)) for s, b in WIDE.items()]
    own = spark.createDataFrame(table, "group_ string, size_ int, a_ double, b_ double, c_ double, d_ double")
    other = spark.createDataFrame(wide, "script_ string, e_ double, f_ double, g_ double, h_ double")
    m = F.col(name)
    own = F.broadcast(own) if len(bands) <= MOST_BANDS else own
    both = rows.join(own, (m["group"] == F.col("group_")) & (m["size"] == F.col("size_")), "left").join(F.broadcast(other), m["script"] == F.col("script_"))
    low, high, share, bits = (F.coalesce(x, y) for x, y in (("a_", "e_"), ("b_", "f_"), ("c_", "g_"), ("d_", "h_")))
    good = (m["chars_per_token"] >= low) & (m["chars_per_token"] <= high) & (m["fallback_share"] <= share) & (m["token_entropy"] >= bits)
    return both.withColumn("kept_", ~m["base_failed"] & (good | (m["n_tokens"] < MIN_TOKENS)))


def _fragments(enc) -> np.ndarray:
    """Whether each id stands for bytes that are no whole characters."""
    out = np.zeros(len(enc.byte_lengths()), bool)
    alphabet = {c: b for b, c in enumerate(spelling())}
    for token, i in enc.lib.get_vocab(with_added_tokens=False).items():
        raw = bytes(alphabet.get(c, 63) for c in token)
        try:
            raw.decode()
        except UnicodeDecodeError:
            out[i] = True
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, vocabulary: str | None = None, bands: Bands | None = None, special_as_text: bool = False) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_tokens, chars_per_token,
    fallback_share, token_entropy, script) for every row of docs. Ids are numbers.

    base_failed: under 20 words, or over 30% of the words in 8-word windows that the text repeats. Otherwise a text
    is kept if its fertility lies within the band of its group and size: `bands`, or those that fit_bands finds in docs. Groups
    are those of group_col, such as a language, or the main script where that is null or not given. Texts of under MIN_TOKENS
    tokens are kept. Null or empty text has no words and fails. A null id is kept as it is, and repeated rows are judged
    each. No rows: none. Other columns are ignored. Texts are read once; their measures are written to the shared folder.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(group_col) if group_col else F.lit(None)).cast("string").alias("group"), F.col(text_col).cast("string").alias("text"))
    rows = measured(src, "m", "text", "group", vocabulary, special_as_text).select("id", "m")
    if bands is None:
        rows = cut(rows, "measures")
        bands = fit_bands(rows, "m")
    out = within("m", bands, docs.sparkSession, rows)
    return out.select("id", *(F.col(f"m.{c}") for c in (*BASE, "base_failed")), F.col("kept_").alias("kept"), *(F.col(f"m.{c}") for c in ("n_tokens", *MEASURES, "script")))


def keep_good(docs: DataFrame, text_col: str = "text", group_col: str | None = None, vocabulary: str | None = None, bands: Bands | None = None, special_as_text: bool = False) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; no shuffle. Null and empty texts go,
    repeated rows stay or go together, and null ids are kept as they are. Texts are read once; the rows that pass the base rules
    are written to the shared folder with their measures until the bands are known."""
    name = "m_"
    while any(c.lower() == name for c in docs.columns):  # no name of docs' own
        name += "_"
    rows = measured(docs, name, text_col, group_col, vocabulary, special_as_text).where(~F.col(name)["base_failed"])
    if bands is None:
        rows = cut(rows, "measured")
        bands = fit_bands(rows, name)
    held = rows.select(F.struct(*docs.columns).alias("row_"), F.col(name).alias("m_"))
    return within("m_", bands, docs.sparkSession, held).where("kept_").select("row_.*")
