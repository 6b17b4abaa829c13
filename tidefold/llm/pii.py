"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, after the base ones.
MORE_KINDS = ("iban", "ssn", "tel")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match of the plain pattern can begin inside a run of digits, so the look-behind only saves rescans of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"), "tel": ("phone", "tel", "call", "mobile", "fax"),
}
#: Score of a confirmed span without context, and what a context word within REACH characters adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "tel": 0.3}
BOOST, REACH, THRESHOLD = 0.3, 40, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outwards in linear time."""
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, done := m.end()))
        at = t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start."""
    out = [("email", a, b) for a, b in _emails(t)]
    for m in _IP.finditer(t):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(t):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(t):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def score(t: str, kind: str, start: int, end: int) -> float:
    near = t[max(0, start - REACH) : end + REACH].lower()
    words = set(re.findall(r"[^\W\d_]+", near))
    return min(1.0, PRIOR[kind] + BOOST * any(w in words for w in CONTEXT[kind]))


def _union(found: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what some spans cover, in order and without overlap."""
    starts, ends = [], []
    for _, a, b in sorted(found, key=lambda x: x[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans(t: str) -> list[tuple[str, int, int, float]]:
    """All spans with their scores: the base ones whatever their score, others that reach THRESHOLD and overlap none."""
    found = base_spans(t)
    starts, ends = _union(found)
    for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("tel", _TEL)):
        for m in pattern.finditer(t):
            a, b = m.span()
            if kind == "iban" and not (15 <= len(x := m.group().replace(" ", "")) <= 34 and mod97(x)):
                continue
            at = bisect_right(ends, a)
            if (at == len(ends) or starts[at] >= b) and score(t, kind, a, b) >= THRESHOLD:
                starts.insert(at, a)
                ends.insert(at, b)
                found.append((kind, a, b))
    return [(k, a, b, score(t, k, a, b)) for k, a, b in found]


def _joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for part in tx.blocks(batch):
            data, off = tx.raw(part.column(1))
            # every kind has an @ or a digit
            marks = np.flatnonzero((data == 64) | ((data >= 48) & (data <= 57)))
            some = np.flatnonzero(np.diff(np.searchsorted(marks, off)))
            texts = part.column(1).take(pa.array(some)).to_pylist()
            n = part.num_rows
            counts = {k: [0] * n for k in BASE_KINDS}
            digest, joined, scores = [nothing] * n, [""] * n, [[] for _ in range(n)]
            for i, t in zip(some.tolist(), texts, strict=True):
                found = spans(t)
                if not found:
                    continue
                base = [(k, a, b) for k, a, b, _ in found if k in counts]
                for k, _, _ in base:
                    counts[k][i] += 1
                digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                joined[i], scores[i] = _joined([x[:3] for x in found]), [x[3] for x in found]
            cols = [part.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digest), pa.array(joined, pa.string()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for every row of docs; no shuffle.

    spans lists kind:start:end in code points, end exclusive, base kinds first; scores run beside it. The counts
    and base_sha256 are of base spans alone. IBANs (mod-97), social security numbers and national telephone
    numbers are added where checksum and nearby words bring the score to THRESHOLD. Null text is empty: no
    span, the hash of the empty string. A null id is kept, and repeated rows are
    searched each. No rows: none. Other columns are ignored. Ids are numbers.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_find, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def redacted(t: str) -> str:
    """A text with each stretch that spans cover replaced by the kind of the one that begins it (of equal ones the first kind
    found), in angle brackets."""
    found = [x[:3] for x in spans(t)]
    kind = {}
    for k, a, _ in found:
        kind.setdefault(a, k)
    out, at = [], 0
    for a, b in zip(*_union(found), strict=True):
        out += [t[at:a], f"<{kind[a]}>"]
        at = b
    return "".join([*out, t[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data of one column redacted, all other columns and rows as they are. Null and empty texts stay
    so; ids aren't looked at, and repeated rows come out alike. No shuffle."""
    kind = docs.schema[text_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = pa.array([redacted(t) if t else t for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), out)

    if kind.simpleString() != "string":
        raise TypeError(f"{text_col} is no text")
    return docs.mapInArrow(run, docs.schema)
