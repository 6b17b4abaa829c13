"""Operators that judge each row by itself: personal data, token counts, quality, classifier, leaks, mixing, token files."""

import hashlib
import re
import zlib

import pytest
from tokenizers import Tokenizer

from tidefold.llm import attribution, bpe, classifier, decontamination, mixing, pii, quality, repair

from .cases import frame, texts, words

PRIVATE = [
    "mail a.b+c@x-y.example.org or bad@nodot, call +49 (30) 1234-5678 now",
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112; host 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5",
    "iban DE89 3704 0044 0532 0130 00 bank account; ssn 123-45-6789; call 555-123-4567; é@é.com x@y.z@w.v",
    "@@ a@b a@b.c.d-e 0000.1.2.3 +1 2 +123456789012345 +1234567890123456 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1",
]


def luhn(d):
    s = 0
    for k, c in enumerate(d[::-1]):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern in (("card", "[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if (13 <= len(d) <= 19 and luhn(d)) if kind == "card" else 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


def test_personal_data_matches_brute_force(spark):
    rows = list(enumerate(texts() + PRIVATE)) + [(None, PRIVATE[0])]
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        r = next(r for r in got if r["id"] == i)
        want = base(t)
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined)
    assert any("iban" in r["spans"] for r in got)
    assert "<email>" in next(r["text"] for r in pii.redact(frame(spark, [(1, PRIVATE[0])])).collect())
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_section_tokens_add_up_to_one_encoding_of_the_whole(spark):
    rows = list(enumerate(texts()))
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    for rule in attribution.RULES:
        got = {r["id"]: r for r in attribution.section_tokens(frame(spark, rows), rule=rule).collect()}
        for i, t in rows:
            t = t or ""
            e = lib.encode(t, add_special_tokens=False)
            r = got[i]
            assert r["n_tokens"] == len(e.ids) == sum(r["section_tokens"])
            lines = len([x for x in t.split("\n")]) - (t.endswith("\n")) if t else 0
            assert r["n_sections"] == lines
    with pytest.raises(ValueError):
        attribution.section_tokens(frame(spark, rows), rule="half")
    two = attribution.field_tokens(frame(spark, [(1, "some words here"), (2, None)]), ["lang", "text"]).collect()
    assert {r["id"]: (r["fields"], len(r["section_tokens"])) for r in two} == {1: (["lang", "text"], 2), 2: (["lang"], 1)}


def quality_base(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = {}
    for k in range(len(w) - 7):
        grams.setdefault(tuple(w[k : k + 8]), []).append(k)
    hit = {p for at in grams.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_match_brute_force(spark):
    rows = list(enumerate(texts() + ["#*$%&|<> " * 30, "word " * 100, "a|b <c> " + " ".join(f"w{i}" for i in range(50))])) + [(None, "x")]
    got = quality.quality_rules(frame(spark, rows).repartition(2)).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        r = next(r for r in got if r["id"] == i)
        n, c, s, d, p = quality_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, c, s, d, p)
        assert r["base_failed"] == (n < 20 or 100 * p > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    kept = {r["id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in quality.keep_good(frame(spark, rows)).collect()} == kept
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_bands_reject_junk_and_keep_prose(spark):
    prose = "The committee will meet again next week to discuss the results of the survey and the plans for the coming year. " * 1 + "Many people attended, and several of them asked thoughtful questions about the budget, the schedule, and the remaining risks. Nobody objected to the proposal, although a few members suggested small changes."
    junk = "x9Q#zK7@vL2 " + " ".join(f"q{k}Z{k * 7919 % 1000}xK!{k}" for k in range(80))
    got = {r["id"]: r["kept"] for r in quality.quality_rules(frame(spark, [(1, prose), (2, junk)])).collect()}
    assert got == {1: True, 2: False}


def test_classifier_learns_from_its_folds_only(spark):
    good = [(i, f"the quiet river ran past old houses and {i} gardens where people talked in the evening light number {i}") for i in range(0, 200, 2)]
    bad = [(i, f"$$$ WIN!! {i} CLICK!! FREE### CASH%%% NOW!!! {i} BUY&&& " * 3) for i in range(1, 200, 2)]
    docs = frame(spark, good + bad + [(500, None), (None, "the quiet river")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, 0), (900, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in classifier.quality_scores(docs, labels).collect()}
    assert len(got) == 202
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values()) >= len(held)
    assert sum(got[i]["predicted"] == (i % 2 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1 then 1 - quality else quality end as quality")
    again = {r["id"]: r["score"] for r in classifier.quality_scores(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    assert {r["score"] for r in classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_leaks_match_brute_force(spark):
    r = texts()
    items = [(k, " ".join(r[16].split()[40 * k : 40 * k + 30]) + ". " + " ".join(r[16].split()[40 * k + 30 : 40 * k + 38]) + ".") for k in range(20)] + [(50, None), (51, ""), (52, "two words"), (None, "an item that has no number but has words all the same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(100, r[26] + " " + items[3][1].upper() + " " + r[27]), (101, r[28] + "\n" + items[7][1]), (102, " ".join(items[5][1].split()[:10]) + " " + r[20]), (103, None), (104, ""), (105, "so it has two words in it"), (106, "an item that has no number but has words all the same"), (None, items[1][1]), (107, r[29])]
    got = {(x["id"], x["item_id"]) for x in decontamination.find_leaks(frame(spark, docs).repartition(2), bench).collect()}
    assert got == {(100, 3), (101, 7), (105, 52), (106, None), (None, 1)}
    left = {x["doc_id"] for x in decontamination.without_leaks(frame(spark, docs), bench).collect()}
    assert left == {102, 103, 104, 107}
    assert decontamination.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontamination.find_leaks(frame(spark, []), bench).count() == 0


def test_bounds_lose_no_piece_that_scores(spark):
    """All scores at or over the threshold are retrieved: against plain scoring of every passage and piece."""
    import numpy as np
    import pyarrow as pa

    r = texts()[16].split()
    ix = decontamination.build([(k, " ".join(r[30 * k : 30 * k + 35])) for k in range(60)])
    docs = pa.array([" ".join(r[a : a + 150]) for a in range(0, 1500, 130)], pa.large_string())
    w = decontamination.folded(docs)
    doc, piece, score = decontamination.retrieve(w, ix, 0.3)
    best = {}
    for d, p, s in zip(doc.tolist(), piece.tolist(), score.tolist(), strict=True):
        best[d, p] = max(best.get((d, p), 0), s)
    want = {}
    half = decontamination.PASSAGE // 2
    for d in range(len(docs)):
        h = w.hash[w.first[d] : w.first[d + 1]]
        for a in range(0, max(1, len(h) - half), half):
            seen = np.unique(h[a : a + decontamination.PASSAGE])
            total = np.zeros(len(ix.item))
            for t in np.flatnonzero(np.isin(ix.terms, seen)):
                total[ix.piece[ix.first[t] : ix.first[t + 1]]] += ix.impact[ix.first[t] : ix.first[t + 1]]
            for p in np.flatnonzero(total >= 0.3):
                want[d, int(p)] = max(want.get((d, int(p)), 0), total[p])
    assert want and best.keys() == want.keys()
    assert all(abs(best[k] - want[k]) < 1e-9 for k in want)


def test_mixing_reaches_its_targets(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (3, "one")]
    got = mixing.mix_sources(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    assert sum(r["size"] for r in got) == sum(len(words(t)) for _, t in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_sources(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    many = mixing.mixture(frame(spark, rows))
    assert many.columns == frame(spark, rows).columns
    assert many.count() == sum(r["times"] for r in got)
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_token_files_are_read_back_as_the_library_encodes(spark):
    rows = list(enumerate(texts()))[::-1] + [(None, "a b"), (5, "again"), (90, "the end <|endoftext|> ! 0")]
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    got = repair.token_output(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    start, out = 0, []
    for i, ids in want:
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == out
    assert repair.token_output(frame(spark, [])).count() == 0


def test_repair_round_trip_and_random_access():
    import numpy as np

    r = np.random.default_rng(1)
    ids = r.integers(0, 50, 5000).astype(np.uint32)
    ids[1000:2000] = np.tile(ids[:10], 100)
    s, rules, lengths = repair.compress(ids)
    assert len(rules) and len(s) < len(ids)
    assert (repair.expand(s, rules, lengths) == ids).all()
