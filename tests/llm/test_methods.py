"""What the operators add to their contracts' base, against brute force: attribution, added spans, fertility and bands, index shares,
whole texts, random access, and texts of over a megabyte."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidefold.llm import attribution, bpe, classifier, contextmix, decontamination, minhash, pii, quality, repair, substring

from .cases import frame, texts, words
from .test_rows import PRIVATE, base
from .test_substring import brute, rows_of


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(bpe.default_vocabulary())


# op2


def token_bytes(lib, t):
    """(start, end) in bytes of every token: byte-level vocabularies spell each byte with one character."""
    at, out = 0, []
    for x in lib.encode(t, add_special_tokens=False).tokens:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def attributed(lib, t, starts, rule):
    bounds = [len(t[:p].encode()) for p in sorted({0, *starts})]
    per, crossing = [0] * len(bounds), 0
    for a, b in token_bytes(lib, t):
        held = [sum(1 for x in range(a, b) if lo <= x < hi) for lo, hi in zip(bounds, [*bounds[1:], math.inf], strict=True)]
        some = [k for k, n in enumerate(held) if n]
        crossing += len(some) > 1
        per[{"first": some[0], "last": some[-1], "majority": held.index(max(held))}[rule]] += 1
    return per, crossing


@pytest.mark.parametrize("rule", attribution.RULES)
def test_tokens_of_sections_match_brute_force(spark, lib, rule):
    r = random.Random(3)
    rows = [(k, t, [r.randint(-2, len(t) + 2) for _ in range(r.randint(0, 6))] + [None]) for k, t in enumerate(x for x in texts() if x and len(x) < 2000)]
    df = spark.createDataFrame([*rows, (None, "é ñ 北京 x", [3, 1, 1])], "doc_id long, text string, starts array<int>")
    got = {r["id"]: r for r in attribution.section_tokens(df, starts_col="starts", rule=rule).collect()}
    crossed = 0
    for i, t, s in [*rows, (None, "é ñ 北京 x", [3, 1, 1])]:
        per, crossing = attributed(lib, t, [p for p in s if p is not None and 0 < p < len(t)], rule)
        assert (got[i]["section_tokens"], got[i]["n_crossing"]) == (per, crossing)
        crossed += crossing
    assert crossed > 20


def test_fields_keep_to_their_rows(spark, lib):
    df = spark.createDataFrame([(1, "some words", "en"), (1, None, "fr"), (None, "x", None), (None, None, None)], "doc_id long, text string, lang string")
    got = sorted((r["id"] or 0, r["fields"], r["section_tokens"], r["n_tokens"]) for r in attribution.field_tokens(df, ["lang", "text"]).collect())
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert [g[:2] for g in got] == [(0, []), (0, ["text"]), (1, ["lang"]), (1, ["lang", "text"])]
    assert [g[3] for g in got] == [0, n("x"), n("fr"), n("ensome words")]
    assert all(sum(g[2]) == g[3] for g in got)
    assert attribution.section_tokens(frame(spark, [])).count() == 0


# op3


def test_added_spans_overlap_none_and_match_plain_search():
    r = random.Random(5)
    numbers = [f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" for _ in range(60)]
    phones = [f"({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}" for _ in range(60)]
    for t in [*PRIVATE, "social security: " + " ssn ".join(numbers), "call " + " or phone ".join(phones), " tel ".join(numbers + phones)]:
        taken, want = [(a, b) for _, a, b in base(t)], []
        for kind, pattern in (("iban", pii._IBAN), ("ssn", pii._SSN), ("tel", pii._TEL)):
            for m in pattern.finditer(t):
                a, b = m.span()
                x = m.group().replace(" ", "")
                if kind == "iban" and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 != 1:
                    continue
                if pii.score(t, kind, a, b) >= pii.THRESHOLD and not any(a < y and x < b for x, y in taken):
                    taken.append((a, b))
                    want.append((kind, a, b))
        got = [x[:3] for x in pii.spans(t) if x[0] in pii.MORE_KINDS]
        assert got == want
    assert len(got) > 50


def test_redacted_text_holds_nothing_more(spark):
    df = frame(spark, [(1, PRIVATE[0]), (None, None), (2, ""), (2, "+4111 1111 1111 1111 x")])
    got = pii.redact(df)
    assert got.columns == df.columns
    out = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert (None, None) in out and (2, "") in out
    assert all(not pii.spans(t or "") for _, t in out)


# op5


def test_shares_of_an_index_change_no_score(spark, monkeypatch):
    r = random.Random(2)
    t = texts()[16].split()
    items = [(k, " ".join(t[30 * k : 30 * k + 40]) + ". " + " ".join(t[7 * k : 7 * k + 9]) + ".") for k in range(60)]
    thin = lambda x: " ".join(w for w in x.split() if r.random() < 0.8)
    docs = frame(spark, [(k, "before it " + (x if k % 3 else thin(x)) + " and after") for k, (_, x) in enumerate(items)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (8 << 20, 5000, 900):
        monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
        found.append(sorted((x["id"], x["item_id"], round(x["score"], 9)) for x in decontamination.find_leaks(docs, bench).collect()))
    assert len(found[0]) >= 40 and found[0] == found[1] == found[2]


def test_overlaps_match_brute_force(spark):
    t = texts()[16].split()
    item = (1, "Q: " + " ".join(t[:30]) + "\nA: " + " ".join(t[30:40]))
    doc = " ".join(t[:24] + ["other"] + t[25:37] + ["end"])
    got = decontamination.find_leaks(frame(spark, [(5, doc)]), spark.createDataFrame([item], "item_id long, text string")).first()
    fold = lambda x: re.findall(r"[^\W_]+", x.lower())
    w, q, d = fold(item[1]), len(fold(item[1].split("\nA:")[0] + " A")), fold(doc)
    runs = lambda x: [tuple(x[k : k + 3]) for k in range(len(x) - 2)]
    held = set(runs(d))
    question, answer = {g for k, g in enumerate(runs(w)) if k + 3 <= q}, {g for k, g in enumerate(runs(w)) if k + 3 > q}
    assert got["question_overlap"] == pytest.approx(len(question & held) / len(question))
    assert got["answer_overlap"] == pytest.approx(len(answer & held) / len(answer))


# op7


def test_fertility_matches_brute_force(spark, lib):
    rows = [(k, t) for k, t in enumerate(texts()) if t and len(t) < 3000]
    spelling = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])], strict=True)}
    spelling |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in spelling.values())}

    def broken(token):
        try:
            bytes(spelling[c] for c in token).decode()
        except UnicodeDecodeError:
            return True
        return False

    for r in quality.quality_rules(frame(spark, rows)).collect():
        tokens = lib.encode(dict(rows)[r["id"]], add_special_tokens=False).tokens
        n = len(tokens)
        assert r["n_tokens"] == n
        assert r["chars_per_token"] == pytest.approx(len(dict(rows)[r["id"]]) / n)
        assert r["fallback_share"] == pytest.approx(sum(map(broken, tokens)) / n)
        assert r["token_entropy"] == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(tokens).values()), abs=1e-9)


def test_fitted_bands_reject_what_stands_out_and_little_else(spark, monkeypatch):
    r = random.Random(4)
    common = [w for w in "the river and old house garden people talk evening light water stone bridge summer winter teacher letter window market village little great always never".split()]
    prose = [(k, " ".join(r.choice(common) for _ in range(150)) + ".") for k in range(400)]
    junk = [(1000 + k, " ".join("".join(r.choice("qxzjkvwp") for _ in range(7)) for _ in range(90))) for k in range(12)]
    docs = frame(spark, prose + junk)
    measured = lambda df: quality.measured(df, "m", "text", "lang", None, False)
    bands = quality.fit_bands(measured(docs), "m")
    assert {g for g, _ in bands} == {"en"}
    got = {x["id"]: x["kept"] for x in quality.quality_rules(docs, group_col="lang").collect()}
    assert not any(got[i] for i, _ in junk)
    assert sum(got[i] for i, _ in prose) >= 395
    x = sorted(q["token_entropy"] for q in quality.quality_rules(docs, group_col="lang").collect() if 120 <= q["n_tokens"] < 360)
    low, high = x[len(x) // 4], x[3 * len(x) // 4]
    assert bands["en", 2].entropy_low == pytest.approx(low - 3 * (high - low), abs=0.02)
    assert quality.fit_bands(measured(frame(spark, [])), "m") == {}
    found = [quality.keep_good(docs, group_col="lang", bands=bands)]
    assert "SortMergeJoin" not in found[0]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(quality, "MOST_BANDS", 0)
    found.append(quality.keep_good(docs, group_col="lang", bands=bands))
    assert sorted(r["doc_id"] for r in found[0].collect()) == sorted(r["doc_id"] for r in found[1].collect())
    mixed = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    assert {g for g, _ in quality.fit_bands(measured(mixed), "m")} == {"en", "latin"}
    clashing = docs.withColumnRenamed("source", "m_").withColumnRenamed("n_chars", "group_").withColumnRenamed("score", "a_")
    kept = quality.keep_good(clashing, group_col="lang")
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


# op8


def test_many_batches_split_levels_and_read_only_what_they_hit(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(substring, "BUCKET_ENTRIES", 1)
    t = [x for x in texts() if x and 20 < len(words(x)) < 100]
    index, got, rows = substring.FingerprintIndex(spark, path=f"{tmp_path}/index"), [], []
    for k in range(9):
        batch = [(10 * k + j, t[(3 * k + j) % len(t)] if k % 2 else " ".join(reversed(words(t[(k + j) % len(t)])))) for j in range(2)]
        got += rows_of(index.add(frame(spark, batch)))
        rows += [(k, i, x) for i, x in batch]
    assert sorted(got, key=str) == brute(rows)
    held = index.held
    assert [r.level for r in held.runs] == [1, 1, 0] and max(r.bits for r in held.runs) > 6
    names = [n for n in index.files.names(f"{tmp_path}/index/merged") if index.files.exists(f"{tmp_path}/index/merged/{n}/kind=1")]
    assert names == ["8"]  # merged runs are gone
    # a batch that only hits the last one reads that one's text alone
    for number, path in held.blocks[:-1]:
        index.files.delete(path)
    again = substring.FingerprintIndex(spark, path=f"{tmp_path}/index")
    fresh = " ".join(f"unseen{k}" for k in range(30))
    last = rows[-1][2]
    out = {r["id"]: r["n_removed"] for r in again.add(frame(spark, [(1, fresh), (2, fresh)])).collect()}
    assert out == {1: 0, 2: 30}
    assert last


def test_numbers_of_blocks_have_room(spark):
    from tidefold.llm.exchange import write_blocks

    src = frame(spark, [(1, "a")]).select("doc_id", "text")
    for number in (0, 129, (1 << 27) - 1):
        block = write_blocks(src, {"doc_id": "long", "text": "string"}, number=number).first()["block"]
        assert block >> substring.BATCH_BITS == number


# op9


def test_all_of_a_text_is_compressed():
    tools = classifier.fit([(k, ("good words here " if k % 2 else "bad $$$ signs ") * 40 + str(k), k % 2) for k in range(60)]).tools()
    for n in (1, 100, 1024, 1030, 1279, 1280, 3000):
        t = bytes(np.random.default_rng(n).integers(97, 123, n, np.uint8))
        chunks = [t[a : a + 1024] for a in range(0, n, 1024)]
        g, b = (sum(len(tool.compress(c)) for c in chunks) for tool in tools)
        assert classifier.features(t, tools)[0] == (b - g) / n
        assert classifier.features(t, tools)[3] == min(g, b) / n


def test_long_labelled_texts_and_contradicting_labels(spark):
    rows = [(k, ("fine prose of a calm day " if k % 2 else "BUY!!! $$$ NOW ") * 3000) for k in range(60)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(k, k % 2) for k in range(60)] + [(5, 0), (7, 1)], "doc_id long, quality int")
    used = classifier.fold(classifier.F.col("doc_id"), 3) != 1
    picked = classifier.sample(docs, labels, used, "doc_id", "text", "quality")
    assert {i for i, _, _ in picked} == {k for k in range(60) if k != 5 and __import__("zlib").crc32(str(k).encode()) % 3 != 1}
    assert all(len(t) == classifier.SAMPLE_CHARS for _, t, _ in picked)
    assert all(r["predicted"] == r["id"] % 2 for r in classifier.quality_scores(docs, labels).collect())


# op10


def test_no_pair_is_left_that_repeats_often(spark):
    r = np.random.default_rng(1)
    ids = r.integers(0, 40, 30_000).astype(np.uint32)
    ids[r.integers(0, 30_000, 300)] = repair.STOP
    ids[5000:9000] = 7
    s, rules, lengths = repair.compress(ids)
    assert (repair.expand(s, rules, lengths) == ids).all()
    left = Counter((a, b) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True) if repair.STOP not in (a, b))
    assert max(left.values()) < repair.LEAST_COUNT
    assert not (rules == repair.STOP).any()


def test_documents_are_decoded_alone(spark, tmp_path, lib):
    rows = [(k, t) for k, t in enumerate(texts())]
    repair.write_tokens(frame(spark, rows), f"{tmp_path}/t")
    seen = {}
    for row in spark.read.parquet(f"{tmp_path}/t").collect():
        row = row.asDict()
        for k, i in enumerate(row["doc_ids"]):
            seen[i] = repair.document_ids(row, k).tolist()
    assert seen == {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    s, rules, lengths = repair.compress(np.tile(np.arange(50, dtype=np.uint32), 40))
    few, own, sizes = repair.needed(s[-1:], rules, lengths)
    assert (repair.expand(few, own, sizes) == repair.expand(s[-1:], rules, lengths)).all() and len(own) <= len(rules)


# texts of over a megabyte: each is a block, and a shard, of its own


def test_very_long_texts(spark, lib):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    long_ = " ".join(r.choice(vocabulary) for _ in range(240_000))
    assert len(long_) > 1 << 20
    item = " ".join(f"item{k}" for k in range(30)) + ". the answer is " + " ".join(f"told{k}" for k in range(8)) + "."
    rows = [(1, long_ + " mail a@b.cd"), (2, long_ + " mail a@b.cd x"), (3, long_[: 1 << 19] + " " + item), (4, "short text"), (5, long_)]
    df = frame(spark, rows)
    n = {i: len(words(t)) for i, t in rows}
    near = {x["id"]: (x["component_id"], x["kept"]) for x in minhash.near_duplicates(df).collect()}
    assert near == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (1, False)}
    ids = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {x["id"]: x["n_tokens"] for x in attribution.section_tokens(df).collect()} == ids
    assert {x["doc_id"]: x["n_tokens"] - 1 for x in repair.token_output(df).collect()} == ids
    assert {x["id"]: x["spans"].split(":")[0] for x in pii.find_pii(df).collect() if x["spans"]} == {1: "email", 2: "email"}
    assert [(x["id"], x["item_id"]) for x in decontamination.find_leaks(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()] == [(3, 9)]
    assert {x["id"]: x["n_words"] for x in quality.quality_rules(df).collect()} == n
    got = {x["id"]: (x["n_words"], x["n_removed"]) for x in substring.remove_repeats(df).collect()}
    assert got[1] == (n[1], 0) and got[5] == (n[5], n[5]) and got[4] == (2, 0)
    assert n[2] - got[2][1] == 1 and got[3][1] >= len(words(long_[: 1 << 19])) - 1
    assert {x["id"]: x["n_tokens"] - 1 for x in contextmix.score_texts(df).collect()} == n
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    assert classifier.quality_scores(df, labels).count() == 5


def test_an_encoder_without_room_for_all_runs_gives_the_same(lib, monkeypatch):
    enc = bpe.Encoder(bpe.default_vocabulary(), False)
    monkeypatch.setattr(bpe.Encoder, "BITS", 6)
    enc.reset()
    t = [x for x in texts() if x and len(x) < 1500]
    for part in (t[:3], t, t[5:]):
        ids, count = enc.encode(pa.array(part, pa.large_string()))
        want = [lib.encode(x, add_special_tokens=False).ids for x in part]
        assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_equals_the_library_on_awkward_runs(special_as_text):
    r = random.Random(1)
    parts = ["word", " word", "\n", "  ", "\t", " ", "　", "é", "北京", "'s", "'", "###", "|", "<|endoftext|>", "12", "!", " x", "\r\n", " ", "ñandú", "A", "🙂", "_", "-", "\x0b", "×", "÷", "<", " 7", "Ā"]
    t = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    plain, enc = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Encoder(bpe.default_vocabulary(), special_as_text)
    plain.encode_special_tokens = special_as_text
    ids, count = enc.encode(pa.array(t, pa.large_string()))
    want = [plain.encode(x, add_special_tokens=False).ids for x in t]
    assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
