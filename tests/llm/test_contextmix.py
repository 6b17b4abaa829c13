import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidefold.llm import contextmix as cm

from .cases import frame, lower, texts, words


def held(i, folds=7, fold=2):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def learnt(i):
    return i is not None and not held(i)


def cases():
    t = texts()
    return list(enumerate(t + t[6:9] + [t[15]])) + [(None, "ab cd"), (3, "one"), (900, t[22])]


def test_base_scores_match_brute_force_and_bits_are_a_distribution(spark):
    rows = cases()
    got = cm.score_texts(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    seen = Counter()
    for i, t in rows:
        if learnt(i):
            seen.update(words(lower(t)))
            seen["\n"] += 1
    total, distinct = sum(seen.values()), len(seen)
    for i, t in rows:
        w = [*words(lower(t)), "\n"]
        base = sum(math.log10((seen[x] + 1) / (total + distinct + 1)) for x in w)
        mine = [r for r in got if r["id"] == i and r["n_tokens"] == len(w) and abs(r["base_score"] - base) < 1e-6 * max(1, -base)]
        assert mine, (i, t)
        assert mine[0]["n_known"] == sum(seen[x] > 0 for x in w)
        assert mine[0]["held_out"] == held(i)
        assert mine[0]["train_tokens"] == total
        size = sum(len(x.encode()) + 1 for x in w)
        assert -(size * 8 * 16 + 16 * len(w) + 10) * math.log10(2) <= mine[0]["score"] < 0


# the whole model once more, bit by bit in plain Python; only its hashes are taken from the module


def spelt(word):
    return b"\n" if word == "\n" else word.encode() + b" "


def hashed(word, kind):
    """The contexts of each byte of a word."""
    data = spelt(word)
    s = cm.Spelling(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.array([kind], np.uint8), np.zeros(1, np.uint8))
    return s.ctx[:, s.which].T.tolist()


def quantised(n):
    if n < 64:
        return n
    return 64 * 2 ** (min(round(math.log2(n / 64) * 8), 191) / 8)


class Brute:
    def __init__(self, rows, state, piece_bits, slot_bits):
        self.piece_bits, self.slot_bits = piece_bits, slot_bits
        size = 2 * (cm.ORDERS + 1) * 8 * 64
        self.weights = np.array(state[:size]).reshape(2, cm.ORDERS + 1, 512).astype(np.float32)
        self.map = np.array(state[size:]).reshape(2, 8, cm.MAP_CELLS)
        tokens = Counter()
        for i, t in rows:
            if learnt(i):
                tokens.update((kind_of(t), w) for w in [*words(lower(t)), "\n"])
        nodes = defaultdict(lambda: [0, 0])
        for (kind, w), n in tokens.items():
            for byte, ctx in zip(spelt(w), hashed(w, kind), strict=True):
                for o, c in enumerate(ctx):
                    for k in range(8):
                        nodes[c, k, byte >> (8 - k)][byte >> (7 - k) & 1] += n if o != 3 else 0
                # the word so far is counted once over all classes
                for k in range(8):
                    nodes[ctx[3], k, byte >> (8 - k)][byte >> (7 - k) & 1] += n
        self.slots = {}
        for (c, k, known), (n0, n1) in nodes.items():
            slot, check = self.slot(c, k, known)
            if (n0 + n1, check) > self.slots.get(slot, (0, 0, 0, 0))[:2]:
                self.slots[slot] = (n0 + n1, check, n0, n1)

    def slot(self, ctx, k, known):
        byte = np.array([known << (8 - k)], np.uint64)
        first, check = cm._groups(np.array([ctx], np.uint64), cm._half(byte, k), self.piece_bits, self.slot_bits)
        return int(first[0] ^ cm._place(byte, k)[0]), int(check[0])

    def word(self, w, kind, left_out):
        total = 0.0
        for byte, ctx in zip(spelt(w), hashed(w, kind), strict=True):
            for k in range(8):
                bit, x, level = byte >> (7 - k) & 1, [], []
                for c in ctx:
                    slot, check = self.slot(c, k, byte >> (8 - k))
                    _, own, n0, n1 = self.slots.get(slot, (0, 0, 0, 0))
                    n0, n1 = (quantised(n0), quantised(n1)) if own == check else (0, 0)
                    n0, n1 = max(n0 - left_out * (1 - bit), 0), max(n1 - left_out * bit, 0)
                    x.append(math.log((n1 + 0.3) / (n0 + 0.3)))
                    level.append(min(int(math.log2(n0 + n1 + 1)), 7))
                gates = (k * 64 + level[4] * 8 + level[3], k * 64 + level[2] * 8 + level[1])
                z = sum((self.weights[0, o, gates[0]] + self.weights[1, o, gates[1]]) * v for o, v in enumerate([*x, 1.0]))
                z = min(max(z, -11), 11)
                said = [(self.map[0, k, m] + 30 / (1 + math.exp(11 - m * 22 / 32))) / (self.map[1, k, m] + 30) for m in range(33)]
                pos = (z + 11) * 32 / 22
                low = min(int(pos), 31)
                p = 0.5 / (1 + math.exp(-z)) + 0.5 * (said[low] * (1 - pos + low) + said[low + 1] * (pos - low))
                p = min(max(p, 2**-16), 1 - 2**-16)
                total += math.log10(p if bit else 1 - p)
        return total


def kind_of(t):
    return int(cm.Tokens(pa.array([t], pa.large_string())).kind[0])


def short(w):
    return int(cm.END if w == "\n" else cm.Tokens(pa.array([w], pa.large_string())).hash[0]) >> 48


def guesses(rows):
    """For each row: per token (key, true?) or None."""
    after = defaultdict(Counter)
    for i, t in rows:
        w = [*words(lower(t)), "\n"]
        if learnt(i):
            for k in range(3, len(w)):
                after[tuple(w[k - 3 : k])][w[k]] += 1
    for i, t in rows:
        w, out, past = [*words(lower(t)), "\n"], [], []
        for k in range(len(w)):
            found = None
            if k >= 3:
                c = after[tuple(w[k - 3 : k])]
                two = sorted(c.items(), key=lambda e: (-e[1], short(e[0])))[:2]
                own = int(learnt(i))
                left = [(n - own * (f == w[k]), f) for f, n in two]
                total = sum(c.values()) - own
                if left:
                    n, f = left[1] if len(left) > 1 and left[1][0] > left[0][0] else left[0]
                    if n > 0:
                        run = 0
                        while run < len(past) and past[-1 - run] == 2:
                            run += 1
                        hist = sum(3 ** (j - 1) * past[-j] for j in range(1, 5) if j <= len(past))
                        level = min(n.bit_length(), 8) - 1
                        pure = (2 * n >= total) + (4 * n >= 3 * total) + (n >= total)
                        found = (((level * 4 + pure) * 8 + min(run.bit_length(), 7)) * 81 + hist, f == w[k])
            past.append(0 if found is None else 1 + found[1])
            out.append(found)
        yield out


def test_scores_match_a_model_bit_by_bit(spark, monkeypatch):
    rows, seen = cases(), {}
    spell, flags, finish = cm._spell, cm.fit_flags, cm._finish
    monkeypatch.setattr(cm, "_spell", lambda model, state, bits: seen.update(state=state, bits=bits, slots=len(model.value).bit_length() - 1) or spell(model, state, bits))
    monkeypatch.setattr(cm, "fit_flags", lambda counts: seen.update(counts=counts, p=flags(counts)) or seen["p"])
    monkeypatch.setattr(cm, "_finish", lambda f, kinds: seen.update(kinds=kinds) or finish(f, kinds))
    got = cm.score_texts(frame(spark, rows).repartition(2)).collect()
    brute = Brute(rows, seen["state"], seen["bits"], seen["slots"])
    counts, want, known = np.zeros((2, cm.FLAG_KEYS)), [], {}
    for (i, t), found in zip(rows, guesses(rows), strict=True):
        kind, score = kind_of(t), float(seen["kinds"][kind_of(t)])
        for w, g in zip([*words(lower(t)), "\n"], found, strict=True):
            if g is not None:
                score += math.log10(seen["p"][g[0]] if g[1] else 1 - seen["p"][g[0]])
                counts[int(g[1]), g[0]] += learnt(i)
            if g is None or not g[1]:
                key = (w, kind, int(learnt(i)))
                if key not in known:
                    known[key] = brute.word(*key)
                score += known[key]
        want.append((i if i is not None else -1, len(found), score))
    assert (counts == seen["counts"]).all() and counts[1].sum() > 500
    mine = sorted((r["id"] if r["id"] is not None else -1, r["n_tokens"], r["score"]) for r in got)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-4)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    df = frame(spark, [(i, t) for i, t in cases() if i is not None])
    a, b = (sorted((r["id"], r["n_tokens"], round(r["score"], 6)) for r in cm.score_texts(df.repartition(n)).collect()) for n in (1, 5))
    assert a == b


def test_model_is_better_than_the_base_on_held_out_documents(spark):
    got = cm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_documents_that_occur_twice_are_told_apart(spark):
    t = [x for x in texts()[23:] if len(words(x)) > 30]
    ids = [i for i in range(1000, 1100) if learnt(i)]
    once, twice = list(enumerate(t[2:])), list(zip(ids, [t[0], t[1], t[0], t[1]], strict=False))
    got = {r["id"]: r["bits_per_byte"] for r in cm.score_texts(frame(spark, once + twice)).collect()}
    assert max(got[i] for i, _ in twice) < min(got[i] for i, _ in once)


def test_nothing_to_learn_from(spark):
    assert cm.score_texts(frame(spark, [])).count() == 0
    row = cm.score_texts(frame(spark, [(None, "a b")])).first()
    assert row["train_tokens"] == 0
    assert row["bits_per_byte"] == pytest.approx(8.0)
