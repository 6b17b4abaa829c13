from tidefold.llm import minhash

from .cases import frame, lower, texts, words


def sets(t, k):
    w = words(lower(t))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute(rows, k, percent):
    s = {}
    for i, t in rows:
        if i is not None:
            s.setdefault(i, sets(t, k))
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def check(spark, rows, k, percent):
    got = minhash.near_duplicates(frame(spark, rows).repartition(3), shingle=k, percent=percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, k, percent)
    for r in got:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]]
            assert r["kept"] == (r["id"] == r["component_id"])


def test_both_settings_match_brute_force(spark):
    rows = list(enumerate(texts()))[::-1] + [(None, texts()[6])]
    check(spark, rows, 3, 85)
    check(spark, rows, 5, 80)


def test_large_group_of_near_copies(spark):
    base = texts()[6].split()
    rows = [(i, " ".join(base[:80] + [f"n{i}", f"m{i}"])) for i in range(60)] + [(100, "other words entirely " * 5)]
    check(spark, rows, 5, 80)


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
