import hashlib

from tidefold.llm import substring

from .cases import frame, texts, words


def brute(rows, window=13):
    """First seen wins: rows are (rank, id, text) and rank orders batches."""
    first = {}
    for rank, i, t in rows:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (rank, i)), (rank, i))
    out = []
    for rank, i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < (rank, i):
                    gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_one_batch_matches_brute_force(spark):
    rows = list(enumerate(texts()))[::-1] + [(None, texts()[6]), (7, texts()[6])]
    got = rows_of(substring.remove_repeats(frame(spark, rows).repartition(3)))
    want = brute([(0, i, t) for i, t in rows])
    assert got == want
    assert sum(r[2] for r in got) > 200


def test_batches_are_judged_against_the_index(spark):
    t = texts()
    batches = [list(enumerate(t))[k::6] for k in range(6)]
    index = substring.FingerprintIndex(spark)
    got = []
    for b in batches:
        got += rows_of(index.add(frame(spark, b).repartition(2)))
        index = substring.FingerprintIndex(spark, path=index.path)  # as another process would open it
        assert len(index.held.runs) <= substring.MOST_RUNS
    want = brute([(k, i, x) for k, b in enumerate(batches) for i, x in b])
    assert sorted(got, key=str) == want


def test_empty_table_and_texts(spark):
    assert rows_of(substring.remove_repeats(frame(spark, []))) == []
    out = substring.remove_repeats(frame(spark, [(1, "a b c"), (2, None)]), texts=True).collect()
    assert {(r["id"], r["kept_text"]) for r in out} == {(1, "a b c"), (2, "")}
