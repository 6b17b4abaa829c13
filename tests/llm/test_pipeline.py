import zlib

from tokenizers import Tokenizer

import corpus_pipeline
from tidefold.llm import bpe, mixing, quality

from .cases import frame, texts, words
from .test_minhash import brute


def test_stages_match_brute_force(spark, tmp_path):
    t = texts()
    item = " ".join(t[16].split()[100:130]) + ". " + " ".join(t[16].split()[130:140]) + "."
    rows = list(enumerate(t)) + [(200, t[30] + " " + " ".join(t[16].split()[200:260]) + " " + item), (None, " ".join(t[16].split()[300:360]))]
    docs = frame(spark, rows).drop("id", "score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]
    steps, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "tokens":
            assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = [r.asDict() for r in now.collect()]

    judged = {(r["id"], r["n_words"]): r["kept"] for r in quality.quality_rules(frame(spark, rows)).collect()}
    good = [(i, x) for i, x in rows if judged[i, len(words(x))]]
    assert sorted((r["doc_id"], r["text"]) for r in steps["quality"] if r["doc_id"] is not None) == sorted((i, x) for i, x in good if i is not None)

    groups = brute(good, 5, 80)
    first = sorted(i for i, (_, c) in groups.items() if i == c)
    assert sorted(r["doc_id"] for r in steps["near_dedup"] if r["doc_id"] is not None) == first
    assert sum(r["doc_id"] is None for r in steps["near_dedup"]) == sum(i is None for i, _ in good)

    # the item is part of documents 16 and 200, and of no other
    assert {r["doc_id"] for r in steps["near_dedup"]} - {r["doc_id"] for r in steps["decontamination"]} == {16, 200} & set(first)

    left = spark.createDataFrame([tuple(r.values()) for r in steps["decontamination"]], docs.schema)
    times = {r["id"]: r["times"] for r in mixing.mix_sources(left).collect()}
    mixed = [r for r in steps["decontamination"] for _ in range(times[r["doc_id"]])]
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    assert sorted(steps["mixing"], key=key) == sorted(mixed, key=key)

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    start, want = 0, []
    for r in sorted(mixed, key=key):
        ids = [*lib.encode(r["text"], add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted((tuple(r.values()) for r in steps["tokens"]), key=lambda r: r[1]) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)
