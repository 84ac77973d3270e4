"""The pipeline's stages one by one, each against its own input, and as a whole."""

from collections import Counter

import corpus_pipeline as P

from .test_ops import brute_words, docs, near_rows, odd

SF = "/root/testdata/sf0.001"


def run_stages(spark, start, tmp):
    out = [start]
    for name, f in P.STAGES:
        f(spark, out[-1], SF).write.parquet(f"{tmp}/{name}")
        out.append(spark.read.parquet(f"{tmp}/{name}"))
    return out


def test_stages(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = run_stages(spark, d, str(tmp_path))
    assert all(x.columns == d.columns for x in out[1:-1])
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in out]
    assert ids[1] == ids[0]  # all have a language
    assert ids[2] <= ids[1]
    text = {r.doc_id: r.text for r in d.collect()}
    # every exact copy but one is gone, and each text that went is near one that stayed
    assert len({text[i] for i in ids[2]}) == len(ids[2])
    kept = [set(brute_words(text[i])) for i in ids[2]]
    for i in ids[1] - ids[2]:
        w = set(brute_words(text[i]))
        assert max(len(w & k) / max(1, len(w | k)) for k in kept) > 0.7
    # decontamination: by brute force
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = brute_words(r.text)
        k = min(8, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    dirty = {i for i in ids[2] if any(tuple(w[j : j + 8]) in windows for w in [brute_words(text[i])] for j in range(len(w)))}
    assert set(ids[3]) == set(ids[2]) - dirty
    assert max(ids[4].values()) <= 2 and set(ids[4]) <= set(ids[3])
    assert ids[5] == ids[4]
    sizes = Counter(r.shard for r in out[5].select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run_equals_stages(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = run_stages(spark, d, str(tmp_path))[-1]
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, want.collect()))


def test_odd_documents(spark, tmp_path):
    start = odd(spark).select("doc_id", "text", "lang", "source", "n_chars").union(
        docs(spark, near_rows(30)).select("doc_id", "text", "lang", "source", "n_chars")
    )
    out = run_stages(spark, start, str(tmp_path))
    assert all(x.columns == start.columns for x in out[1:-1])
    empty = run_stages(spark, start.limit(0), str(tmp_path / "empty"))
    assert [x.count() for x in empty] == [0] * 6
