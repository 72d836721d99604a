from collections import Counter

import corpus_pipeline
from tests.llm import test_line_dedup, test_minhash_dedup, test_substring_dedup, test_tokens


def test_each_stage_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_dedup", "substring_dedup", "packing"]
    results = {}
    for name, stage in stages.items():
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        results[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], docs)
        if name != "packing":
            assert docs.columns == columns
    toxic, left = results["toxicity"]
    assert 0.8 * len(toxic) < left.count() <= len(toxic)
    rows, out = results["line_dedup"]
    import hashlib

    assert sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()) == [(i, h) for i, _, _, h in sorted(test_line_dedup.brute(rows))]
    rows, out = results["minhash_dedup"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in test_minhash_dedup.brute(rows, 5, 80).elements() if r[3])
    rows, out = results["substring_dedup"]
    kept = {i: h for i, _, _, h in test_substring_dedup.brute(rows)}
    assert {r["doc_id"]: hashlib.sha256(" ".join(test_substring_dedup.WORD.findall(r["text"])).encode()).hexdigest() for r in out.collect()} == kept
    rows, out = results["packing"]
    test_tokens.check_pieces(out.collect(), rows)


def test_awkward_documents(docs, no_docs, spark, tmp_path):
    for name, df in (("all", docs), ("none", no_docs)):
        folder = f"{tmp_path}/{name}"
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in out} == ({None, 3, 10, 12, 13, 14, 15, 16, 17, 18, 19, 21, 22, 23, 24, 25} if name == "all" else set())
