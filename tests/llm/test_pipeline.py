"""The pipeline's stages on a small corpus with planted cases, and the registry with the subpackage."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
from obsmill.llm import packing


def corpus(tmp_path, spark):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, prose(120) + (" idiot moron scum" if i % 5 == 0 else ""), "en", "src0") for i in range(300)]
    passage = prose(70)
    rows += [(1000, rows[1][1], "en", "s"), (1001, rows[2][1] + " tail", "en", "s"), (1002, prose(60) + " " + passage, "en", "s"), (1003, passage + " " + prose(60), "en", "s"), (1004, "my password: Zk83hfQ9xx end of it", "en", "s"), (1005, None, "en", "s"), (1006, "", "en", "s")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {r[0]: r[1] for r in rows}, passage


def test_stages_take_effect(spark, tmp_path):
    texts, passage = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert list(seen) == ["toxicity", "n-gram Jaccard join", "substring dedup", "secret scans"]
    clean = {i for i in texts if i >= 300 or i % 5}
    assert seen["toxicity"].keys() <= clean and len(seen["toxicity"]) >= 0.98 * len(clean) and {1, 2, 1000, 1001, 1002, 1003, 1004} <= seen["toxicity"].keys()
    assert set(seen["toxicity"]) - set(seen["n-gram Jaccard join"]) == {1000, 1001}
    assert passage in seen["substring dedup"][1002] and len(seen["substring dedup"][1003]) < len(texts[1003]) - len(passage) // 2
    assert seen["secret scans"][1004] == "my [SECRET] end of it" and seen["secret scans"][1005] is None and seen["secret scans"][7] == texts[7]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in seen["secret scans"].items():
        ids = [x for r in sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["piece"]) for x in r["ids"]]
        assert ids == tok.encode(t or "", add_special_tokens=False).ids + [0]


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert {"op2_ngram_jaccard_join", "op6_url_filters", "op9_embedding_near_dedup"} <= set(__spark_entry__.oracle_sql())
