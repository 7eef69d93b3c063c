"""The pipeline's rows against a plain version of each stage."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm.common import Memo, held_out
from tests.llm.test_results import SF, _brute_classes


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r for r in documents.collect()}

    weights, memo, bits = quality.fit(documents, labels, use=~held_out()), Memo(), quality.Settings().bits
    dot = lambda at, x: float(weights[at] @ x)
    kept = {i: r for i, r in kept.items() if 1 / (1 + np.exp(-dot(*quality.features(r["text"], bits, memo)))) >= 0.5}

    texts = {i: r["text"] for i, r in sorted(kept.items())}
    classes = _brute_classes(texts, words=True)
    kept = {i: r for i, r in kept.items() if classes[i] == i}
    kept = {i: r for i, r in kept.items() if not any(item in r["text"] for item in items)}

    decided = {r["doc_id"]: r["kept"] for r in mixing.mix(spark.createDataFrame(list(kept.values()), documents.schema)).collect()}
    kept = {i: r for i, r in kept.items() if decided[i]}

    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(kept)
    shards, slots = defaultdict(set), defaultdict(list)
    for r in out:
        assert tuple(r[c] for c in documents.columns) == tuple(kept[r["doc_id"]])
        assert r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        shards[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
