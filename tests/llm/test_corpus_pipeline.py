"""The pipeline's stages on the smallest tables, each against plain Python on what the stage before it kept."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
from turnlake.llm import quality_crf
from turnlake.llm.shared import staged

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SMALL))
        kept[name] = docs.toPandas()
        assert name == "encoding" or docs.columns == before.columns
    start = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().set_index("doc_id")["text"]
    field = quality_crf.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(kept["quality"]["doc_id"]) == {d for d, t in start.items() if field.quality(t) >= quality_crf.THRESHOLD}
    texts = kept["near_dedup"].groupby("text")["doc_id"].count()
    assert (texts == 1).all() and set(kept["near_dedup"]["doc_id"]) <= set(kept["quality"]["doc_id"])
    assert sorted(kept["secrets"]["doc_id"]) == sorted(kept["near_dedup"]["doc_id"])
    clean = kept["secrets"].set_index("doc_id")["text"]
    mixed = kept["mixing"]
    for d, t in zip(mixed["doc_id"], mixed["text"], strict=True):
        own = WORD.findall(clean[d])
        got = WORD.findall(t)
        assert t == clean[d] or len(got) <= len(own) and set(got) <= set(own)
    assert abs(sum(len(WORD.findall(t)) for t in mixed["text"]) - 1.5 * sum(len(WORD.findall(t)) for t in clean)) <= 50
    digests = sorted(hashlib.sha256(t.encode()).hexdigest() for t in mixed["text"])
    assert sorted(kept["encoding"]["decoded_sha256"]) == digests
