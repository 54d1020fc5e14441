"""The pipeline's stages against what each must keep and change."""

from __future__ import annotations

import numpy as np
import public_tokenizers

import corpus_pipeline
from tessella.llm import byte_bpe, decontaminate, quality, secrets
from tessella.llm.queries import BYTES

from test_near_copies import brute_kept


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            out = out.cache()
        if name == "quality_filter":
            assert ids(out) == ids(quality.scores(docs, labels).where("predicted = 1"))
        elif name == "near_dedup":
            # the stage's own contract: five words, a similarity of 0.8 or more, every link
            assert [(False, i) for i in ids(out)] == sorted(brute_kept([(r.doc_id, r.text) for r in docs.collect()]))
        elif name == "decontamination":
            assert ids(out) == ids(decontaminate.contamination(docs, items).where("n_hit = 0"))
        elif name == "secret_redaction":
            assert ids(out) == ids(docs)
            assert secrets.digests(out).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            made = {r.doc_id: r for r in out.collect()}
            assert sorted(made) == ids(docs)
            coder = byte_bpe.ByteBpe(public_tokenizers.path(BYTES), public_tokenizers.PATTERN)
            for r in docs.collect():
                assert made[r.doc_id].text == (r.text or "") and coder.decode(np.frombuffer(made[r.doc_id]["ids"], np.uint32)) == (r.text or "").encode()
        docs = out


def test_empty(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
