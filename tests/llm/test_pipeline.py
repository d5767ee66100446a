"""The pipeline against a plain Python version of its filtering stages."""

import pandas as pd

import corpus_pipeline
from strandlake.llm import decontamination, ngram_join, quality
from strandlake.llm.common import materialize

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "pii", "mixing"]
    raw = pd.read_parquet(f"{DATA}/documents.parquet")
    judged = [quality.judge(t) for t in raw.text]
    own = {i: j[10] for i, j in zip(raw.doc_id, judged, strict=True) if j[9]}
    kept = materialize(corpus_pipeline.quality_rules(spark, docs, DATA), "t")
    assert {r.doc_id: r.text for r in kept.collect()} == own

    sets = {i: ngram_join.shingle_set(t, 5) for i, t in own.items()}
    root = {i: i for i in own}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((of(i), of(j)))
                root[b] = a
    single = materialize(corpus_pipeline.near_duplicates(spark, kept, DATA), "t")
    assert sorted(r.doc_id for r in single.collect()) == sorted({of(i) for i in ids})

    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    parts = [decontamination.parts_of(t) for t in items.text]
    leaks = {i for i in ids if any(all(decontamination.overlap(p, decontamination.words_of(own[i])) >= 0.5 for p in two) for two in parts)}
    clean = materialize(corpus_pipeline.decontaminate(spark, single, DATA), "t")
    assert sorted(r.doc_id for r in clean.collect()) == sorted({of(i) for i in ids} - leaks)

    private = materialize(corpus_pipeline.pseudonymize(spark, clean, DATA), "t")
    assert private.columns == docs.columns and private.count() == clean.count()
    mixed = corpus_pipeline.mix_sources(spark, private, DATA)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().filter("count > 2").count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
