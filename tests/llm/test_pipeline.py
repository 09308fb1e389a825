"""The pipeline's stages against brute force, each on what the one before kept."""

from collections import Counter

import corpus_pipeline as C
from strandloom.llm import exact_dedup, perplexity, simhash, vocab  # noqa: F401
from strandloom.llm.common import written

from .test_dedup import brute_near, lower

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    good = written(C.good_text(spark, docs, SF), "t")
    verdict = {r.doc_id: r.kept for r in perplexity.classify(docs, perplexity.trusted_labels(spark, SF)).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, k in verdict.items() if k)
    exact = written(C.no_copies(spark, good, SF), "t")
    best = {}
    for r in good.collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(best.values())
    near = written(C.no_near_copies(spark, exact, SF), "t")
    group = brute_near([(r.doc_id, r.text) for r in exact.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({min(g) for g in group.values()})
    mixed = written(C.mixed(spark, near, SF), "t")
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    out = C.packed(spark, mixed, SF).collect()
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert sum(r.length for r in out) == sum(len(x) + 1 for x in vocab.encode(path, [r.text for r in mixed.collect()]))
    assert sum(r.piece == 0 for r in out) == mixed.count()


def test_empty_table_passes(spark, none):
    docs = none
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), "t")
    assert docs.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert exact_dedup and simhash
