"""The corpus pipeline against a brute-force version of its stages, and the
registration of the package's queries."""

import sys

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm.quality_rules import apply_rules
from test_llm_dedup import brute_components, brute_leaks, brute_removal

SF = "/root/testdata/sf0.001"


def brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in apply_rules(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    stay = {c for _, _, c in brute_components(rows)}
    rows = sorted(r for r in rows if r[0] in stay)
    cut = {i: (n, g, k) for i, n, g, k in brute_removal(rows, 50)}
    rows = [(i, cut[i][2] if cut[i][1] else t) for i, t in rows if not cut[i][1] or cut[i][1] < cut[i][0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # only documents that share a five-word shingle can be contaminated
    from ledgerlens.llm.decontamination import shingles, words_of
    grams = {g for _, t in items for g in shingles(words_of(t))}
    near = [r for r in rows if grams & set(shingles(words_of(r[1])))]
    leaks = {d for d, _ in brute_leaks(near, items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: sp.encode(t) for i, t in rows if i not in leaks}


def test_run_matches_brute_force(spark):
    out = corpus_pipeline.run(spark, SF)
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert got == brute(spark, SF)
    assert len(got) < 200


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
    nulls = docs.limit(3).withColumn("text", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, nulls, SF).collect()


def test_every_operator_has_its_query():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


def test_the_rest_does_without_the_package(monkeypatch):
    import importlib.util

    import __spark_entry__ as E
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda m, *a: None if m == "corpus_pipeline" else real(m, *a))
    assert not any(q.startswith("op") and "_" in q and q[2].isdigit() for q in E.queries())
    assert "pipeline" not in E.oracle_sql() and "customer_table" in E.queries()
    assert "ledgerlens" in sys.modules
