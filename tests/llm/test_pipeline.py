"""The pipeline, stage by stage, against brute force on a small table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweft.llm import mixing, queries, toxicity
from docweft.llm.common import held_out

from . import data
from .test_operators import brute_links, brute_repeats
from .test_packing import check


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = data.documents(spark, unique=True).select("doc_id", "text", "lang", "source", "n_chars")
    bad = F.col("doc_id") % 7 == 3
    docs = docs.withColumn("text", F.when(bad & F.col("text").isNotNull(), F.concat("text", F.lit(" you utter grubhead and vilethug"))).otherwise(F.col("text")))
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), bad.cast("int").alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tables):
    docs = queries.table(spark, tables, "documents")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    whole = {r.doc_id: r.text for r in docs.collect()}

    clean = stages[names[0]](spark, docs, tables).cache()
    lexicon = toxicity.train(queries.table(spark, tables, "labels").filter(~held_out(F.col("doc_id"), 0)), docs)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k, s in scores.items() if s < 0.5)
    assert not [k for k in scores if (scores[k] >= 0.5) != (k % 7 == 3 and whole[k] is not None)]

    single = stages[names[1]](spark, clean, tables).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, c, _ in brute_links(clean.collect()) if d == c)

    cut = stages[names[2]](spark, single, tables).cache()
    want = [(d, k if g else whole[d]) for d, _, g, k in brute_repeats(single.collect()) if k or not g]
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(want, key=str)

    mixed = stages[names[3]](spark, cut, tables).cache()
    copies = Counter({r.doc_id: r["copies"] for r in mixing.mix(cut).collect() if r["copies"]})
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    for out in (clean, single, cut, mixed):
        assert out.columns == docs.columns
    check(mixed, stages[names[4]](spark, mixed, tables).collect(), [r.text for r in mixed.collect()])


def test_stages_take_odd_rows(spark, tables, tmp_path):
    """Repeated rows, equal and missing ids, nulls, further columns with clashing names, and empty tables go through each stage."""
    odd = data.documents(spark)
    for docs in (odd, data.empty(spark)):
        at = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, tables)
            if name == "packing":
                assert (out.count() > 0) == (at.count() > 0)
                continue
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{docs.schema is odd.schema}-{k}-{id(docs)}")
            at = spark.read.parquet(f"{tmp_path}/{docs.schema is odd.schema}-{k}-{id(docs)}")
            assert at.count() <= 3 * docs.count()
            if docs is odd:
                assert at.filter("text is not null").count() > 0, name


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][1:] == ["n-gram jaccard join", "substring dedup", "mixing sources to target weights", "packing"]


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    monkeypatch.setitem(sys.modules, "docweft.llm", None)
    monkeypatch.delitem(sys.modules, "docweft.llm.queries", raising=False)
    bare = importlib.reload(__spark_entry__)
    assert "pipeline" not in bare.queries() and "dedup_fingerprint" in bare.queries() and set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
