"""A corpus pipeline over ``documents``: toxic documents go, one document of each group of near copies stays, repeated passages
go, sources are mixed to target weights, and the result is packed into windows of tokens.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir), and its result is written and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import jaccard_join, mixing, packing, repeats, toxicity
from docweft.llm.common import cut, held_out
from docweft.llm.queries import byte_bpe, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go; it learns from the labels of ``docs`` that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 0))
    return toxicity.keep_clean(docs, toxicity.train(labels, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a similarity of 0.8 or more of their five-word shingles, that with the least id stays."""
    return jaccard_join.keep_one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that also stand in a document with a smaller id go; n_chars follows the text."""
    return repeats.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, or taken several times, so that sources weigh 5, 2 and 1 in turn."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: the pieces of documents with their token ids."""
    return packing.pack_documents(docs, *byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL can't express the learnt stages; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "zstd")
    return docs
