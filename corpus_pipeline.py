"""From raw documents to token ids: quality rules, near duplicates, benchmark leaks, PII, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``.

Defined results: documents with null or empty text fail the quality rules and go there; null
ids, languages and sources are carried along (a null source is a host of its own). Texts of any
length are read whole. Rows that repeat an id and its text count once from the second stage on;
of equal and near-equal texts the lowest id stays. An empty table gives an empty one. Further
columns are carried along, also those named like a column that an operator uses, but for
``pii_spans``, which the fourth stage takes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.llm import decontam, ngram_join, pii, quality_rules, sp_codec
from strandline.llm.storage import Scratch


def _measured(docs):
    """``n_chars`` follows the text where a stage changed it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark, docs, sf_dir):
    """Lines above the host's limits go, and with them documents that fail the rules."""
    return _measured(quality_rules.clean(docs))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark, docs, sf_dir):
    """Personal data is replaced by its kind."""
    return _measured(pii.scan(docs, masked="text").drop("pii_spans"))


def encode(spark, docs, sf_dir):
    """Token ids in place of the text."""
    import public_tokenizers

    return sp_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("pii", mask_pii), ("sentencepiece", encode)]
#: SimHash lookup and the vocabulary's merges are not SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            before = list(scratch.names)
            docs = scratch.table(docs, name)
            scratch.drop(*before)  # nothing reads the stage before again
    return docs
