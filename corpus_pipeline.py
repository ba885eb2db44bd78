"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read again by the next.

``toxicity`` drops documents scored toxic, ``near_duplicates`` keeps one document of each SimHash group,
``decontamination`` drops documents that hold a benchmark item, ``secrets`` replaces secrets in texts, and ``packing`` cuts
and packs what is left into training sequences. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontamination import drop_contaminated
from plumbline.llm.packing import pack_documents
from plumbline.llm.secrets import redact
from plumbline.llm.simhash import one_of_each
from plumbline.llm.store import keep, unused
from plumbline.llm.toxicity import fit_toxicity, labelled_texts, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from the labelled ones scores below one half.

    Null and empty texts are scored as empty and stay; without labels of both kinds among the documents nothing is
    learned and every document stays unless all labels are toxic. Repeated rows are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_toxicity(labelled_texts(docs, labels))
    score = unused("toxicity_score", docs.columns)
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, or with none if no row of the group has one.

    Exact repeats of a row are one document; rows of one id with different texts are documents of their own. Null and
    empty texts are copies of each other.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of no benchmark item's five-word shingles; null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by ``[secret]``, and ``n_chars`` follows. Null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens with its sequence and place; null texts count as empty."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_copies),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The first and last stages are learned models and a tokenizer, which SQL can't express; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
