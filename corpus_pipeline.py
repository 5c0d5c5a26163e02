"""A corpus pipeline of five stages, each one operator over all documents its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
reads it back as the next stage's docs, after which what came before is removed. All but the last return the columns of
documents, whatever further ones there are and however they are named. An empty table passes through all stages.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, mixing, ngram_join, quality_classifier, quality_rules
from quillon.llm.common import discard, materialize, table
from quillon.llm.queries import DOMAIN_WEIGHTS, tokenizer_path


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a risk-controlled cutoff go: a null or empty text is too short, a null lang a stratum
    of its own. Repeated rows go or stay together."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the pairwise ranking predicts bad go; one whose score ties with the cut stays. Without labels of both kinds all stay."""
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity 0.8: the least doc_id of each group stays, once if its row is repeated. Documents
    without an id cannot be named and stay; texts without words are near none."""
    return ngram_join.one_of_each(docs, size=5, threshold=Fraction(4, 5))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that languages have their target shares of tokens; none goes. Null texts count no tokens and
    stay once; equal rows are repeated alike."""
    return mixing.mix_rows(docs, docs.select("text", F.col("lang").alias("domain")), DOMAIN_WEIGHTS, floor=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to; a null text is an empty one."""
    import public_tokenizers

    return bpe.tokenized(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id", "lang", "source")


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("mixing to target weights", mix_languages),
    ("byte-level BPE", encode),
]

#: No SQL states the result: classifiers are fitted and near duplicates joined. Tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, given = table(spark, sf_dir, "documents"), True
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.split()[0])
        if not given:
            discard(before)
        given = False
    return docs
