"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import bpe_digests
from quillon.llm.common import table
from quillon.llm.embedding_dedup import embedding_dedup
from quillon.llm.html_extract import html_extract
from quillon.llm.mixing import mix
from quillon.llm.ngram_join import ngram_components
from quillon.llm.plane_ids import token_files
from quillon.llm.prefix_trie import prefix_trie
from quillon.llm.quality_classifier import quality_classifier
from quillon.llm.quality_rules import quality_rules
from quillon.llm.token_alignment import alignment_digests
from quillon.llm.token_counts import token_counts
from quillon.llm.url_filter import url_filter
from quillon.llm.warc import warc_round_trip

#: Rules of op3: (verdict, host and path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Domains of op9 and their shares of tokens.
DOMAIN_WEIGHTS = {"en": 0.6, "fr": 0.15, "de": 0.14, "es": 0.11}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), size=3, threshold=Fraction(9, 10))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labelled = documents.select("text", documents.lang.alias("domain"))
    return mix(documents.select("doc_id", "text"), labelled, DOMAIN_WEIGHTS)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents in bit-plane shuffled files: a null text has the end id alone."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over the bytes of documents: zeros for null, empty and unspelled texts."""
    return alignment_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_bpe, op3_url_filter, op4_quality_classifier, op5_token_counts,
        op6_html_extract, op7_warc, op8_quality_rules, op9_mixing, op10_embedding_dedup, op11_token_files, op12_token_alignment, op13_prefix_trie,
    )
}

#: The others have no SQL twin: fitted models, joins too slow in SQL on whole tables, or tokenizers.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as b, sha1(encode(coalesce(html, ''))) as d from pages),
        k as (select d, max(page_id) as keeper from p where b >= 1000 group by d)
        select page_id, cast(b as bigint) as payload_bytes, p.d as payload_digest,
            case when keeper <> page_id then 'revisit' else 'response' end as record_type, case when keeper <> page_id then keeper end as refers_to
        from p left join k on p.d = k.d""",
}
