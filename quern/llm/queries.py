"""The registered query of each operator, over the whole of the given tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, jaccard, langid, licenses, mixing, packing, pii, quality, repair, secrets, urls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op3_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf, "documents"), size=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.quality_verdicts(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return found.drop("n_lines", "n_marks", "n_upper", "n_letters", "n_digits")


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf, "documents"))


def op6_minhash_containment(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def tokenizer_path() -> str:
    """The file of the packing contract, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), tokenizer_path())


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.language_predictions(_table(spark, sf, "documents"))


def op2_pii_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_digests(_table(spark, sf, "documents"))


# The rules of the URL contract.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under the rules; without one, pages whose canonical URL was crawled more than once are blocked."""
    pages = _table(spark, sf, "pages")
    return urls.url_verdicts(pages, urls.repeated_urls(pages), URL_RULES)


def op9_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    return warc.page_derivatives(_table(spark, sf, "pages"))


def op10_secret_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf, "documents"))


def op11_context_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.document_scores(_table(spark, sf, "documents"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.damaged_repairs(_table(spark, sf, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf, "embeddings"))


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_language_id,
        op2_pii_anchors,
        op3_ngram_jaccard_join,
        op4_quality_rules,
        op5_license_scan,
        op6_minhash_containment,
        op7_best_fit_packing,
        op8_url_filter,
        op9_warc_derivatives,
        op10_secret_entropy,
        op11_context_mixing,
        op12_conversation_repair,
        op13_embedding_whitening,
    )}
