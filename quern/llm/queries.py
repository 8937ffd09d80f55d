"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import alignment, byte_bpe, decontaminate, embeddings, html_text, isolation, jaccard_join, language_id, pseudonyms, quality, spelling, token_counts, toxicity
from .common import held_out, table
from .components import cut
from .oracle import ORACLE_SQL  # noqa: F401  the SQL of these queries

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(documents, vocabulary).drop("text")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.grouped(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    documents = documents.withColumn("held_out", held_out("doc_id", 3, 1))
    prototypes = language_id.learn(documents.where("not held_out"))
    return language_id.identify(documents.drop("lang"), prototypes).drop("text")


#: A key for tests and comparisons. A real run passes its own secret key to pseudonymise().
SAMPLE_KEY = b"sample key, not a secret"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(documents, SAMPLE_KEY)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn_characters(documents)
    scorer = toxicity.learn_words(documents, _labels(spark, sf_dir), model)
    scored = toxicity.with_toxicity(documents, scorer).drop("text")
    return scored.withColumn("held_out", held_out("doc_id", 5, 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(documents, _labels(spark, sf_dir))
    scored = quality.with_quality(documents, rules).drop("text")
    return scored.withColumn("held_out", held_out("doc_id", 5, 0))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(documents, path, public_tokenizers.PATTERN).drop("text")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return isolation.judged(documents, _labels(spark, sf_dir)).withColumn("held_out", held_out("doc_id", 5, 0))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), one_in=31)
    return spelling.spelling_groups(cut(words.where("n >= 2")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *names)


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_embeddings": op5_embeddings,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_html_text": op10_html_text,
    "op11_isolation_rules": op11_isolation_rules,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_token_alignment": op13_token_alignment,
}
