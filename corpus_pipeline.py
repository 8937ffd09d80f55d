"""A training-data pipeline: quality, near-duplicates, benchmark passages, personal data, tokens.

Every stage takes a session, the documents that the stage before it kept, and the folder of the tables; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, decontaminate, jaccard_join, pseudonyms, quality
from quern.llm.common import held_out, table
from quern.llm.components import cut
from quern.llm.queries import SAMPLE_KEY


def wide_rows(spark: SparkSession) -> None:
    """Whole texts are wide rows: batches that go to Python hold fewer of them than Spark's default of 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(1_000, int(spark.conf.get(name)))))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from labelled ones, don't reject."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    rules = quality.learn(docs, labels)
    return quality.with_quality(docs, rules).where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar to 0.8 or more: the one of the least id.

    Documents without id or words stay; of several rows with one id, one stays."""
    wide_rows(spark)
    return jaccard_join.one_of_each(docs, width=5, num=8, den=10).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    wide_rows(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms, which keep the length of texts, in place of personal data."""
    wide_rows(spark)
    return pseudonyms.pseudonymise(docs, SAMPLE_KEY, counts=None).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with digests of the ids and of the text that they decode to."""
    wide_rows(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, ids="ids")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("private_data", without_private_data),
    ("byte_bpe", token_ids),
]

#: SQL can express neither the rules nor the pseudonyms; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
