"""A corpus pipeline of five stages over ``documents``; part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. An empty table goes through all stages as an
empty table. Rows are told apart by id and text: of rows that agree in both, one goes on from near_duplicates; a null or
repeated doc_id with another text is another document, and is judged as such. Further columns, whatever their names, come
along as far as the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, common, jaccard, language, leaks, secrets

#: A language is rejected as undetermined, or under this probability.
LEAST_SCORE = 0.3
#: What a worker of the last stage remembers: workers outlive their stage, and share memory with others.
TOKEN_MEMORY = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; those without letters, null texts and guesses go."""
    common.release()
    return language.keep(docs, language.train(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each class of near duplicates goes on."""
    common.release()
    return jaccard.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item go on."""
    common.release()
    return leaks.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents go on, their secrets replaced by a mark; n_chars follows the text."""
    common.release()
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    common.release()
    return bpe.encode(docs, *bpe.public_vocabulary(), limit=TOKEN_MEMORY)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("tokens", tokens),
]

#: SQL cannot express the stages; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written into the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, name)
    return docs
