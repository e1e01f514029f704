"""The corpus pipeline: five stages, each an operator of ``sparkprep.llm`` applied to all that the stage before kept.

Every stage takes the documents (doc_id, text, lang, source, n_chars and any further columns) and gives documents with
the same columns; the last gives their tokens. A stage's result is written as Parquet and read again by the next, so a
lost executor costs the work of one stage at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import bpe, langid, mixing, pii, simhash
from sparkprep.session import ensure_checkpoint_dir

#: A document scores at least this for its best language. Hardly any scores less; what drops texts that no learned
#: language fits is ``fitting`` (see langid).
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language fits; all others stay as they are."""
    found = langid.predict(docs, langid.fit(docs), fitting=True)
    return found.where((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest doc_id."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars of a changed text is its new length."""
    return pii.redact(docs, n_chars="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources come near their targets."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with the check sums of the ids and of what they decode to."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    found = bpe.round_trips(docs.select(F.struct("doc_id", "source").alias("key"), "text"), path, public_tokenizers.PATTERN, key="key", ids=True)
    return found.select("key.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The language, near-duplicate, personal-data and token stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; results between stages go to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
