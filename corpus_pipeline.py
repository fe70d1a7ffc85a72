"""A corpus pipeline of five operators: rules, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the
columns of documents.  run() writes every stage to the shared folder and reads it back for the next, and removes what the
stages left there.

Defined results: a null or empty text is rejected by the rules, so later stages see none unless they are called alone, and
then treat it as empty; a null id, source or language is kept as it is; of a class of near duplicates, rows alike included,
one document stays, ties broken as near_duplicates says; secrets that overlap are masked as one; a document that the mix
takes more than once comes that often, shard by shard, in an order fixed by hashes; very long texts are one row throughout;
an empty table gives an empty table; further columns of documents pass through all stages but the last, which returns
doc_id, source, lang and its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, near_duplicates, quality_rules, secrets, sentencepiece_codec
from weftline.llm.common import stage, staging
from weftline.llm.registry import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.filter_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    return near_duplicates.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it, in shards by the splitting tree, shuffled inside each."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy in the mix, and whether decoding gives the text back."""
    rows = sentencepiece_codec.encode(docs.select("doc_id", "source", "lang", "text"), piece_model(), decoded="decoded")
    same = F.col("decoded") == F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(sentencepiece_codec.MARK), F.lit(" "))
    return rows.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicate),
    ("secret_scan", redact),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: The mix and the token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with staging(spark) as kept:
        for _, step in STAGES:
            docs = stage(step(spark, docs, sf_dir))
        kept.append(docs)
    return docs
