"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.llm.common import free_name, staged, table
from listingflow.llm.mixing import mix, mixed_rows
from listingflow.llm.packing import pack
from listingflow.llm.quality_rules import fit_rules, judge_quality
from listingflow.llm.secret_scan import corpus_words, redact_secrets
from listingflow.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base thresholds and the learned rules keep.

    Null and empty texts go; repeated rows share their verdict; an empty table stays empty.
    """
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, rules).where(F.col(free_name(docs, "quality_stats"))["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more, that of the smallest id; see ``keep_one`` on nulls, ties and repeats."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` set anew; null texts stay null, and so does their ``n_chars``."""
    clean = redact_secrets(docs, words=tuple(corpus_words(docs)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in shuffled shards; see ``mix`` on nulls, ties and repeats."""
    return mixed_rows(mix(docs, keep=tuple(docs.columns)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids; a null or empty text is its end alone."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Learned rules, fingerprints and tokens are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
