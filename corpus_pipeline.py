"""A training-corpus pipeline: language ID, near-dedup, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferroflux.llm import decontaminate, langid, minhash, packing, secrets
from ferroflux.llm.base import fresh, materialize, quoted
from ferroflux.llm.queries import table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``docs`` names; texts without letters go, null and empty ones among them, and those on which no language scores above its false positives. Other rows stay, repeated ones too."""
    lang, score = fresh("told", docs.columns), fresh("told_score", docs.columns)
    told = langid.predict(docs, langid.fit(docs), names=(lang, score))
    return told.filter((F.col(lang) != "und") & (F.col(score) > 0)).select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id; rows of one doc_id share its fate, those of a null one and without words stay."""
    key = fresh("kept_id", docs.columns)
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none, and rows with equal texts share their fate."""
    leaks = fresh("leaks", docs.columns)
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), into=leaks)
    return found.filter(F.size(leaks) == 0).select(*map(quoted, docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars, if there is such a column, counted anew; null texts stay null."""
    found = fresh("found", docs.columns)
    clean = secrets.redact(secrets.scan(docs, into=found), column=found)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each; a null or empty text is one piece of its end id."""
    return packing.pack(docs, tokenizer_path(), added_tokens=True)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: No SQL states n-gram filters, tiling and a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
