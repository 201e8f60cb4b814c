"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0).select("doc_id", "toxic")
    told = score(docs, fit(docs.filter("not held_out"), labels))
    return told.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    told = predict(docs.select("doc_id", "held_out", "text"), fit(docs.filter("not held_out")))
    return told.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantize, search

    vectors = quantize(table(spark, sf_dir, "embeddings"))
    return search(vectors.filter("id % 20 = 0"), vectors, 20)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import learn_and_score

    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    told = learn_and_score(table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train")), "train")
    return told.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import scratch
    from .warc import read, write

    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).drop("payload", "url")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment_counts

    return alignment_counts(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        "op1_minhash": op1_minhash,
        "op2_secrets": op2_secrets,
        "op3_decontamination": op3_decontamination,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_language": op6_language,
        "op7_substrings": op7_substrings,
        "op8_topk": op8_topk,
        "op9_lm": op9_lm,
        "op10_warc": op10_warc,
        "op11_jaccard": op11_jaccard,
        "op12_alignment": op12_alignment,
        "op13_trie": op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles, secrets

    return oracles.oracle_sql() | {"op2_secrets": secrets.oracle()}
