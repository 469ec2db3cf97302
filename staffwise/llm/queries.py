"""The operators bound to the supplied tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets
    return secrets.summary(*secrets.scan(table(spark, sf_dir, "documents"), *ownership()))


def ownership() -> tuple:
    """Owner and repository of a document: its source, and source by language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"),
                                   (-1, 1, "assistant", "</s>[INST] ok [/INST]")], said.schema)
    return chat.digests(chat.turn_rows(chat.as_log(said.unionByName(extra))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import with_next
    return with_next(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_bpe import encode_texts, keyed_texts
    keyed = keyed_texts(table(spark, sf_dir, "documents"))
    by_text = encode_texts(keyed, tokenizer_path()).select(
        "key", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "n_chunks", "n_reused")
    return keyed.select("doc_id", "key").join(by_text, "key").drop("key")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import align
    return align.summary(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                         tokenizer_path("piece_bpe_32k.model"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_secret_scan, op3_toxicity, op4_chat_formatting, op5_language_id, op6_quality_rules, op7_best_fit_packing, op8_document_fingerprints,
    op9_license_scan, op10_bpe,
    op11_embedding_whitening, op12_token_alignment, op13_source_mix)}
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": oracle.OP1, "op2_secret_scan": oracle.OP2,
    "op4_chat_formatting": oracle.OP4, "op9_license_scan": oracle.OP9,
    "op13_source_mix": oracle.OP13}
