"""The registered queries: each operator over its whole table, with the columns that its check compares."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseframe.llm import alignment, bpe, bytebpe, conversations, decontaminate, langid, neardup, pii, quality, secrets, suffixes, toxicity, vectors
from rinseframe.llm.common import read, remainder

#: The tokenizer files, by name: of words, of bytes as ranks and as a vocabulary, of pieces.
TOKENIZER, RANKS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words of a passage that op2 reports where it stands in several places, though it may be too short to be removed.
PASSAGE = 51
#: The key of the pseudonyms in the queries; in real use it comes from where secrets are kept.
PSEUDONYM_KEY = "rinseframe queries"


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    model = langid.fit(docs.where("NOT held_out"))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, folder, "documents"), with_bytes=False, passage_words=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.pseudonymize(read(spark, folder, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", *(f"n_{kind}" for kind in pii.KINDS))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(read(spark, folder, "documents"), keep=["doc_id"])
    spans = F.arrays_zip("starts", "ends", "kinds")
    shown = lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))
    base = F.filter(spans, lambda s: s["kinds"].isin("assign", "access", "hex"))
    counts = [
        F.size(F.filter("kinds", lambda k: k == F.lit(kind))).cast("bigint").alias(f"n_{kind}")  # noqa: B023
        for kind in ("assign", "access", "hex")
    ]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, shown), ",").alias("spans"),
    )


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Machine:
    """Learned from the labels of the rows that are not held out."""
    labels = read(spark, folder, "labels").where(remainder("doc_id", 4) != 2)
    return toxicity.fit(read(spark, folder, "documents"), labels)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    scored = toxicity.score(docs, toxicity_model(spark, folder), keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, folder, "documents"), words_per_shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), keep=["doc_id"])


def op10_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, folder, "embeddings"))


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return bytebpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path(BYTES), public_tokenizers.PATTERN, public_tokenizers.path(PIECES)
    return alignment.align(read(spark, folder, "documents"), *paths, keep=["doc_id"])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by a digest of their keys; a null counts as one blank. ``dropped`` marks rows that go."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(shown("role")).alias("role"), text.alias("text"),
        (fault == 0).alias("dropped"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(damaged(read(spark, folder, "conversations")), absent="dropped").report


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_minhash": op8_minhash,
    "op9_bpe": op9_bpe,
    "op10_embedding_neardup": op10_embedding_neardup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {}
