"""From raw documents to tokens: stages that each take what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseframe.llm import bpe, decontaminate, neardup, pii, toxicity
from rinseframe.llm.common import read, stored
from rinseframe.llm.queries import PSEUDONYM_KEY, TOKENIZER, toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def harmless(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Toxic documents go. A null text is kept as an empty one would be."""
    scored = toxicity.score(docs, toxicity_model(spark, folder), name="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates, by shingles of five words, the document of the smallest id stays."""
    return neardup.deduplicate(docs)


def unseen(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of the benchmark are cut out of the text; a document that is mostly such passages goes."""
    held = {name: f"__column{i}" for i, name in enumerate(docs.columns)}  # so that no name meets one of the operator's
    source = docs.select(*(F.col(f"`{name}`").alias(place) for name, place in held.items()))
    found = decontaminate.decontaminate(source, read(spark, folder, "benchmark"), text=held["text"])
    kept = found.where("NOT rejected")
    return kept.select(*(F.col("clean_text" if name == "text" else place).alias(name) for name, place in held.items()))


def private(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal numbers, addresses and dates become pseudonyms."""
    return pii.pseudonymize(docs, PSEUDONYM_KEY, counts=False)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and decoded."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", harmless), ("near_dedup", distinct), ("decontaminate", unseen), ("pii", private), ("tokens", tokens),
]
#: A fitted model and tokenizer files have no SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written before the next one reads it."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
