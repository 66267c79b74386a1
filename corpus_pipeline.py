"""The corpus pipeline: documents that pass the quality rules, once each, near-duplicates removed, mixed, packed.

Each stage takes documents (doc_id, text, lang, source, n_chars; further columns are dropped) and, but for the last, returns
them. Defined cases of all: a null text counts as empty; a null id or source is a value of its own; rows that share an id are judged
each for itself; very long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, mixing, near_dedup, packing, quality
from quire.llm.common import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go, empty ones too; repeated rows are judged alike."""
    return quality.keep_good(docs).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays; of rows alike in that too, one."""
    return exact_dedup.drop_repeats(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in five-word shingles one stays; documents without words or without an id are linked with nothing and stay."""
    return near_dedup.keep_one(docs, words=5, percent=80).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight asks for; documents without words have no size and aren't taken."""
    return mixing.mixture(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens; a document that is taken twice is packed twice."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", packed),
]

#: The language model, the similarity search and the tokenizer have no SQL form; tests/llm hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
