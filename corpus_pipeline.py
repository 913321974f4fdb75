"""A training-data pipeline over ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and hands it to the next stage.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from gridspark.llm.common import as_row, cut, from_row, split_of, table
from gridspark.llm.queries import _ranks

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letter, or unlike every language learned."""
    model = language_id.train(docs.where(split_of(F.col("doc_id"), 4) != 2))
    rows = docs.select(as_row(docs).alias("row"), "doc_id", "text")
    return from_row(language_id.identify(rows, model, keep=["row"]).where("__language.accepted"), "row", docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as the mix takes them; what it does not take goes."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what each document encodes and decodes to."""
    coded = byte_bpe.encode_decode(docs, *_ranks())
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "identical")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: SQL has no fingerprints, models or merges; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
