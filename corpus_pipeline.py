"""A training corpus from raw documents: classify, deduplicate exactly and nearly, mix sources, encode.

In every stage null and empty texts, null ids and sources, repeated rows, ties and texts of any length have the results that its
operator's docstring states, other columns pass under any name, and an empty table stays empty.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraframe.llm import bpe, exact, mixing, neardup, quality
from terraframe.llm._common import table, written
from terraframe.llm.queries import TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; null and empty texts are judged like others."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, the one with the largest doc_id; null texts count as empty, so one of these stays."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one stays, the one with the smallest doc_id; texts without words all stay."""
    return neardup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order; texts without words are not taken."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text decoded from these; a null text has none."""
    return bpe.encode_decode(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: The classifier and the registers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
