"""A corpus pipeline of five operators, from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents. ``run`` writes each stage's rows as Parquet to the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavane.llm import mixing, neardup, packing, quality, repeats
from stratavane.llm.common import materialise, prepare, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, of a similarity of 0.8 or more, the document of smallest doc_id stays."""
    prepare(spark)
    return neardup.drop_near_duplicates(docs, threshold=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller doc_id holds go; documents stay, perhaps empty."""
    prepare(spark)
    return repeats.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them: 0 to 3 times."""
    prepare(spark)
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_copies),
    ("suffix-array repeats", cut_repeats),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Classifier, near-duplicate signatures and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
