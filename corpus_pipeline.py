"""A training corpus from documents, in stages; each stage's result is the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmesh.llm import exact_dedup, mixing, near_dedup, packing, quality
from starmesh.llm.common import shared_dir
from starmesh.llm.queries import table, tokenizer_path
from starmesh.plans.shared import scratch

#: Words of a shingle; the similarity is 80 percent.
SHINGLE = 5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of documents not held out, does
    not reject. Null and empty texts are scored as texts without words; repeated rows stay or go
    together; without labels all stay. Any columns, whatever their names, stay as they are."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id. Null
    and empty texts are one group; of repeated rows one stays. Columns stay as they are."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Texts without words
    and rows without an id stay; rows that repeat an id stay or go together. Columns stay as they are."""
    return near_dedup.keep_representatives(docs, shingle=SHINGLE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 2 times each, in whole documents. A
    null source is a source; texts without words are left out. Columns stay as they are."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. Null and empty texts are an end mark alone;
    repeated rows are packed each for itself. Other columns are not carried on."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: Training, signatures and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage stores on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
