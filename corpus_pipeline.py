"""A training-data pipeline over ``documents``: each stage works on what its predecessor kept, and its decisions take effect.

1. quality rules: documents that the base rules or the robust outlier test reject go;
2. n-gram Jaccard join: of each group of near-duplicates the document of least doc_id stays;
3. secret scans: every reported span is replaced by a mask;
4. mixing: the mix's rows, a document taken twice being two rows and one that is cut keeping its first words;
5. best-fit packing: one row per piece, with its sequence and place.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``. The method of several stages
has no SQL form (concentration steps, signatures, hypergeometric draws, tokenising), so there is no ORACLE_SQL; tests/llm holds the pipeline
against a brute-force version.

Defined cases: a null or empty text, or one of fewer than 20 words, goes in stage 1, so later stages see neither; a null doc_id is a row of
its own throughout; repeated rows are judged alike, and of those with one doc_id all stay or none does; null lang and source are values of
their own; texts of any length are read whole, and only the document that ends a source's quota is cut; of equal near-duplicates the least
doc_id stays; extra columns, whatever their names, are kept by all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccardjoin, mixing, packing, quality, secrets
from millrace.llm.common import bounded_batches, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccardjoin.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", sequence_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k + 1}")
    return docs
