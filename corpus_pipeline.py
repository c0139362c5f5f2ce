"""Training corpus from raw documents: quality, boilerplate lines, near duplicates, benchmarks, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import decontamination, jaccard_join, line_dedup, mixing, quality
from cohortlake.llm.common import stored
from cohortlake.llm.registry import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality.quality_kept(docs)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on too many documents or different texts of their source."""
    return line_dedup.documents_without_boilerplate(docs, wide_percent=line_dedup.WIDE_PERCENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones; shingles of five words, similarity 0.8."""
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weight of their source asks for."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", boilerplate_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing", target_mixture),
]

#: Components of similar documents and seeded draws have no plain SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and reread as the next one's input.

    Nulls, empty and very long texts, repeated rows, empty tables and further
    columns are treated as each stage's operator says.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
