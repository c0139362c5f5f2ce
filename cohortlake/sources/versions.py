"""Replacing a whole table while it may be read.

Each replacement goes to a folder of its own; a row in the ``commits`` folder
makes it current. Readers keep the version they started with, and a job that
dies half way leaves no commit row behind. Commit N has one place, so of two
writers that started from the same version one is refused.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

COMMITS = "folder STRING, batch STRING, committed_at TIMESTAMP, version INT"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Committed versions with their folder and the name of the batch that wrote each."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Highest committed version and its folder; 0 and None when there is none."""
    last = commits(spark, path).agg(F.max(F.struct("version", "folder")).alias("last")).first().last
    return (last.version, last.folder) if last else (0, None)


def current_version(spark: SparkSession, path: str) -> int:
    return current(spark, path)[0]


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a named batch was written before."""
    return not commits(spark, path).where(F.col("batch") == batch).isEmpty()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last committed version."""
    version, folder = current(spark, path)
    if version == 0:
        raise ValueError(f"no committed version below {path}")
    return spark.read.parquet(f"{path}/{folder}")


def replace_table(df: DataFrame, path: str, batch: str | None = None, after: int | None = None) -> int:
    """Write ``df`` as the next version and make it current.

    ``after`` names the version that ``df`` was made from; the commit is
    refused when another one came in between. Leftovers of an attempt that
    never got its commit row are in a folder that nothing names.
    """
    spark = df.sparkSession
    before = current_version(spark, path) if after is None else after
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    if current_version(spark, path) != before:
        raise RuntimeError(f"{path} was replaced meanwhile: version {before} is not the last one any more")
    row = spark.range(1).select(
        F.lit(folder).alias("folder"), F.lit(batch).cast("string").alias("batch"), F.current_timestamp().alias("committed_at"),
    )
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/version={before + 1}")
    return before + 1
