"""Change requests kept beside a versioned table and merged when it is read.

The table itself is not rewritten. Below ``<table>-changes`` stand

* ``log``: of each micro-batch the last good change per (key, field), in a
  folder of its own that a repeated micro-batch overwrites;
* ``folded``: a versioned table of the last change per (key, field) of all
  log folders up to some time.

A reader puts the last change of each (key, field), by the changes' own time,
on top of the table. So changes may come in any order and more than once, and
a micro-batch writes in proportion to its changes. When the log has grown to
the size of the folded table, both are folded into its next version: over
time a change is rewritten a bounded number of times on average.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlake.operators.changes import apply_changes, change_problem, changeable, last_per_key
from cohortlake.sources.versions import current_version, read_current, replace_table

ORDER = ("changed_at", "change_id")
#: The log is folded when it has as many rows as the folded table, and so many at least.
FOLD_ROWS = 100_000


def change_schema(key: str, kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField(key, kind), T.StructField("field", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("changed_at", T.TimestampType()), T.StructField("change_id", T.LongType()),
    ])


def last_changes(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each (key, field)."""
    return last_per_key(changes.select(key, "field", "value", *ORDER), [key, "field"], list(ORDER))


def folded_changes(spark: SparkSession, path: str, schema: T.StructType) -> tuple[int, DataFrame]:
    """Version and rows of the folded table; 0 and no rows before the first."""
    version = current_version(spark, f"{path}/folded")
    return version, read_current(spark, f"{path}/folded") if version else spark.createDataFrame([], schema)


def logged_changes(spark: SparkSession, path: str, schema: T.StructType, version: int) -> DataFrame:
    """Log folders that were begun under the version before this one or later.

    A writer that still holds the version before the last fold is thus read,
    and folded next time.
    """
    whole = T.StructType([*schema, T.StructField("gen", T.LongType())])
    try:
        log = spark.read.schema(whole).parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return log.where(F.col("gen") >= version - 1).select(*schema.names)


def all_changes(spark: SparkSession, table_path: str, key: str) -> DataFrame:
    """Changes that hold the last one of every (key, field)."""
    schema = change_schema(key, read_current(spark, table_path).schema[key].dataType)
    version, folded = folded_changes(spark, f"{table_path}-changes", schema)
    return folded.unionByName(logged_changes(spark, f"{table_path}-changes", schema, version))


def read_changed(spark: SparkSession, table_path: str, key: str = "simulation_id") -> DataFrame:
    """The table with the last good change of every field."""
    return apply_changes(read_current(spark, table_path), all_changes(spark, table_path, key), key, ORDER)


def fold_changes(spark: SparkSession, table_path: str, key: str = "simulation_id") -> int:
    """Make the last change of each (key, field) the next folded version; of two at a time one is refused."""
    schema = change_schema(key, read_current(spark, table_path).schema[key].dataType)
    path = f"{table_path}-changes"
    version, folded = folded_changes(spark, path, schema)
    every = folded.unionByName(logged_changes(spark, path, schema, version))
    return replace_table(last_changes(every, key), f"{path}/folded", after=version)


def write_changes(batch: DataFrame, table_path: str, source: str, batch_id: int, key: str, fold_rows: int) -> None:
    """One micro-batch: its last good changes go to the log, which is folded when it has grown."""
    spark = batch.sparkSession
    table = read_current(spark, table_path).schema
    schema = change_schema(key, table[key].dataType)
    path = f"{table_path}-changes"
    good = batch.where(change_problem(F.col("field"), F.col("value"), changeable(table, key)).isNull())
    rows = last_changes(good, key).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    version, folded = folded_changes(spark, path, schema)
    rows.write.mode("overwrite").parquet(f"{path}/log/gen={version}/source={source}/batch={batch_id}")
    # both are counted from the files' footers
    if logged_changes(spark, path, schema, version).count() >= max(fold_rows, folded.count()):
        fold_changes(spark, table_path, key)


def apply_change_stream(changes: DataFrame, table_path: str, checkpoint: str, name: str = "changes",
                        key: str = "simulation_id", fold_rows: int = FOLD_ROWS) -> StreamingQuery:
    """Log all available changes in micro-batches, then stop; :func:`read_changed` reads the outcome.

    A micro-batch is named by the stream's name, its checkpoint and its
    number: what Spark repeats after a failure is written to the same folder,
    or counts as the same change once more.
    """
    source = hashlib.sha256(f"{name}-{checkpoint}".encode()).hexdigest()[:16]
    return (
        changes.writeStream.foreachBatch(
            lambda batch, batch_id: write_changes(batch, table_path, source, batch_id, key, fold_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
