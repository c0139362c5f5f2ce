"""Reading, creating, appending and exporting the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortlake.schemas import TABLES


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan of a CSV table with a header and quoted multi-line text.

    A multi-line CSV file cannot be split, so large tables are kept as
    Parquet (:func:`load_csv_as_parquet`) and CSV is only the way in. Values
    that do not fit their type become null instead of failing the scan.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a CSV table that hold a value that does not fit its declared type, as text.

    These are the values that :func:`read_csv_table` gives as null.
    """
    text = read_csv_table(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    broken = F.lit(False)
    for f in schema:
        broken = broken | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    return text.where(broken)


def load_csv_as_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType) -> DataFrame:
    """Bring CSV files into a Parquet table and return that table."""
    read_csv_table(spark, source, schema).write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; the schema is declared, never inferred from text."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Write an empty typed table unless the path already holds one."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def create_all(spark: SparkSession, root: str) -> None:
    """Create every table of the data model below ``root``."""
    for name, schema in TABLES.items():
        create_if_absent(spark, f"{root}/{name}", schema)


def scalar_columns(df: DataFrame) -> list[str]:
    """Names of the columns that are not arrays, maps or structs."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def results_to_append(results: DataFrame, stored: T.StructType, now=None) -> DataFrame:
    """New results in stored form: scalar fields only, stamped, matched by name.

    The caller's ``simulation_id`` is kept and missing columns become null.
    """
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    flat = results.select(*scalar_columns(results)).withColumn("created_at", stamp)
    present = set(flat.columns)
    return flat.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in stored.fields
        ]
    )


def chat_to_append(messages: DataFrame, now=None) -> DataFrame:
    """Chat rows with a new id, the time of writing and an empty-string target."""
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return messages.select(
        F.expr("uuid()").alias("chat_id"),
        "user_id",
        F.coalesce("simulation_id", F.lit("")).alias("simulation_id"),
        stamp.alias("timestamp"),
        "message",
        "response",
        "language",
        "action_type",
    )


def append(df: DataFrame, path: str) -> None:
    """Append rows as new files; existing files are never rewritten."""
    df.write.mode("append").parquet(path)


def append_by_name(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Union matched by column name; columns missing on one side become null."""
    return table.unionByName(rows, allowMissingColumns=True)


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write rows as CSV, JSON or Parquet."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown export format {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.save(path)
