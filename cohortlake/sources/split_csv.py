"""CSV files with line breaks inside quotes, read by many tasks.

Spark reads a multi-line CSV file whole in one task. Here its lines are read
in Spark's own splits. A line begins a record if the quotes before it in the
file are even in number; doubled quotes do not disturb that. Each split counts
its quotes, the counts of the splits before it say how it begins, and lines
that belong to one record are put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cohortlake.session import checkpointed

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, place, line)`` of all lines, pinned so that a line's split and place stay what they are."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return checkpointed(lines)


def quotes(line: str) -> Column:
    return F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))


def whole_records(lines: DataFrame) -> DataFrame:
    """``(file, record)`` with line breaks inside quotes put back as line feeds, headers and empty lines left out.

    Windows run over the lines of a split, and over the splits of a file; only
    lines of records that span several travel to meet.
    """
    upto = Window.partitionBy("file", "block").orderBy("place")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("own", quotes("line")).withColumn("inside", F.coalesce(F.sum("own").over(before), F.lit(0)))
    splits = lines.withColumn("own", quotes("line")).groupBy("file", "block").agg(F.sum("own").alias("own"), F.min("place").alias("first"))
    # one row per split
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"),
                          F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("past"),
                          F.min(F.struct("block", "first")).over(Window.partitionBy("file"))["first"].alias("header"))
    placed = counted.join(known, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    starts = (F.col("past") + F.col("inside")) % 2 == 0
    placed = placed.select("file", "block", "place", "line", starts.alias("starts"), (F.col("own") % 2 == 1).alias("turns"),
                           (F.col("place") == F.col("header")).alias("is_header"))
    single = placed.where("starts AND NOT turns").where(~F.col("is_header") & (F.trim("line") != "")).select(
        "file", F.col("line").alias("record"))
    # what is left are records of several lines: a line that opens one, those inside, the line that closes it
    parts = placed.where("NOT (starts AND NOT turns)")
    at = F.struct("block", "place")
    in_split = F.max(F.when(F.col("starts"), at)).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_at", in_split)
    last = parts.where("starts").groupBy("file", "block").agg(F.max(at).alias("_open"))
    carried = splits.select("file", "block").join(last, ["file", "block"], "left").select(
        F.col("file").alias("_file"), F.col("block").alias("_block"),
        F.last("_open", ignorenulls=True).over(earlier).alias("_from"))
    joined = parts.join(carried, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    record = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "line"))), lambda x: x["line"]), "\n")
    several = joined.withColumn("_at", F.coalesce("_at", "_from")).groupBy("file", "_at").agg(
        record.alias("record"), F.max("is_header").alias("is_header")).where("NOT is_header").select("file", "record")
    return single.unionByName(several)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of a quoted CSV table with a header, like :func:`cohortlake.sources.tables.read_csv_table`.

    A quote stands only around a field, or doubled inside it. A header that
    names other columns is an error. Values that do not fit their type are null.
    """
    lines = numbered_lines(spark, path)
    first = lines.groupBy("file", "block").agg(F.min_by("line", "place").alias("line")).groupBy("file").agg(F.min_by("line", "block").alias("line"))
    names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    text = F.from_csv("line", ", ".join(f"`{n}` string" for n in names.names), OPTIONS)
    wrong = first.where(F.trim("line") != "").select("file", text.alias("h")).where(
        F.array(*[F.col(f"h.`{n}`") for n in names.names]) != F.array(*[F.lit(n) for n in names.names])).first()
    if wrong is not None:
        raise ValueError(f"the header of {wrong.file} names other columns")
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return whole_records(lines).select(F.from_csv("record", declared, OPTIONS).alias("r")).select("r.*")
