"""Continuous append of chat and login events with derived columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlake.functions.access import is_private
from cohortlake.operators.chat import classify
from cohortlake.operators.logins import with_address


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the limit bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def chat_events(messages: DataFrame) -> DataFrame:
    """Messages with language, word and intent columns and a day."""
    timed = messages.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return classify(timed).withColumn("day", F.to_date("timestamp"))


def login_events(logins: DataFrame) -> DataFrame:
    """Logins with client address, private flag and a day."""
    timed = with_address(logins.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    return timed.withColumn("private", is_private("ip_address")).withColumn("day", F.to_date("timestamp"))


#: Parts of a day by a hash of the id: a repeat is looked for in its own part only. One part suits days of some
#: hundred megabytes; choose more for larger days, as each part is a folder of its own.
BUCKETS = 1
#: Days of a micro-batch that are listed one by one; a micro-batch of more days looks at all from its first to its last.
LISTED_DAYS = 200


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_ids(named: DataFrame, path: str, key: str) -> DataFrame | None:
    """Ids that the table holds in the days and buckets of some events; none before there is a table.

    The condition is on the folders, so what is listed and read grows with the
    parts that the events touch, not with the table.
    """
    spark = named.sparkSession
    touched: dict = {}
    for r in named.select("day", "bucket").distinct().collect():  # days times buckets of a micro-batch
        touched.setdefault(r.day, []).append(r.bucket)
    days = [d for d in touched if d is not None]
    if len(days) > LISTED_DAYS:
        where = F.col("day").between(min(days), max(days))
    else:
        where = reduce(or_, [(F.col("day") == d) & F.col("bucket").isin(touched[d]) for d in days], F.lit(False))
    if None in touched:
        where = where | (F.col("day").isNull() & F.col("bucket").isin(touched[None]))
    try:
        return spark.read.schema(named.schema).parquet(path).where(where).select(key)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def not_stored(batch: DataFrame, path: str, key: str) -> DataFrame:
    """The batch's events whose id the table does not hold yet, each id once.

    An event that is sent again carries its own time and id, so only its own
    day and bucket are looked up. Events without an id are all kept.
    """
    named = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    held = stored_ids(named, path, key)
    if held is not None:
        named = named.join(held, key, "left_anti").select(batch.columns)
    return named.union(batch.where(F.col(key).isNull()))


def append_stream(events: DataFrame, path: str, checkpoint: str, key: str, rows_per_file: int = 1_000_000,
                  buckets: int = BUCKETS) -> StreamingQuery:
    """Write all available events once each to a table partitioned by day and ``bucket``, then stop.

    No event is too late: repeats are told from new events by the ids that the
    table holds, not by a watermark, so rows may come in any order. A batch
    that Spark repeats after a failure finds its rows stored. The rows of a day
    are spread by Spark according to the size of the micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("bucket", bucket(key, buckets)).persist()
        try:
            new = not_stored(kept, path, key).hint("rebalance", "day", "bucket")
            new.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("day", "bucket").parquet(path)
        finally:
            kept.unpersist()

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
