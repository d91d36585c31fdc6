"""Jobs as streams: new files in micro-batches, and status rows merged so that a missing value keeps the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ["uploaded", "processing", "completed", "failed"]


def merged_status(updates: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """T4: for every key the last value of each field that isn't null, in the order given."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)
    return updates.groupBy(key).agg(*[last(c) for c in fields], F.count("*").alias("updates"))


def valid_state(c: Column) -> Column:
    """T5."""
    return F.coalesce(c.isin(STATES), F.lit(False))


def source_folder(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """A folder that a file stream can watch, and options that pick the table in it; a table may be one file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return path, {}
    return path.rsplit("/", 1)[0], {"pathGlobFilter": path.rsplit("/", 1)[1]}


def run_jobs(spark: SparkSession, path: str, folder: str, work, files_per_batch: int = 64) -> DataFrame:
    """Reads a table's files as a stream, applies ``work`` to every micro-batch, and returns what the batches wrote.

    A batch writes to a folder of its own number, overwriting it, so a batch that is repeated after a failure leaves its
    rows once; the checkpoint beside them resumes the stream.
    """
    where, options = source_folder(spark, path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).parquet(where)
    out = f"{folder}/batches"
    result = work(spark.read.schema(schema).parquet(path).limit(0)).schema

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result).option("recursiveFileLookup", "true").parquet(out)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts by time window and type, with a watermark where the input is a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
