"""Replay a table as a stream and run a streaming job to completion.

Used to run the streaming operators over data Spark derives from the driver
tables: each slice is written (by Spark, in parallel, into the shared checkpoint
folder) after the previous one, so the file source delivers about one slice per
trigger in order; the job runs with ``availableNow`` and its sink is read back as
a batch table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drover.session import shared_path


def replay_as_stream(df: DataFrame, slice_col: str, slices: int = 3, order: str = "forward") -> DataFrame:
    """A file-source stream that delivers ``df`` one slice at a time, in ascending
    (or ``reverse``) order.  ``slice_col`` numbers the slices from 0; numbers
    beyond ``slices - 1`` (and null) go with the last one.  Each slice is written
    by as many tasks as the session has shuffle partitions, and a trigger takes
    that many files."""
    spark = df.sparkSession
    root = shared_path(spark, "replay")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.coalesce(F.least(F.col(slice_col), F.lit(slices - 1)), F.lit(slices - 1))
    numbers = range(slices - 1, -1, -1) if order == "reverse" else range(slices)
    for i, n in enumerate(numbers):
        df.filter(at == n).drop(slice_col).repartition(files).write.parquet(f"{root}/in-{i:05d}")
    return spark.readStream.schema(df.drop(slice_col).schema).option("maxFilesPerTrigger", files) \
        .parquet(f"{root}/in-*")


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to completion into Parquet under the shared
    folder and return the result as a batch DataFrame."""
    spark: SparkSession = stream.sparkSession
    out, ckpt = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-ckpt")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt) \
            .outputMode("append").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, epoch_id: int):
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt) \
            .outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    snaps = spark.read.parquet(out)
    last = snaps.agg(F.max("epoch")).first()[0]
    return snaps.filter(F.col("epoch") == last).drop("epoch")
