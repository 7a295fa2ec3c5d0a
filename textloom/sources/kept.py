"""Tables computed once and read again by several parts of one plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path or own.isDefined():
        return path or own.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df written as parquet and read again; the files go when the session's JVM ends. Later reads prune columns, and lost executors repeat tasks of the reading only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/textloom-kept-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that `kept` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {re.sub(r"(textloom-kept-[0-9a-f]{32}).*", r"\1", f) for f in df.inputFiles() if re.search(r"textloom-kept-[0-9a-f]{32}/", f)}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with its running number in the given order, which must be a total one.

    No task holds more than a range of the rows: ranges are written, then each is numbered
    for itself from where the ranges before it end.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = kept(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__start"))  # a row per range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + place).drop("__range", "__start")
