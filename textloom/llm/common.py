"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The parquet table `name` of `sf_dir`, or only `columns` of it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset and everything runs in one process (as in tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/textloom-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder; its lineage ends there, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """`df` written as parquet in the shared folder and read again: unlike `cut`, later reads prune columns."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tagged(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with a number of each row, stored, and that column's name: splits of a scan may change between two plans, and numbers computed again with them."""
    tag = fresh(df, "row_tag")
    return written(df.withColumn(tag, F.monotonically_increasing_id()), "tagged"), tag


def text_of(column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: what the session was sized to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which `small` lets a table be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if a count shows that it has few rows. For tables that are cheap to count (kept ones)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def few(df: DataFrame) -> DataFrame:
    """df computed once, and marked for broadcast if it then has few rows."""
    return small(cut(df))


#: Part of a table's rows from which a key counts as hot in `join_hot`; so at most as many keys do.
HOT_PARTS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Inner join of left with right's `columns`; right, a kept table, has one row per key at most, while a key may hold much of left.

    If right is too large to be broadcast, keys that hold a thousandth of left's rows or more
    are at most HOT_PARTS; their rows of right are broadcast, so that rows of left that share
    such a key stay where they are.
    """
    right = right.select(key, *columns)
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key)
    n = left.count()
    hot = cut(left.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") * HOT_PARTS >= n).select(key))
    hot_right = F.broadcast(right.join(F.broadcast(hot), key))
    return left.join(hot_right, key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))
