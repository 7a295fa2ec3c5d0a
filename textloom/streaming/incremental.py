"""Vocabulary counts of a corpus that grows (an extension; the batch operators need none of it).

New documents are read as a stream of files. Each micro-batch is counted by itself and
written under its number, so that one that is run again after a failure replaces its own
counts and no others; a reader adds the batches up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matrices


def count_arrivals(spark: SparkSession, source: str, schema: str, counts: str, checkpoint: str, max_files: int = 100, **trigger) -> StreamingQuery:
    """Starts counting the terms of parquet files (doc_id, content) that arrive in `source`. trigger: as of writeStream.trigger; all that there is by default."""
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        matrices.term_counts(batch).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def current_counts(spark: SparkSession, counts: str) -> DataFrame:
    """(term, n) over all batches."""
    return spark.read.parquet(counts).groupBy("term").agg(F.sum("n").alias("n"))
