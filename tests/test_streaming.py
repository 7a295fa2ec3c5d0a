from textloom.operators import matrices
from textloom.streaming import incremental


def test_counts_of_arrivals_equal_those_of_the_whole(spark, tmp_path):
    source, counts, checkpoint = (str(tmp_path / n) for n in ("in", "counts", "cp"))
    schema = "doc_id string, content string"
    for part in ([("a", "x y"), ("b", "y")], [("c", "y z")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        incremental.count_arrivals(spark, source, schema, counts, checkpoint, max_files=1).awaitTermination()
        whole = matrices.term_counts(spark.read.parquet(source))
        assert set(map(tuple, incremental.current_counts(spark, counts).collect())) == set(map(tuple, whole.collect()))
