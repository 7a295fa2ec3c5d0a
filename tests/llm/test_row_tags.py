import random

import pytest

from textloom.llm import exact_dedup, near_dup, pii

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Five files, each with a copy, a near copy and an address among other texts."""
    rng = random.Random(6)
    text = " ".join(f"word{rng.randrange(999)}" for _ in range(300))
    path = str(tmp_path_factory.mktemp("tags") / "d")
    for f in range(5):
        rows = [(10 * f + i, " ".join(f"word{rng.randrange(9999)}" for _ in range(30))) for i in range(7)]
        rows += [(10 * f + 7, text), (10 * f + 8, f"{text} end{f}"), (10 * f + 9, f"write to a{f}@b.example {rng.random()}")]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("stage", [exact_dedup.keep_first_class, near_dup.keep_one_of_each, pii.sanitised])
def test_splits_may_change(spark, parts, stage):
    """The scan is split in another way between the job that finds the rows and the one that reads them again."""
    before = spark.conf.get(SPLITS)
    try:
        results = []
        for later in (before, "1k"):
            spark.conf.set(SPLITS, before)
            out = stage(spark.read.parquet(parts))
            spark.conf.set(SPLITS, later)
            results.append(sorted(map(tuple, out.collect())))
        assert results[0] == results[1]
    finally:
        spark.conf.set(SPLITS, before)
    kept = dict(results[1])
    copies = [10 * f + 7 for f in range(5)]
    if stage is exact_dedup.keep_first_class:
        assert sorted(kept) == [i for i in range(50) if i not in copies[:-1]]
    elif stage is near_dup.keep_one_of_each:
        assert [i for i in kept if i % 10 in (7, 8)] == [7] and len(kept) == 41
    else:
        assert len(kept) == 50 and all("[EMAIL]" in kept[10 * f + 9] for f in range(5))
