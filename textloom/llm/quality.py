"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

Document evidence is the sum of the Dirichlet-smoothed log-odds of a few binned measures of
the text (naive Bayes), calibrated by a logistic curve. Each document then counts with its
probability at its site. A host's posterior mean is shrunk toward the global mean and a
path's toward its host's, both with Beta priors whose strength the method of moments takes
from the spread of the means over that of their sampling; so a sparse site says little. The
score adds the log-odds of the path's posterior, without the document itself, to the
document's own.

Everything is grouped aggregation over all documents; only tables of a fixed size (bins,
calibration) reach the driver. Labels are learnt only from rows whose crc32(doc_id as text)
mod 3 is not 1; the rest measures the classifier.

Rows: null and empty texts fall into the lowest bins. Several labels of one doc_id count as
good if one does, null labels as none; without labels of both classes all evidence is 0.
Null hosts or paths are a site of their own. Every row gets a result, repeated ones too; an
empty table gives an empty result; columns other than those named play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, text_of, written
from .toxicity import is_held_out, logistic

#: Bins of a measure from 0 to 1.
BINS = 12
#: Pseudo-count of the Dirichlet prior, spread over the bins as all documents are.
PRIOR = 4.0
THRESHOLD = 0.5


def _share(part: Column, whole: Column) -> Column:
    """A share as a bin; the lowest parts, where junk and prose differ, in bins of their own."""
    x = F.sqrt(part / F.greatest(whole, F.lit(1)))
    return F.least(F.floor(x * BINS), F.lit(BINS)).cast("int")


def measures(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path and the binned measures of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), text_of().alias("t"))
    rows = rows.withColumn("ws", F.filter(F.split("t", r"\s+"), lambda w: w != "")).withColumn("ls", F.filter(F.split("t", "\n"), lambda s: s != ""))
    chars, words = F.length("t"), F.size("ws")
    return rows.select(
        "doc_id",
        "host",
        "path",
        F.floor(F.log2(words + 1.0)).cast("int").alias("m_words"),
        _share(F.size(F.array_distinct("ws")), words).alias("m_distinct"),
        F.floor(F.least(chars / F.greatest(words, F.lit(1)), F.lit(20.0))).cast("int").alias("m_length"),
        _share(F.regexp_count("t", F.lit(r"\p{Lu}")), chars).alias("m_upper"),
        _share(F.regexp_count("t", F.lit(r"[^\p{L}\p{N}\s]")), chars).alias("m_marks"),
        _share(F.regexp_count("t", F.lit(r"\p{N}")), chars).alias("m_digits"),
        _share(F.size("ls") - F.size(F.array_distinct("ls")), F.size("ls")).alias("m_lines"),
    )


def _fit(rows: DataFrame, names: list[str]) -> tuple[dict[tuple[str, int], float], float, float]:
    """Log-odds of each (measure, bin), and (intercept, slope) of the calibration. rows: the measures and good (0 or 1)."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    counts = rows.selectExpr("good", f"stack({len(names)}, {pairs}) as (name, bin)").groupBy("name", "bin").agg(F.sum("good").alias("n1"), F.sum(1 - F.col("good")).alias("n0")).collect()
    totals = [sum(r.n0 for r in counts) / len(names), sum(r.n1 for r in counts) / len(names)]
    if not counts or min(totals) <= 0:
        return {}, 0.0, 0.0
    odds = {}
    for r in counts:
        prior = PRIOR * (r.n0 + r.n1) / sum(totals)
        odds[r.name, r.bin] = math.log((r.n1 + prior) / (totals[1] + PRIOR)) - math.log((r.n0 + prior) / (totals[0] + PRIOR))
    bins = rows.select("good", F.round(2 * _evidence(odds, names)).alias("x")).groupBy("x", "good").agg(F.count("*").alias("n")).collect()
    return odds, *logistic([(r.x / 2, r.good, r.n) for r in bins])


def _evidence(odds: dict[tuple[str, int], float], names: list[str]) -> Column:
    """Sum of the log-odds of a row's bins; a bin that was never seen has none."""
    total = F.lit(0.0)
    for name in names:
        known = [(b, x) for (n, b), x in odds.items() if n == name]
        if known:
            total = total + F.coalesce(F.element_at(F.create_map(*[v for b, x in known for v in (F.lit(b), F.lit(x))]), F.col(name)), F.lit(0.0))
    return total


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def strengths(sites: DataFrame, mean: Column) -> DataFrame:
    """One row (strength): that of the Beta prior of sites with n documents, s of them good in sum, around `mean`."""
    away = F.col("s") / F.col("n") - mean
    moments = sites.agg(F.sum(F.col("n") * away * away).alias("between"), F.sum(mean * (1 - mean)).alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * mean * (1 - mean)).alias("spread"))
    tau = F.greatest((F.col("between") - F.col("within")) / F.greatest(F.col("n"), F.lit(1)), F.lit(1e-6))
    return moments.select(F.coalesce(F.greatest(F.col("spread") / F.greatest(F.col("n"), F.lit(1)) / tau - 1, F.lit(1e-3)), F.lit(1.0)).alias("strength"))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, held_out, score, keep, document (its own probability), host_mean, path_mean of every row."""
    rows = written(measures(docs, host, path), "measures")
    names = [c for c in rows.columns if c.startswith("m_")]
    good = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("good"))
    odds, intercept, slope = _fit(rows.join(good.filter(~is_held_out(F.col("doc_id"))), "doc_id").select("good", *names), names)
    own = F.lit(intercept) + F.lit(slope) * _evidence(odds, names)
    docs_ = written(rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-own))).alias("p")), "evidence")
    paths = small(written(docs_.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths"))
    whole = paths.agg((F.sum("s") / F.sum("n")).alias("mean"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).crossJoin(F.broadcast(whole))  # one row
    hosts = hosts.crossJoin(F.broadcast(strengths(hosts, F.col("mean"))))
    hosts = hosts.select(F.col("host").alias("h"), "mean", ((F.col("s") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))).alias("host_mean"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    sites = sites.crossJoin(F.broadcast(strengths(sites, F.col("host_mean"))))
    sites = small(written(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "mean", "host_mean", "strength"), "sites"))
    out = docs_.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    without = (F.col("s") - F.col("p") + F.col("strength") * F.col("host_mean")) / (F.col("n") - 1 + F.col("strength"))
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(without) - _logit(F.col("mean")))))
    path_mean = (F.col("s") + F.col("strength") * F.col("host_mean")) / (F.col("n") + F.col("strength"))
    out = out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.col("p").alias("document"), "host_mean", path_mean.alias("path_mean"))
    return out.withColumn("keep", F.col("score") >= THRESHOLD)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
