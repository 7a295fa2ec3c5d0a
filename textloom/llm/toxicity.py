"""Toxicity by maximum-scoring segments of token log-odds.

Fitting. A token's log-odds of toxic against clean text have a Dirichlet prior that is
centred on those of its 7-letter beginning, which has one centred on the 4-letter
beginning; a token that was never seen has those of its longest known beginning. Evidence
is counted as distinct pairs of neighbouring words, so that copies of one passage count
once. Tokens whose log-odds aren't significantly positive score a small constant below 0.

Scoring. The linear-time algorithm of Ruzzo and Tompa finds all maximal-scoring segments
of a text. A segment of score S in a text of m tokens has the extreme-value expectation
K m exp(-lambda S) under the clean model (lambda from the scores' moment equation, K from
the segments of clean texts). The r best segments together have the p-value of the sum
statistic of Karlin and Altschul; the least of these over r is a text's evidence, and a
logistic curve fitted on the labelled texts turns that into a score from 0 to 1.

The classifier is fitted on at most MAX_LABELLED labelled texts, picked by a hash of their
doc_id; all of fitting and scoring uses whole texts. Labels are learnt only from rows whose
crc32(doc_id as text) mod 3 is not 1.

Rows: a null text counts as empty; a text without a significant token has no evidence and
gets the lowest score. Several labels of one doc_id count as toxic if one does; null labels
count as none, and without any usable label every score is 0. A row with a null doc_id is
scored, is not held out and never learnt from. Repeated rows are scored each for itself, an
empty table gives an empty result, other columns play no part.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk_cache import _Places, held
from .common import text_of, written
from .shingles import words_of

#: Labelled texts that the classifier is fitted on at most.
MAX_LABELLED = 50_000
#: Pseudo-observations of the Dirichlet prior.
PRIOR = 10.0
#: Observations and standard deviations from which a token's own log-odds count.
MIN_SEEN, MIN_Z = 5, 3.0
#: Log-odds of a token's documents from which its contexts are looked at: a word twice as likely in toxic texts.
MIN_ODDS = math.log(2)
#: Score of a token without significant log-odds.
PENALTY = -0.1
THRESHOLD = 0.7
#: Expectation up to which a segment is reported as a toxic passage.
SIGNIFICANT = 0.01
#: Lengths of the beginnings of words that priors come from.
BEGINNINGS = (4, 7)


def features_of(word: str) -> list[str]:
    """The beginnings, each marked with an asterisk, and then the word."""
    return [*(word[:n] + "*" for n in BEGINNINGS if len(word) > n), word]


@dataclass
class Model:
    log_odds: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 0.1
    intercept: float = -1e9
    slope: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def token(self, word: str) -> float:
        for feature in reversed(features_of(word)):
            if feature in self.log_odds:
                return self.log_odds[feature] or PENALTY
        return PENALTY

    def evidence(self, segments: list[float], tokens: int) -> float:
        """Minus the log of the least sum-statistic p-value; 0 if no segment is less likely than chance."""
        best = total = 0.0
        base = math.log(self.k * max(tokens, 1))
        for r, s in enumerate(sorted(segments, reverse=True), 1):
            x = self.rate * s - base
            if x <= 0:
                break
            total += x
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * evidence))))


def segments(places: list[int], scores: list[float], gap: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after the last, score) of a text whose only positive words stand at `places`; each other word scores `gap`."""
    open_: list[tuple[int, int, float, float]] = []
    after, next_ = 0.0, 0
    for at, s in zip(places, scores, strict=True):
        before = after + gap * (at - next_)
        after, next_ = before + s, at + 1
        first, last, left, right = at, at + 1, before, after
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= left:
                j -= 1
            if j < 0 or open_[j][3] >= right:
                break
            first, left = open_[j][0], open_[j][2]
            del open_[j:]
        open_.append((first, last, left, right))
    return [(a, b, right - left) for a, b, left, right in open_]


class Scorer:
    """Scores of words under a model, remembered up to `limit` words."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Places()
        self.table = np.zeros(1 << 12)

    def tokens(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.limit:
            self._clear()
        place = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            self.index.new = []
            n = len(self.index)
            if n > len(self.table):
                self.table = np.concatenate([self.table, np.zeros(n)])
            self.table[n - len(new) : n] = [self.model.token(w) for w in new]
        return self.table[place]

    def text(self, text: str) -> tuple[list[tuple[int, int, float]], int, np.ndarray]:
        """Segments, number of words, score of each word."""
        scores = self.tokens(words_of(text))
        at = np.flatnonzero(scores > 0)
        return segments(at.tolist(), scores[at].tolist()) if len(at) else [], len(scores), scores


def _scorer(model: Model) -> Scorer:
    return held(("toxicity", model.name), lambda: Scorer(model))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of the labelled texts to learn from, at most about `most`."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = usable.count()
    parts = 1_000_000
    usable = usable.filter(F.pmod(F.xxhash64("label_id"), F.lit(parts)) < int(parts * min(1.0, most / max(n, 1))))
    # at most about `most` rows of two numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(usable), F.col("doc_id") == F.col("label_id")).select("text", "toxic")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by class."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["feature", "n0", "n1"])
        for c in counts:
            c.clear()
        return batch

    for text, toxic in _rows(batches):
        counts[toxic].update({f for w in set(words_of(text)) for f in features_of(w)})
        if len(counts[0]) + len(counts[1]) > 300_000:
            yield out()
    yield out()


def _contexts(shared):
    """Distinct (feature, class, neighbours) within a partition, and the words of each class as feature -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        known: dict[str, tuple[int, ...]] = {}
        seen: set[tuple[int, int, int]] = set()
        words_in = [0, 0]

        def out() -> pa.RecordBatch:
            rows = list(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[], [], []], (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["f", "y", "c"])

        for text, toxic in _rows(batches):
            words = words_of(text)
            words_in[toxic] += len(words)
            for k, w in enumerate(words):
                fs = known.get(w)
                if fs is None:
                    if len(known) > 500_000:
                        known.clear()
                    fs = known[w] = tuple(number[f] for f in features_of(w) if f in number)
                if fs:
                    around = f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"
                    c = xxhash.xxh64_intdigest(around.encode()) >> 1
                    seen.update((f, toxic, c) for f in fs)
            if len(seen) > 300_000:
                yield out()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([-1, -1], pa.int32()), pa.array([0, 1], pa.int32()), pa.array(words_in, pa.int64())], names=["f", "y", "c"])

    return run


def log_odds(seen: dict[str, tuple[int, int]], words: tuple[int, int]) -> dict[str, float]:
    """Log-odds of each feature from its distinct contexts (clean, toxic); 0 where they aren't significantly positive."""
    out: dict[str, float] = {}
    # beginnings before the words that they are the priors of
    for f in sorted(seen, key=lambda f: (not f.endswith("*"), len(f), f)):
        stem = f.rstrip("*")
        above = [stem[:n] + "*" for n in reversed(BEGINNINGS) if n < len(stem)]
        prior = next((out[a] for a in above if a in out), 0.0)
        clean, toxic = seen[f]
        if clean + toxic < MIN_SEEN:
            continue
        up, down = math.exp(prior / 2), math.exp(-prior / 2)
        more = [PRIOR * down / (up + down), PRIOR * up / (up + down)]
        spread = PRIOR / (2 * (clean + toxic) / max(1, sum(words)))
        x = math.log((toxic + more[1]) / (words[1] + spread)) - math.log((clean + more[0]) / (words[0] + spread))
        z = x / math.sqrt(1 / (toxic + more[1] + 0.5) + 1 / (clean + more[0] + 0.5))
        if z >= MIN_Z:
            out[f] = x
        elif z < 1:
            out[f] = 0.0
    return out


def _null_counts(shared):
    """Clean texts' tokens (kind 0) and segments (kind 1) by score in tenths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        counts: Counter = Counter()
        for text, toxic in _rows(batches):
            if not toxic:
                found, _, scores = scorer.text(text)
                for s, n in zip(*np.unique(np.round(scores * 10), return_counts=True), strict=True):
                    counts[0, int(s)] += int(n)
                for _, _, s in found:
                    counts[1, round(min(s, 1e4) * 10)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["kind", "tenths", "n"])

    return run


def extreme_value_parameters(tokens: dict[float, int], found: dict[float, int]) -> tuple[float, float]:
    """(lambda, K): the positive root of sum p(s) exp(lambda s) = 1, and the segments per token above the median segment."""
    total = sum(tokens.values())
    if not total or max(tokens) <= 0:
        return 1.0, 0.1

    def moment(rate: float) -> float:
        return sum(n * math.exp(min(500.0, rate * s)) for s, n in tokens.items()) / total - 1

    low, high = 1e-4, 1e-4
    while moment(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    rate = max(high, 0.05)
    n, half = 0, sum(found.values()) / 2
    for s in sorted(found, reverse=True):
        n += found[s]
        if n >= half:
            return rate, min(1.0, max(1e-4, n / total * math.exp(min(500.0, rate * s))))
    return rate, 0.1


def _evidence_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        counts: Counter = Counter()
        for text, toxic in _rows(batches):
            found, n, _ = scorer.text(text)
            counts[toxic, round(2 * min(100.0, shared.value.evidence([s for _, _, s in found], n)))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["y", "halves", "n"])

    return run


def logistic(rows: list[tuple[float, int, int]], ridge: float = 0.1) -> tuple[float, float]:
    """(intercept, slope) of y on x by Newton's method; rows: x, y, weight. A small ridge on the slope keeps separable classes finite."""
    x, y, w = (np.array(c, float) for c in zip(*rows, strict=True))
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - np.array([0, ridge * beta[1]])
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, ridge])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    spark = docs.sparkSession
    rows = written(training_rows(docs, labels, most), "toxic-train")
    classes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not classes.get(0) or not classes.get(1):
        return Model()
    counts = rows.mapInArrow(_document_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.expr(f"ln((n1 + 0.5) / {classes[1] + 1.0}D) - ln((n0 + 0.5) / {classes[0] + 1.0}D)")
    chosen = counts.filter(F.col("n0") + F.col("n1") >= MIN_SEEN).withColumn("x", odds).withColumn("z", F.expr("x / sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))"))
    chosen = chosen.filter((F.col("z") >= MIN_Z) & (F.col("x") >= MIN_ODDS))
    # significant words of MAX_LABELLED texts at most, however many documents there are
    names = [r.feature for r in chosen.select("feature").orderBy("feature").collect()]
    shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    found = rows.mapInArrow(_contexts(shared), "f int, y int, c long")
    words = {r.y: r.n for r in found.filter("f < 0").groupBy("y").agg(F.sum("c").alias("n")).collect()}
    pairs = found.filter("f >= 0").dropDuplicates().groupBy("f", "y").agg(F.count("*").alias("n"))
    seen: dict[str, list[int]] = {f: [0, 0] for f in names}
    for r in pairs.collect():  # two rows per feature at most
        seen[names[r.f]][r.y] = r.n
    model = Model(log_odds({f: tuple(n) for f, n in seen.items()}, (words.get(0, 0), words.get(1, 0))))
    nulls = rows.mapInArrow(_null_counts(spark.sparkContext.broadcast(model)), "kind int, tenths int, n long").groupBy("kind", "tenths").agg(F.sum("n").alias("n")).collect()
    model.rate, model.k = extreme_value_parameters(*({r.tenths / 10: r.n for r in nulls if r.kind == kind} for kind in (0, 1)))
    evidence = rows.mapInArrow(_evidence_counts(spark.sparkContext.broadcast(model)), "y int, halves int, n long").groupBy("y", "halves").agg(F.sum("n").alias("n")).collect()
    model.intercept, model.slope = logistic([(r.halves / 2, r.y, r.n) for r in evidence])
    return model


_SCORED = "doc_id long, score double, evidence double, n_words long, passages array<struct<first:int,last:int,score:double>>"
_SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])))])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence, n_words, passages (significant ones: first word, word after the last, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found, n, _ = scorer.text(text)
                    evidence = m.evidence([s for _, _, s in found], n)
                    passages = [{"first": a, "last": b, "score": s} for a, b, s in found if m.k * n * math.exp(-min(700.0, m.rate * s)) <= SIGNIFICANT]
                    rows.append({"doc_id": doc_id, "score": m.score(evidence), "evidence": evidence, "n_words": n, "passages": passages})
                yield pa.RecordBatch.from_pylist(rows, schema=_SCORED_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _SCORED)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "n_words")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; decided where they are read, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, m = _scorer(shared.value), shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                stay = []
                for text in part.column(text_at).to_pylist():
                    found, n, _ = scorer.text(text or "")
                    stay.append(m.score(m.evidence([s for _, _, s in found], n)) < THRESHOLD)
                yield part.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
