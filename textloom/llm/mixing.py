"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The leaves of a tree domain -> language -> source hold documents. A token budget for
the whole mix goes down the tree: each node deals its budget to its children in
proportion to their weights, no child takes more than its subtree can give (its tokens
times `max_epochs`), and what a short child leaves goes to its siblings, again by
weight. A node never gets more than its subtree holds, so a shortage is made up by
siblings first and reaches the ancestors' other children only when a whole subtree is
short. All shares are whole tokens: an unfilled child gets the floor of its share.

A leaf with budget A and N tokens gives A div N whole epochs and, from one more epoch,
the first A mod N tokens of its documents in the order of a seeded hash of
(epoch, doc_id). That prefix is found without sorting a leaf in one task: documents are
counted in ranges of the hash, the range in which the prefix ends is found from the
counts and counted in finer ranges, and only the one of those is put in order.

Rows: documents with a null text have no tokens; null domain, language or source are a
leaf value of their own (shown as null); nodes without a weight get weight 1, those with
weight 0 or less get nothing. Ties of the hash are ordered by doc_id (nulls first);
repeated rows with the same doc_id count as one piece of their summed tokens and stay or
go together. A document without tokens stays when its place in the order is before the
end of the prefix. An empty table gives an empty result. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small

#: Ranges of the hash in each leaf, and of each such range again, so often: only a millionth of a leaf is sorted.
RANGES, ROUNDS = 1024, 2
SEED = 20240
#: Part of all available tokens that the query's mix has.
SHARE = 0.8
LEVELS = ("domain", "lang", "source")
#: Ints per node value; a value that isn't listed has weight 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"domain0": 3, "domain1": 2, "domain2": 2, "domain3": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 4, "src7": 2},
}


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens; the measure that budgets are in."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The query's domains: sources dealt to four by their CRC-32."""
    return F.concat(F.lit("domain"), (F.crc32(source.cast("binary")) % 4).cast("string"))


def order_hash(doc_id: Column, epoch: Column, seed: int) -> Column:
    """60 bits of an MD5 as a long."""
    words = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(words.cast("binary")), 1, 15), 16, 10).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level) or {}
    if not known:
        return F.lit(1).cast("long")
    pairs = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])
    return F.greatest(F.coalesce(F.element_at(pairs, F.col(level)), F.lit(1).cast("long")), F.lit(0).cast("long"))


def _deal(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Adds `alloc`: each node's part of its parent's `budget`. nodes: parents..., level, cap, w, budget.

    Children are filled in the order of cap / w; one is filled when the share that the
    still unfilled ones would get at its turn is at least its cap.
    """
    wide = "decimal(38,0)"
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    turn = by.orderBy(F.col("__r"), F.col(level).asc_nulls_first())
    before, rest = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(0, Window.unboundedFollowing)
    live = nodes.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(0)))
    live = live.withColumn("__r", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf"))))
    live = live.withColumn("__c", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(wide)).withColumn("__w", F.sum("w").over(rest).cast(wide))
    left = F.col("budget").cast(wide) - F.col("__c")
    full = (F.col("w") > 0) & (F.col("cap").cast(wide) * F.col("__w") <= left * F.col("w"))
    live = live.withColumn("__full", full)
    # all children from the first unfilled one on share what is left there
    live = live.withColumn("__f", F.min(F.when(~F.col("__full"), F.struct("__r", F.col(level), "__c", "__w"))).over(by))
    share = F.expr("cast(((cast(budget as decimal(38,0)) - __f.__c) * w) div __f.__w as bigint)")
    filled = F.col("__f").isNull() | (F.col("__full") & (F.struct("__r", F.col(level)) < F.struct(F.col("__f.__r"), F.col(f"__f.{level}"))))
    alloc = F.when(F.col("w") == 0, F.lit(0)).when(filled, F.col("cap")).when(F.col("__f.__w") > 0, F.least(share, F.col("cap"))).otherwise(F.lit(0))
    return live.withColumn("alloc", alloc.cast("long")).drop("__r", "__c", "__w", "__full", "__f")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], max_epochs: int = 1) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `alloc`. total: the budget, as an expression over the sum `all_tokens`."""
    a, b, c = LEVELS
    caps = leaves.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).alias("cap")).withColumn("w", _weight(c, weights))
    able = F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))
    second = caps.groupBy(a, b).agg(F.sum(able).alias("cap")).withColumn("w", _weight(b, weights))
    first = second.groupBy(a).agg(F.sum(able).alias("cap")).withColumn("w", _weight(a, weights))
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    top = first.crossJoin(F.broadcast(whole.select(total.cast("long").alias("budget"))))  # one row
    top = _deal(top, [], a).select(a, F.col("alloc").alias("budget"))
    mid = _deal(_join(second, top, [a]), [a], b).select(a, b, F.col("alloc").alias("budget"))
    return _deal(_join(caps, mid, [a, b]), [a, b], c).select(*LEVELS, "tokens", "alloc")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which null keys match."""
    other = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return left.join(other, on).drop(*[f"__{k}" for k in keys])


def plan(pieces: DataFrame, total: Column, weights: dict[str, dict[str, int]], max_epochs: int = 1, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """For each leaf: tokens, alloc, `epochs` (whole ones), and where the prefix of the next epoch ends:
    documents with (hash, doc_id) up to (`end_hash`, `end_id`) are in it, the last one with `end_tokens` tokens.

    pieces: domain, lang, source, doc_id, tokens.
    """
    leaves = pieces.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    dealt = cut(budgets(leaves, total, weights, max_epochs))
    dealt = dealt.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(1)).cast("long"))
    dealt = dealt.withColumn("need", F.when(F.col("tokens") > 0, F.col("alloc") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)))
    open_leaves = dealt.filter("need > 0").select(*LEVELS, "epochs", "need")
    inside = _join(pieces, small(open_leaves), list(LEVELS)).withColumn("h", order_hash(F.col("doc_id"), F.col("epochs"), seed)).withColumn("before", F.lit(0).cast("long"))
    by_leaf = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    width = 1 << 60
    for _ in range(ROUNDS):
        width = max(1, width // ranges)
        inside = inside.withColumn("part", F.expr(f"h div {width}"))
        parts = inside.groupBy(*LEVELS, "need", "before", "part").agg(F.sum("tokens").alias("n"))
        parts = parts.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(by_leaf), F.lit(0)))
        last = parts.filter("before < need and before + n >= need").select(*LEVELS, "part", "before")
        inside = _join(inside.drop("before"), small(cut(last)), [*LEVELS, "part"]).drop("part")
    inside = inside.groupBy(*LEVELS, "need", "before", "h", "doc_id").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*LEVELS).orderBy("h", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    ends = inside.filter("start < need and start + tokens >= need").select(*LEVELS, F.col("h").alias("end_hash"), F.col("doc_id").alias("end_id"), (F.col("need") - F.col("start")).alias("end_tokens"))
    keys = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in LEVELS]
    ends = ends.select(*[F.col(k).alias(f"__{k}") for k in LEVELS], "end_hash", "end_id", "end_tokens")
    return dealt.join(ends, keys, "left").drop(*[f"__{k}" for k in LEVELS], "need")


def mix(pieces: DataFrame, total: Column, weights: dict[str, dict[str, int]], max_epochs: int = 1, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """pieces with `copies` (times that the whole document is in the mix), `taken` (its tokens in the mix) and `in_prefix`."""
    made = small(cut(plan(pieces, total, weights, max_epochs, seed, ranges).select(*LEVELS, "epochs", "end_hash", "end_id", "end_tokens")))
    h = order_hash(F.col("doc_id"), F.col("epochs"), seed)
    below = (h < F.col("end_hash")) | ((h == F.col("end_hash")) & F.coalesce(F.col("doc_id") < F.col("end_id"), F.col("doc_id").isNull() & F.col("end_id").isNotNull()))
    at = (h == F.col("end_hash")) & F.col("doc_id").eqNullSafe(F.col("end_id"))
    out = _join(pieces, made, list(LEVELS)).withColumns({"__below": F.coalesce(below, F.lit(False)), "__at": F.coalesce(at, F.lit(False))})
    part = F.when(F.col("__below"), F.col("tokens")).when(F.col("__at"), F.least(F.col("tokens"), F.col("end_tokens"))).otherwise(F.lit(0))
    return out.withColumns({"copies": F.col("epochs"), "in_prefix": F.col("__below") | F.col("__at"), "taken": F.col("epochs") * F.col("tokens") + part}).drop("__below", "__at", "epochs", "end_hash", "end_id", "end_tokens")


def pieces_of(docs: DataFrame) -> DataFrame:
    return docs.select(domain_of(F.col("source")).alias("domain"), "lang", "source", "doc_id", token_count(F.col("text")).alias("tokens"))


def default_total() -> Column:
    """The query's budget: four fifths of the tokens that there are, in whole tokens."""
    return F.expr(f"(all_tokens * {round(SHARE * 100)}) div 100")


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies, taken, selected of every document."""
    pieces = cut(pieces_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = mix(pieces, default_total(), WEIGHTS)
    return out.select("doc_id", "domain", "lang", "source", "tokens", "copies", "taken", ((F.col("copies") > 0) | F.col("in_prefix")).alias("selected"))


def keep_selected(docs: DataFrame) -> DataFrame:
    """The documents that are in the mix, with all their columns, whole."""
    pieces = cut(pieces_of(docs))
    made = plan(pieces, default_total(), WEIGHTS)
    cols = docs.columns
    names = {k: fresh(docs, f"mix_{k}") for k in made.columns}
    made = small(cut(made.withColumnsRenamed(names)))
    domain = fresh(docs, "mix_domain_of")
    placed = docs.withColumn(domain, domain_of(F.col("source")))
    on = [placed[domain].eqNullSafe(made[names["domain"]]), placed["lang"].eqNullSafe(made[names["lang"]]), placed["source"].eqNullSafe(made[names["source"]])]
    epochs, end_hash, end_id = (F.col(names[k]) for k in ("epochs", "end_hash", "end_id"))
    h = order_hash(F.col("doc_id"), epochs, SEED)
    inside = (h < end_hash) | ((h == end_hash) & (F.coalesce(F.col("doc_id") <= end_id, F.col("doc_id").isNull())))
    keep = (epochs > 0) | F.coalesce(inside, F.lit(False))
    return placed.join(made, on).filter(keep).select(*[placed[f"`{c}`"] for c in cols])


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"(CASE {level} {cases} ELSE 1 END)::HUGEINT"


def _sql_deal(name: str, nodes: str, parents: list[str], level: str) -> str:
    by = ", ".join(parents) or "1"
    same = " AND ".join([f"o.{p} IS NOT DISTINCT FROM n.{p}" for p in parents] or ["true"])
    keys = ", ".join([*parents, level])
    return f"""
{name}_o AS (SELECT *, sum(cap) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS c,
    sum(w) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
    row_number() OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {level}) AS turn FROM {nodes}),
{name}_f AS (SELECT *, min(CASE WHEN NOT cap * ws <= (budget - c) * w THEN turn END) OVER (PARTITION BY {by}) AS first FROM {name}_o),
{name} AS (SELECT n.*, CASE WHEN n.first IS NULL OR n.turn < n.first THEN n.cap
    ELSE least(n.cap, ((n.budget - o.c) * n.w) // o.ws) END AS alloc
  FROM {name}_f n LEFT JOIN {name}_f o ON o.turn = n.first AND {same})"""


def oracle() -> str:
    """DuckDB SQL for op9. DuckDB has no CRC-32: the driver's sources src0 ... src99 are listed with theirs."""
    from zlib import crc32

    listed = ", ".join(f"('src{i}', {crc32(f'src{i}'.encode()) % 4})" for i in range(100))
    a, b, c = LEVELS
    return f"""
WITH crc(s, v) AS (VALUES {listed}),
pieces AS (SELECT doc_id, 'domain' || v AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::HUGEINT AS tokens
  FROM documents LEFT JOIN crc ON s = source),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS cap, {_sql_weight(c)} AS w FROM pieces GROUP BY ALL),
n1 AS (SELECT domain, sum(cap)::HUGEINT AS cap, {_sql_weight(a)} AS w, ((SELECT sum(tokens) FROM pieces) * {round(SHARE * 100)}) // 100 AS budget FROM leaves GROUP BY domain),
{_sql_deal("d1", "n1", [], a)},
n2 AS (SELECT l.domain, l.lang, sum(l.cap)::HUGEINT AS cap, {_sql_weight(b).replace("CASE lang", "CASE l.lang")} AS w, any_value(d1.alloc) AS budget FROM leaves l JOIN d1 ON d1.domain = l.domain GROUP BY l.domain, l.lang),
{_sql_deal("d2", "n2", [a], b)},
n3 AS (SELECT l.*, d2.alloc AS budget FROM leaves l JOIN d2 ON d2.domain = l.domain AND d2.lang = l.lang),
{_sql_deal("d3", "n3", [a, b], c)},
placed AS (SELECT p.*, d.alloc // d.cap AS copies, d.alloc % d.cap AS need,
    ('0x' || substr(md5('{SEED}:' || (d.alloc // d.cap)::VARCHAR || ':' || p.doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM pieces p JOIN d3 d ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS start FROM placed)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, copies::BIGINT AS copies,
  (copies * tokens + greatest(0, least(tokens, need - start)))::BIGINT AS taken, copies > 0 OR start < need AS selected FROM run
"""
