import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing as M


def deal(budget, children):
    """[(cap, weight)] -> shares: fill in rounds; each round's unfilled children share by weight, those that it fills are closed."""
    out, open_ = [0] * len(children), [i for i, (_, w) in enumerate(children) if w > 0]
    left = budget
    while open_:
        total = sum(children[i][1] for i in open_)
        full = [i for i in open_ if children[i][0] * total <= left * children[i][1]]
        if not full:
            for i in open_:
                out[i] = left * children[i][1] // total
            break
        for i in full:
            out[i] = children[i][0]
        left -= sum(children[i][0] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def brute(rows, total, weights, max_epochs):
    """{(domain, lang, source): alloc}; rows: (domain, lang, source, doc_id, tokens)."""
    w = lambda level, v: max(0, weights.get(level, {}).get(v, 1))
    leaves = {}
    for d, l, s, _, n in rows:
        leaves[d, l, s] = leaves.get((d, l, s), 0) + n
    cap = {k: n * max_epochs for k, n in leaves.items()}
    able = {k: c if w("source", k[2]) else 0 for k, c in cap.items()}
    mids = {k[:2] for k in leaves}
    mid_cap = {m: sum(c for k, c in able.items() if k[:2] == m) for m in mids}
    tops = sorted({k[0] for k in leaves}, key=str)
    top_cap = {t: sum(c for m, c in mid_cap.items() if m[0] == t and w("lang", m[1])) for t in tops}
    out = {}
    for t, b in zip(tops, deal(total, [(top_cap[t], w("domain", t)) for t in tops]), strict=True):
        ms = sorted((m for m in mids if m[0] == t), key=str)
        for m, c in zip(ms, deal(b, [(mid_cap[m], w("lang", m[1])) for m in ms]), strict=True):
            ks = sorted((k for k in leaves if k[:2] == m), key=str)
            out |= dict(zip(ks, deal(c, [(cap[k], w("source", k[2])) for k in ks]), strict=True))
    return out, leaves


@pytest.mark.parametrize(("share", "epochs", "ranges"), [(0.5, 1, 1024), (0.9, 1, 2), (1.7, 3, 7), (5.0, 2, 16)])
def test_against_brute_force(spark, share, epochs, ranges):
    rng = random.Random(int(share * 10))
    rows = [(rng.choice(["a", "b", None]), rng.choice(["en", "de", "xx"]), f"s{min(9, int(rng.expovariate(0.6)))}", i, rng.choice((0, rng.randrange(1, 60)))) for i in range(400)]
    rows += [("a", "en", "s0", 7, 5)] * 3
    weights = {"domain": {"a": 5, "b": 1}, "lang": {"en": 7, "xx": 0}, "source": {"s1": 3, "s2": 0}}
    df = spark.createDataFrame(rows, "domain string, lang string, source string, doc_id long, tokens long").repartition(3)
    total = int(share * sum(r[4] for r in rows))
    alloc, leaves = brute(rows, total, weights, epochs)
    made = {(r.domain, r.lang, r.source): r.alloc for r in M.plan(df, F.lit(total), weights, epochs, ranges=ranges).collect()}
    assert made == alloc
    taken = {}
    for r in M.mix(df, F.lit(total), weights, epochs, ranges=ranges).collect():
        k = (r.domain, r.lang, r.source)
        taken[k] = taken.get(k, 0) + r.taken
        assert r.copies == (alloc[k] // leaves[k] if leaves[k] else 1)
    for k, n in taken.items():
        # a repeated doc_id at the end of a prefix counts as one piece
        assert n == alloc[k] or (k == ("a", "en", "s0") and abs(n - alloc[k]) <= 200)


def test_prefix_is_in_seeded_order(spark):
    rows = [("d", "l", "s", i, 10) for i in range(50)]
    df = spark.createDataFrame(rows, "domain string, lang string, source string, doc_id long, tokens long")
    sets = []
    for total, seed in ((105, 1), (205, 1), (205, 2)):
        got = {r.doc_id: r.taken for r in M.mix(df, F.lit(total), {}, seed=seed).collect() if r.in_prefix}
        assert sum(got.values()) == total and len(got) == total // 10 + 1
        sets.append(set(got))
    assert sets[0] <= sets[1] and sets[1] != sets[2]


def test_edge_rows(docs, empty):
    out = M.keep_selected(docs)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert M.keep_selected(empty).count() == 0
    assert M.mix(M.pieces_of(empty), M.default_total(), M.WEIGHTS).count() == 0
    assert M.mix(M.pieces_of(docs), M.default_total(), M.WEIGHTS).count() == docs.count()
