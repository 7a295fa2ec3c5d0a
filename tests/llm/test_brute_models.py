"""Quality, toxicity and disclosure against plain Python over the same rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm import pii, quality, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))]
        bad = i % 3 == 0
        if bad:
            for w in ("abominable", "abominably", "loathsome" + rng.choice("xyz")):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), f"h{min(4, int(rng.expovariate(0.7)))}", rng.choice("ab")))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_fit(spark):
    rows, labels = made(240, 5)
    toxic = dict(labels)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    train = [(t.split(), toxic[i]) for i, t, *_ in rows if not held_out(i)]
    features = lambda w: [*(w[:n] + "*" for n in (4, 7) if len(w) > n), w]
    docs = [Counter(), Counter()]
    for words, y in train:
        docs[y].update({f for w in words for f in features(w)})
    n = Counter(y for _, y in train)
    chosen = set()
    for f in docs[0].keys() | docs[1].keys():
        a, b = docs[0][f], docs[1][f]
        x = math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1))
        if a + b >= 5 and x >= math.log(2) and x / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= 3:
            chosen.add(f)
    contexts = defaultdict(set)
    for words, y in train:
        for k, w in enumerate(words):
            for f in set(features(w)) & chosen:
                contexts[f, y].add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    total = [sum(len(w) for w, y in train if y == c) for c in (0, 1)]
    want = {}
    for f in sorted(chosen, key=lambda f: (not f.endswith("*"), len(f))):
        clean, bad = len(contexts[f, 0]), len(contexts[f, 1])
        above = [f.rstrip("*")[:k] + "*" for k in (7, 4) if len(f.rstrip("*")) > k]
        mean = next((want[a] for a in above if a in want), 0.0)
        if clean + bad < 5:
            continue
        share = 1 / (1 + math.exp(-mean))
        spread = 10 / (2 * (clean + bad) / sum(total))
        x = math.log((bad + 10 * share) / (total[1] + spread)) - math.log((clean + 10 * (1 - share)) / (total[0] + spread))
        z = x / math.sqrt(1 / (bad + 10 * share + 0.5) + 1 / (clean + 10 * (1 - share) + 0.5))
        if z >= 3:
            want[f] = x
        elif z < 1:
            want[f] = 0.0
    assert want and model.log_odds.keys() == want.keys()
    assert all(model.log_odds[f] == pytest.approx(x) for f, x in want.items())


def test_quality_posteriors_and_scores(spark):
    rows, labels = made(300, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    bins = {r.doc_id: r.asDict() for r in quality.measures(docs).collect()}
    names = [c for c in next(iter(bins.values())) if c.startswith("m_")]
    good = {i: y for i, y in labels if not held_out(i)}
    totals = [sum(y == c for y in good.values()) for c in (0, 1)]
    odds = {}
    for m in names:
        counts = Counter((bins[i][m], y) for i, y in good.items())
        for b in {b for b, _ in counts}:
            prior = 4 * (counts[b, 0] + counts[b, 1]) / sum(totals)
            odds[m, b] = math.log((counts[b, 1] + prior) / (totals[1] + 4)) - math.log((counts[b, 0] + prior) / (totals[0] + 4))
    evidence = {i: sum(odds.get((m, bins[i][m]), 0.0) for m in names) for i in bins}
    halves = Counter((math.floor(2 * evidence[i] + 0.5) if evidence[i] >= 0 else -math.floor(-2 * evidence[i] + 0.5), y) for i, y in good.items())
    intercept, slope = quality.logistic([(x / 2, y, n) for (x, y), n in halves.items()])
    p = {i: 1 / (1 + math.exp(-(intercept + slope * e))) for i, e in evidence.items()}
    site = {i: (h, q) for i, _, h, q in rows}
    paths, hosts = defaultdict(list), defaultdict(list)
    for i, (h, q) in site.items():
        paths[h, q].append(p[i])
        hosts[h].append(p[i])
    mean = sum(p.values()) / len(p)

    def strength(groups, means):
        n = sum(map(len, groups.values()))
        between = sum(len(x) * (sum(x) / len(x) - means[k]) ** 2 for k, x in groups.items())
        within = sum(means[k] * (1 - means[k]) for k in groups)
        spread = sum(len(x) * means[k] * (1 - means[k]) for k, x in groups.items()) / n
        return max(spread / max((between - within) / n, 1e-6) - 1, 1e-3)

    of_hosts = strength(hosts, dict.fromkeys(hosts, mean))
    host_mean = {h: (sum(x) + of_hosts * mean) / (len(x) + of_hosts) for h, x in hosts.items()}
    of_paths = strength(paths, {k: host_mean[k[0]] for k in paths})
    logit = lambda x: math.log(min(max(x, 1e-9), 1 - 1e-9) / (1 - min(max(x, 1e-9), 1 - 1e-9)))
    for i, (h, q) in site.items():
        xs = paths[h, q]
        without = (sum(xs) - p[i] + of_paths * host_mean[h]) / (len(xs) - 1 + of_paths)
        score = 1 / (1 + math.exp(-(logit(p[i]) + logit(without) - logit(mean))))
        assert got[i].document == pytest.approx(p[i]) and got[i].host_mean == pytest.approx(host_mean[h])
        assert got[i].path_mean == pytest.approx((sum(xs) + of_paths * host_mean[h]) / (len(xs) + of_paths))
        assert got[i].score == pytest.approx(score, rel=1e-6)


def test_disclosure(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["term%s" % c for c in "abcdefghij"] + ["ab", "of"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))]
        if i % 3 == 0:
            k = rng.randrange(len(words))
            words[k:k] = [*([f"secret{i % 2}"] if rng.random() < 0.8 else []), *([" " * 400] if i % 9 == 0 else []), rng.choice(("eve@x.example", "10.0.0.7", "+49 30 1234567"))]
        rows.append((i, " ".join(words)))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found = {r.doc_id: {(t.a, t.b) for t in r.terms or []} for r in pii.spans_of(spark.read.parquet(path)).collect()}
    contexts, places, corpus = defaultdict(dict), [], Counter()
    for i, text in rows:
        corpus.update(re.findall(r"\w+", text.lower()))
        spans = pii.base_spans(text)
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        for a, b, kind in spans:
            near = [w for w in words if w[2] <= a][-6:] + [w for w in words if w[1] >= b][:6]
            near = [w for w in near if not any(w[1] < y and x < w[2] for x, y, _ in spans)]
            entity = (kind, text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b]))
            contexts[entity][" ".join(w for w, _, _ in near)] = {w for w, _, _ in near if len(w) >= 3}
            places += [(i, entity, w, x, y) for w, x, y in near if len(w) >= 3]
    total = sum(len(c) for c in contexts.values())
    n_words = sum(len(t.split()) for _, t in rows)
    told = set()
    for e, cs in contexts.items():
        for w, k in Counter(w for ws in cs.values() for w in ws).items():
            share = min(1.0, corpus[w] * 12 / n_words)
            if len(cs) >= 2 and k >= 2 and math.log(k / len(cs) / share) >= max(0.5 * -math.log(len(cs) / max(total, len(cs) + 1)), 1e-9):
                told.add((e, w))
    want = defaultdict(set)
    for i, e, w, a, b in places:
        if (e, w) in told:
            want[i].add((a, b))
    assert told and found == {i: want[i] for i, _ in rows}
