"""Near-duplicate join: 5-word shingles of Jaccard similarity 0.8 or more, by a MinHash LSH forest.

Each document's MinHash signature is dealt to the tries of a forest: in each trie its values
are a path from the root, and a node is the set of documents that share a prefix of their
paths. A trie is kept as its sorted paths (of the documents that share the shortest prefix
looked at with another one). The join goes up the tries level by level, from full paths to
shorter prefixes. At each level a document that is still open is compared with all that
share the prefix in some trie and haven't been met deeper down. After each level the recall
of each document is estimated from the links found so far: a link of similarity s is met at
depth d with probability P = 1 - (1 - s^d)^trees, so n links found stand for sum 1/P links,
and one more link at the threshold, which may have been missed, is counted with them. Where
n + 1 is at least the target share of that estimate, the document is closed: its prefix is
shortened no further. At the depth that meets the target for a link at the threshold
(`prefix_depth`) all are. So documents in large groups of near copies stop at long prefixes,
and those with few or no links go on to the shortest. Every candidate is verified on the
whole shingle sets, which are sets of 32-bit hashes.

Documents with equal shingle sets are one class, and only one of each takes part. In a node
of at most SMALL classes their pairs are formed. Larger nodes are joined where they overlap;
the classes of such a crowd are dealt to blocks, and a pair of blocks is one matrix product
over those of their classes that share a prefix. What leaves a pair of blocks is the number
of links of each class and a spanning forest of them, never the pairs themselves. So every
link is counted, no task holds or emits the pairs of a crowd, and SMALL and BLOCK have no
bearing on the result.

Result: one row per document with its group (`class_id`, the least doc_id of all that are
connected by links), its number of links (`n_links`: other documents of similarity 0.8 or
more, those with an equal set included), and `set_id`, the least doc_id with the same set.

Rows: words are runs of letters, digits and underscores of the lower-cased text. A document
of fewer than five words has one shingle of all its words. Null, empty and wordless texts
are equal to each other and to nothing else. Repeated rows count as documents of their own;
null doc_ids are less than others only where there is no other. An empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk_cache import held, release, slices
from .common import cut, few, join_hot, small, tagged, text_of, written
from .components import components
from .shingles import WordHasher, mix, shingle_hashes, words_of

WIDTH = 5
SIMILARITY = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.99
#: Classes in a node up to which their pairs are formed one by one.
SMALL = 24
#: Classes in a block of a crowd; a crowd of m ships its sets m / BLOCK times.
BLOCK = 512


def recall(depth: int, trees: int = TREES, similarity=SIMILARITY):
    """Chance that two documents of that similarity (a number or an array) share a prefix of that depth in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(target: float = RECALL, trees: int = TREES, depth: int = DEPTH, similarity: float = SIMILARITY) -> int:
    """The full depth, shortened step by step until the target recall is met."""
    while depth > 1 and recall(depth, trees, similarity) < target:
        depth -= 1
    return depth


class Signer:
    """Paths of shingle sets in the tries: hashes of the prefixes of `least` to `depth` values."""

    def __init__(self, trees: int, depth: int, least: int):
        self.trees, self.depth, self.least = trees, depth, least
        rng = np.random.default_rng(20240)
        self.factor = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def prefixes(self, shingles: np.ndarray) -> np.ndarray:
        """A row per trie: the key of the prefix of each length, from `least` on."""
        lowest = np.full(self.trees * self.depth, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 1024):
            np.minimum(lowest, (shingles[i : i + 1024, None] * self.factor + self.shift).min(0), out=lowest)
        path = lowest.reshape(self.trees, self.depth)
        key = np.arange(1, self.trees + 1, dtype=np.uint64)
        out = np.zeros((self.trees, self.depth - self.least + 1), np.uint64)
        for d in range(self.depth):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + path[:, d])
            if d + 1 >= self.least:
                out[:, d + 1 - self.least] = key
        return out


_PRINT = "doc_id long, tag long, c binary, n int, paths binary, gaps binary"
_PRINT_ARROW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("c", pa.binary()), ("n", pa.int32()), ("paths", pa.binary()), ("gaps", pa.binary())])


def _fingerprints(trees: int, depth: int, least: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, signer = held("word hashes", WordHasher), Signer(trees, depth, least)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                at = 0
                for texts in slices(part.column(2).to_pylist()):
                    words = [words_of(t) for t in texts]
                    flat = hasher.hashes([w for ws in words for w in ws])
                    ends = np.cumsum([len(ws) for ws in words]).tolist()
                    c, n, paths, gaps = [], [], [], []
                    for end, ws in zip(ends, words, strict=True):
                        s = np.unique(shingle_hashes(flat[end - len(ws) : end], width) >> np.uint64(32))
                        raw = s.astype("<u4")
                        c.append(xxhash.xxh3_128_digest(raw.tobytes()))
                        n.append(len(s))
                        paths.append(signer.prefixes(mix(s)).astype("<u8").tobytes() if len(s) else None)
                        gaps.append(np.diff(raw, prepend=np.uint32(0)).astype("<u4").tobytes())
                    own = part.slice(at, len(texts))
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(c, pa.binary()), pa.array(n, pa.int32()), pa.array(paths, pa.binary()), pa.array(gaps, pa.binary())], schema=_PRINT_ARROW)

    return run


def _tries(trees: int, levels: int):
    """(c, k0, k1, ...): for each class and trie the keys of its prefixes, shortest first."""
    names = ["c", *[f"k{i}" for i in range(levels)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8").reshape(-1, levels)
                c = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), trees)))
                yield pa.RecordBatch.from_arrays([c, *[pa.array(keys[:, k]) for k in range(levels)]], names=names)

    return run, ", ".join(["c binary", *[f"{n} long" for n in names[1:]]])


def _set(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, "<u4"), dtype=np.uint64).astype(np.uint32)


def _linked(common, n_a, n_b, similarity: float):
    """Whether sets of n_a and n_b with so many common shingles are similar enough."""
    return common + 1e-9 * (1 + common) >= similarity * (n_a + n_b - common)


def _shared(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Whether the paths a[i] and b[j] share the prefix of this level in some trie and none longer in any. Paths: classes x tries x levels."""

    def any_trie(at: int) -> np.ndarray:
        out = np.zeros((len(a), len(b)), bool)
        for t in range(a.shape[1]):
            out |= a[:, t, at][:, None] == b[:, t, at][None, :]
        return out

    return any_trie(level) & ~any_trie(level + 1) if level + 1 < a.shape[2] else any_trie(level)


def _verify_pairs(similarity: float, trees: int, levels: int, level: int):
    """Links among candidate pairs that haven't been met at a longer prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                hit, like = [], []
                for r in batch.slice(i, 256).to_pylist():
                    small, large = sorted((r["n_a"], r["n_b"]))
                    if small < similarity * large - 1e-9:
                        continue
                    if level + 1 < levels:
                        x, y = (np.frombuffer(r[k], "<i8").reshape(trees, levels)[:, level + 1] for k in ("paths_a", "paths_b"))
                        if (x == y).any():
                            continue
                    common = len(np.intersect1d(_set(r["gaps_a"]), _set(r["gaps_b"]), assume_unique=True))
                    if _linked(common, small, large, similarity):
                        hit.append(r)
                        like.append(common / (small + large - common))
                yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in hit], t) for k, t in (("a", pa.binary()), ("b", pa.binary()), ("w_a", pa.int64()), ("w_b", pa.int64()))], pa.array(like, pa.float64())], names=["u", "v", "w_u", "w_v", "s"])

    return run


def common_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    out = np.zeros((len(a), len(b)))
    flat_a, flat_b = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (a, b))
    shared = np.intersect1d(flat_a, flat_b)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    (row_a, col_a), (row_b, col_b) = places(a, flat_a), places(b, flat_b)
    for low in range(0, len(shared), columns):
        high = min(len(shared), low + columns)
        m = []
        for sets, row, col in ((a, row_a, col_a), (b, row_b, col_b)):
            i, j = np.searchsorted(col, [low, high])
            x = np.zeros((len(sets), high - low), np.float32)
            x[row[i:j], col[i:j] - low] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links of a bipartite matrix connect; columns count on from the rows."""
    rows, cols = linked.shape
    left, right = np.arange(rows), rows + np.arange(cols)
    far = rows + cols
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], far).min(0, initial=far))
        new_left = np.minimum(left, np.where(linked, new_right[None, :], far).min(1, initial=far))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    label = np.concatenate([left, right])
    return [(i, int(x)) for i, x in enumerate(label) if i != x]


def _verify_blocks(similarity: float, trees: int, levels: int, depths: list[int], level: int):
    """Rows of links (v null): class, linked documents and classes, what those stand for at each depth; rows of edges (v not null)."""

    def load(row: dict, side: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        cs = [row[f"cs_{side}"][i : i + 16] for i in range(0, len(row[f"cs_{side}"]), 16)]
        paths = np.frombuffer(row[f"paths_{side}"], "<i8").reshape(len(cs), trees, levels)
        return cs, np.frombuffer(row[f"ws_{side}"], "<i8"), paths, np.frombuffer(row[f"open_{side}"], "?")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (cs_a, w_a, p_a, open_a), (cs_b, w_b, p_b, open_b) = load(row, "a"), load(row, "b")
                met = _shared(p_a, p_b, level) & (open_a[:, None] | open_b[None, :])
                same = row["i"] == row["j"]
                if same:
                    np.fill_diagonal(met, False)
                rows, cols = np.flatnonzero(met.any(1)), np.flatnonzero(met.any(0))
                a, b = ([_set(row[f"sets_{x}"][k]) for k in at.tolist()] for x, at in (("a", rows), ("b", cols)))
                n_a, n_b = (np.array([len(s) for s in x]) for x in (a, b))
                common = common_counts(a, b)
                linked = _linked(common, n_a[:, None], n_b[None, :], similarity) & met[np.ix_(rows, cols)]
                like = common / np.maximum(n_a[:, None] + n_b[None, :] - common, 1)
                stands = [np.where(linked, 1 / recall(d, trees, np.where(linked, like, 1.0)), 0) for d in depths]
                totals = [([cs_a[k] for k in rows], linked @ w_b[cols], linked.sum(1), [x.sum(1) for x in stands])]
                if not same:
                    totals.append(([cs_b[k] for k in cols], linked.T @ w_a[rows], linked.sum(0), [x.sum(0) for x in stands]))
                names = [cs_a[k] for k in rows] + [cs_b[k] for k in cols]
                edges = [(names[x], names[y]) for x, y in _forest(linked) if names[x] != names[y]]
                out = [(c, None, int(links), int(n), [float(x[k]) for x in est]) for cs, w, m, est in totals for k, (c, links, n) in enumerate(zip(cs, w, m, strict=True)) if n]
                out += [(x, y, 0, 0, []) for x, y in edges]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_FOUND_ARROW)], names=["u", "v", "w", "n", "stands"])

    return run


_FOUND = "u binary, v binary, w long, n long, stands array<double>"
_FOUND_ARROW = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.float64()))


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    cs, paths = (b"".join(table.column(c).to_pylist()) for c in ("c", "paths"))
    ws = table.column("w").to_numpy().astype("<i8").tobytes()
    open_ = table.column("open").to_numpy(zero_copy_only=False).astype(bool).tobytes()
    one = {"crowd": [key[0].as_py()], "block": [key[1].as_py()], "cs": [cs], "ws": [ws], "paths": [paths], "open": [open_], "sets": [table.column("gaps").to_pylist()]}
    return pa.table(one, schema=pa.schema([("crowd", pa.binary()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("cs", "ws", "paths", "open")], ("sets", pa.list_(pa.binary()))]))


class _Join:
    """The level-by-level join. tries: (c, k0, k1, ...) of the classes that share k0 with another; sets: (c, n, w, paths, gaps) of them."""

    def __init__(self, tries: DataFrame, sets: DataFrame, similarity: float, trees: int, depths: list[int]):
        self.tries, self.sets, self.similarity, self.trees, self.depths = tries, sets, similarity, trees, depths

    def crowds(self, rows: DataFrame, nodes: DataFrame) -> DataFrame | None:
        """(c, crowd) of the classes in nodes of more than SMALL, joined where they overlap."""
        large = nodes.filter(f"m > {SMALL}").select("k", F.col("a.c").alias("v"))
        if not large.limit(1).count():
            return None
        return small(components(rows.join(small(large), "k").select(F.col("c").alias("u"), "v")).select(F.col("node").alias("c"), F.col("label").alias("crowd")))

    def pairs(self, rows: DataFrame, nodes: DataFrame, crowds: DataFrame | None) -> DataFrame:
        """(a, b) of classes that share a node of at most SMALL, one of them open, and aren't in the same crowd."""
        wanted = small(nodes.filter(f"m between 3 and {SMALL}").select("k"))
        lists = rows.join(wanted, "k").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "child", "open"))).alias("xs"))
        each = lists.select(F.explode(F.expr("flatten(transform(xs, (x, i) -> transform(slice(xs, i + 2, size(xs)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
        each = each.unionByName(nodes.filter("m = 2").select("a", "b")).filter("a.c <> b.c and a.child <> b.child and (a.open or b.open)")
        each = each.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).dropDuplicates()
        if crowds is not None:
            of_a, of_b = (small(crowds.select(F.col("c").alias(x), F.col("crowd").alias(f"crowd_{x}"))) for x in "ab")
            each = each.join(of_a, "a", "left").join(of_b, "b", "left").filter("crowd_a is null or crowd_b is null or crowd_a <> crowd_b").select("a", "b")
        return few(each)

    def in_blocks(self, crowds: DataFrame, closed: DataFrame | None, level: int) -> DataFrame:
        """Links within crowds. Blocks of open classes are compared with all, those of closed ones not with each other."""
        members = crowds.withColumn("open", F.lit(True)) if closed is None else crowds.join(_shut(closed), "c", "left").fillna(True, ["open"])
        sized = members.groupBy("crowd").agg(F.ceil(F.sum(F.col("open").cast("int")) / BLOCK).cast("int").alias("opens"), F.ceil(F.sum((~F.col("open")).cast("int")) / BLOCK).cast("int").alias("rest"))
        sized = small(cut(sized))
        block = F.when(F.col("open"), F.pmod(F.xxhash64("c"), F.col("opens"))).otherwise(F.col("opens") + F.pmod(F.xxhash64("c"), F.col("rest"))).cast("int")
        dealt = join_hot(members, sized, "crowd", ["opens", "rest"]).select("c", "crowd", "open", block.alias("block"))
        packed = self.sets.join(few(dealt), "c").select("crowd", "block", "c", "w", "paths", "open", "gaps").groupBy("crowd", "block").applyInArrow(_pack, "crowd binary, block int, cs binary, ws binary, paths binary, open binary, sets array<binary>")
        packed = written(packed, "blocks")
        grid = sized.filter("opens > 0").select("crowd", F.explode(F.sequence(F.lit(0), F.col("opens") - 1)).alias("i"), (F.col("opens") + F.col("rest")).alias("all"))
        grid = grid.select("crowd", "i", F.explode(F.sequence("i", F.col("all") - 1)).alias("j"))
        side = {x: packed.select("crowd", F.col("block").alias(at), *[F.col(c).alias(f"{c}_{x}") for c in ("cs", "ws", "paths", "open", "sets")]) for x, at in (("a", "i"), ("b", "j"))}
        pairs = grid.join(side["a"], ["crowd", "i"]).join(side["b"], ["crowd", "j"])
        return written(pairs.mapInArrow(_verify_blocks(self.similarity, self.trees, len(self.depths), self.depths, level), _FOUND), "crowd-links")

    def at(self, level: int, closed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Edges (u, v), and (c, w, n, stands) of links, among classes that share the prefix of this level and none longer, one of them not in `closed`."""
        child = F.col(f"k{level + 1}") if level + 1 < len(self.depths) else F.xxhash64("c")
        rows = self.tries.select("c", F.col(f"k{level}").alias("k"), child.alias("child"))
        rows = rows.withColumn("open", F.lit(True)) if closed is None else rows.join(_shut(closed), "c", "left").fillna(True, ["open"])
        one = F.struct("c", "child", "open")
        nodes = rows.groupBy("k").agg(F.count("*").alias("m"), F.min(one).alias("a"), F.max(one).alias("b"), F.min("child").alias("first"), F.max("child").alias("last"), F.max("open").alias("open"))
        nodes = cut(nodes.filter("m > 1 and open and first <> last").drop("first", "last", "open"))
        crowds = self.crowds(rows, nodes)
        pairs = self.pairs(rows, nodes, crowds)
        side = {x: self.sets.select(*[F.col(c).alias(x if c == "c" else f"{c}_{x}") for c in ("c", "n", "w", "gaps", "paths")]) for x in "ab"}
        found = pairs.join(side["a"], "a").join(side["b"], "b")
        links = written(found.mapInArrow(_verify_pairs(self.similarity, self.trees, len(self.depths), level), "u binary, v binary, w_u long, w_v long, s double"), "links")
        edges = links.select("u", "v")
        stands = F.array(*[1 / (1 - F.pow(1 - F.pow("s", F.lit(d)), F.lit(self.trees))) for d in self.depths])
        ends = [links.select(F.col(c).alias("c"), F.col(f"w_{o}").alias("w"), F.lit(1).cast("long").alias("n"), stands.alias("stands")) for c, o in (("u", "v"), ("v", "u"))]
        degrees = ends[0].unionByName(ends[1])
        if crowds is not None:
            found = self.in_blocks(crowds, closed, level)
            edges = edges.unionByName(found.filter("v is not null").select("u", "v"))
            degrees = degrees.unionByName(found.filter("v is null").select(F.col("u").alias("c"), "w", "n", "stands"))
        return edges, degrees


def _shut(closed: DataFrame) -> DataFrame:
    return small(closed.select("c", F.lit(False).alias("open")))


def _summed(degrees: DataFrame, depths: list[int]) -> DataFrame:
    return degrees.groupBy("c").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.array(*[F.sum(F.col("stands")[i]) for i in range(len(depths))]).alias("stands"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, target: float = RECALL, trees: int = TREES, depth: int = DEPTH, tag: Column | None = None) -> DataFrame:
    """doc_id, class_id, n_links, set_id, tag (by default a new one) and kept (whether it is the one of its group that stays) of every row of docs (doc_id, text)."""
    tag = F.monotonically_increasing_id() if tag is None else tag
    least = prefix_depth(target, trees, depth, similarity)
    depths = list(range(least, depth + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), text_of().alias("text"))
    prints = written(rows.mapInArrow(_fingerprints(trees, depth, least, width), _PRINT), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    classes = cut(prints.select("doc_id", "tag", "c").groupBy("c").agg(first, F.count("*").alias("w")))
    ones = small(classes.select(F.col("first.tag").alias("tag")))
    run, schema = _tries(trees, len(depths))
    paths = written(prints.filter("paths is not null").select("tag", "c", "paths").join(ones, "tag", "left_semi").select("c", "paths").mapInArrow(run, schema), "paths")
    shared = cut(paths.groupBy("k0").agg(F.count("*").alias("m")).filter("m > 1").select("k0"))
    tries = written(paths.join(small(shared), "k0").sortWithinPartitions(*[f"k{i}" for i in range(len(depths))]), "tries")
    # by the tag of the one row of a class that takes part: by class, all copies of a text would meet
    busy = tries.select("c").dropDuplicates().join(classes, "c").select(F.col("first.tag").alias("tag"), "w")
    sets = written(prints.select("tag", "c", "n", "paths", "gaps").join(few(busy), "tag").drop("tag"), "sets")

    join = _Join(tries, sets, similarity, trees, depths)
    edges, degrees, closed = None, None, None
    for level in range(len(depths) - 1, -1, -1):
        more, links = join.at(level, closed)
        edges = more if edges is None else edges.unionByName(more)
        degrees = few(_summed(links if degrees is None else degrees.unionByName(links), depths))
        at_threshold = F.lit(1 / recall(depths[level], trees, similarity))
        if level:
            closed = few(degrees.filter((F.col("n") + 1) / (F.col("stands")[level] + at_threshold) >= target).select("c"))
    groups = small(components(edges).select(F.col("node").alias("c"), F.col("label").alias("group")))
    placed = classes.withColumnRenamed("w", "copies").join(groups, "c", "left").withColumn("group", F.coalesce("group", "c")).join(small(degrees.select("c", F.col("w").alias("links"))), "c", "left")
    placed = cut(placed)
    heads = cut(placed.groupBy("group").agg(F.min("first").alias("head")))
    placed = join_hot(placed, heads, "group", ["head"]).select("c", F.col("head.doc_id").alias("class_id"), F.col("head.tag").alias("head_tag"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("first.doc_id").alias("set_id"))
    placed = written(placed, "placed")
    every = join_hot(prints.select("doc_id", "tag", "c"), placed, "c", ["class_id", "head_tag", "n_links", "set_id"])
    return every.select("doc_id", "class_id", "n_links", "set_id", "tag", (F.col("tag") == F.col("head_tag")).alias("kept"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("tag", "kept")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group."""
    rows, tag = tagged(docs)
    gone = near_duplicates(rows, tag=F.col(f"`{tag}`")).filter(~F.col("kept")).select(F.col("tag").alias(tag))
    return rows.join(gone, tag, "left_anti").drop(tag)
