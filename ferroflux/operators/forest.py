"""Random forests grown from histograms at the top and within tasks below.

Columns are cut into bins once and rows stored as bytes. Nodes of more than ``LOCAL`` rows are
split level by level: each task sends its rows down the trees grown so far, counts (node,
feature, bin, class) of the nodes at the border, hands on what it has counted whenever that
is much, and the counts are added up by chunks of nodes, in which the best splits are
searched. Then each drawn row moves once to its small node, groups of which are bounded
by ``LOCAL``, and a task grows all that is below. Several fits on parts of the same rows,
such as folds, grow side by side.

Where the learned rows as bytes take at most ``HELD`` in all, each task gets all of them instead and grows
whole trees, so that no row moves once for each tree. Larger tables go the way above.

A node is split only if it holds at least ``split`` rows; each side keeps at least
``leaf``. Rows are drawn for a tree with Poisson weights from a hash of their features, and
a node's features by a hash of its place in the tree, so results don't depend on how
rows lie in partitions or where the border between large and small nodes is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import materialize

TREES, DEPTH, LEAF, SPLIT, SEED, BINS = 200, 12, 2, 5, 42, 64
#: Nodes whose histograms are searched at once, counts and (row, tree) pairs that a task holds at once.
CHUNK, COUNTS, CELLS = 16, 1 << 20, 1 << 18
#: Rows of a node whose whole subtree one task grows, and of a group of such nodes but for its last one.
LOCAL = 1 << 15
#: Bytes of the learned rows up to which every task holds all of them, and rows that a task counts at once, so that its arrays stay in a core's cache.
HELD, STEP = 1 << 28, 1 << 13
#: Weights above this many draws don't occur; the law is Poisson's with mean 1.
_DRAWS = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 8.0)))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    x = x.astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def draws(rows: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each row (by its hash) is drawn for each tree."""
    salt = _mix(trees.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    share = (_mix(rows.view(np.uint64)[:, None] ^ salt[None, :]) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_DRAWS, share, side="right").astype(np.uint8)


def chosen_features(nodes: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """The features, a square root of all, that each node may split on."""
    m = max(1, int(np.sqrt(columns)))
    rank = _mix(nodes.astype(np.uint64)[:, None] * np.uint64(columns) + np.arange(columns, dtype=np.uint64) + np.uint64((seed + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
    return np.argpartition(rank, m - 1, axis=1)[:, :m].astype(np.int64) if m < columns else np.tile(np.arange(columns), (len(nodes), 1))


@dataclass
class Forest:
    """Trees as arrays over all nodes: feature (-1 at a leaf), cut (bins up to it go left), children, class counts, rows."""

    labels: list[str]
    columns: list[str]
    edges: list[np.ndarray]
    trees: int
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    rows: np.ndarray

    @property
    def fits(self) -> int:
        return len(self.root) // self.trees

    def descend(self, x: np.ndarray, trees: slice, levels: int | None = None) -> np.ndarray:
        """The node that each row of bins reaches in each tree."""
        node = np.tile(self.root[trees], (len(x), 1))
        at = np.arange(len(x))[:, None]
        while levels is None or levels > 0:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[at, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, np.where(right, self.right[node], self.left[node]), node)
            levels = None if levels is None else levels - 1
        return node

    def shares(self) -> np.ndarray:
        """Class shares of each node."""
        return self.counts / np.maximum(self.counts.sum(axis=1, keepdims=True), 1e-300)

    def probabilities(self, x: np.ndarray, fit: int = 0, shares: np.ndarray | None = None) -> np.ndarray:
        """Mean class shares of the leaves that rows of bins reach; ``shares``, if they are at hand, spare their division."""
        shares, out = self.shares() if shares is None else shares, np.zeros((len(x), len(self.labels)))
        step = max(1, CELLS // max(1, len(x)))
        for t in range(fit * self.trees, (fit + 1) * self.trees, step):
            out += shares[self.descend(x, slice(t, min(t + step, (fit + 1) * self.trees)))].sum(axis=1)
        return out / self.trees

    def binned(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.edges)

    def importances(self, fit: int = 0) -> np.ndarray:
        """Mean decrease of impurity of each feature, normalised in each tree and over all."""
        total = np.zeros(len(self.columns))
        n = self.counts.sum(axis=1)
        gini = n - (self.counts**2).sum(axis=1) / np.maximum(n, 1e-300)
        for r in self.root[fit * self.trees : (fit + 1) * self.trees]:
            one, todo = np.zeros(len(self.columns)), [int(r)]
            while todo:
                k = todo.pop()
                if self.feature[k] >= 0:
                    a, b = int(self.left[k]), int(self.right[k])
                    one[self.feature[k]] += gini[k] - gini[a] - gini[b]
                    todo += [a, b]
            total += one / (one.sum() or 1.0)
        return total / (total.sum() or 1.0)

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables below ``path``: the nodes, and labels, columns and edges."""
        arrays = [x.tolist() for x in (self.feature, self.cut, self.left, self.right, self.rows, self.counts)]
        nodes = [(i, *x) for i, x in enumerate(zip(*arrays))]
        spark.createDataFrame(nodes, "node long, feature int, cut int, left long, right long, rows long, counts array<double>").write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(self.labels, self.columns, [e.tolist() for e in self.edges], self.trees, self.root.tolist())]
        spark.createDataFrame(meta, "labels array<string>, columns array<string>, edges array<array<double>>, trees int, root array<long>").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        n = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")
        m = spark.read.parquet(f"{path}/meta").first()
        arrays = [n[c].to_numpy(kind) for c, kind in (("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("right", np.int32))]
        return cls(list(m["labels"]), list(m["columns"]), [np.array(e) for e in m["edges"]], m["trees"], np.array(m["root"]), *arrays, np.array(n["counts"].tolist()).reshape(len(n), -1), n["rows"].to_numpy(np.int32))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: the number of edges below it; NaN is above all."""
    return np.column_stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def bin_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Borders between the bins of each column: halfway between distinct percentiles, which tasks sum up in bounded sketches."""
    grid = F.array(*[F.lit(i / (bins - 1)) for i in range(bins)])
    one = rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c).cast("double")), grid, F.lit(10000)).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    out = []
    for i in range(len(columns)):
        points = np.unique(np.array(one[f"e{i}"] or [], float))
        out.append((points[:-1] + points[1:]) / 2)
    return out


def store_bins(rows: DataFrame, columns: list[str], edges: list[np.ndarray], labels: list[str], label: str, fits: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(h, code, bins, fits, and the columns ``keep``) stored: a hash, the label's place (-1 if unknown), a byte a column, the fits whose training rows hold the row."""
    keep = keep or []
    names = F.array(*[F.lit(x) for x in labels])
    code = F.coalesce(F.array_position(names, F.col(label).cast("string")) - 1, F.lit(-1)).cast("int")
    flat = rows.select(F.xxhash64(*columns).alias("h"), code.alias("code"), (F.array(F.lit(0)) if fits is None else fits).alias("fits"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"), *keep)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = binned(np.array(pdf["_x"].tolist(), float).reshape(len(pdf), -1), edges)
                yield pdf.drop(columns="_x").assign(bins=[r.tobytes() for r in x])

    kinds = dict(rows.dtypes)
    schema = ", ".join(["h long, code int, fits array<int>", *[f"`{c}` {kinds[c]}" for c in keep], "bins binary"])
    stored = materialize(flat.mapInPandas(cut, schema), "bins")
    # A small table lies in few files; trees, not rows, are then the work to share out.
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return stored if stored.rdd.getNumPartitions() >= wanted else materialize(stored.repartition(wanted), "bins")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), -1)


def _added(keys: list[np.ndarray], weights: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weights and rows of equal keys."""
    flat = np.concatenate([np.zeros(0, np.int64), *keys])
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    add = lambda parts: np.add.reduceat(np.concatenate([np.zeros(0, np.int64), *parts])[order], first) if len(first) else np.zeros(0, np.int64)
    return flat[first], add(weights), add(rows)


def below(ids: np.ndarray, side: int) -> np.ndarray:
    """Names of the left (0) or right (1) children of nodes: the tree in the lowest 20 bits, then the place in it, a root's being 0."""
    low = np.uint64((1 << 20) - 1)
    return ((ids >> np.uint64(20)) * np.uint64(2) + np.uint64(1 + side)) << np.uint64(20) | (ids & low)


def _drawn(batches: Iterator[pd.DataFrame], fits: int, trees: int, seed: int) -> Iterator[tuple]:
    """(bins, labels' places, trees, weights of (row, tree)) of runs of rows and trees."""
    total = fits * trees
    for pdf in batches:
        for lo in range(0, len(pdf), 4096):
            part = pdf.iloc[lo : lo + 4096]
            x, code, h = _matrix(part), part["code"].to_numpy(np.int64), part["h"].to_numpy(np.int64)
            within = np.zeros((len(part), fits), bool)
            for k, f in enumerate(part["fits"]):
                within[k, np.asarray(f, np.int64)] = True
            step = max(1, CELLS // len(part))
            for t in range(0, total, step):
                some = np.arange(t, min(t + step, total))
                yield x, code, some, draws(h, some, seed) * within[:, some // trees]


@dataclass
class Grown:
    """Forests of several fits: the nodes above ``LOCAL`` rows, and the subtrees below them as rows of Spark.

    ``subtrees`` has (grp, fit, sizes, feature, cut, left, counts, rows, tree, gain): packed arrays of the nodes of a
    group, its roots, ``members``, first, and for each of its trees what its splits gain by feature.
    """

    top: Forest
    gains: np.ndarray  # (tree, feature) of the splits in ``top``
    members: list[np.ndarray]
    subtrees: DataFrame

    def stored(self) -> Grown:
        return Grown(self.top, self.gains, self.members, materialize(self.subtrees, "subtrees"))

    def forest(self, first: int = 0, last: int | None = None) -> Forest:
        """The fits ``first`` to ``last`` as arrays, whose size the forest's parameters bound."""
        top = self.top
        last = top.fits if last is None else last
        found = self.subtrees.filter(F.col("fit").between(first, last - 1)).select("grp", "feature", "cut", "left", "counts", "rows").toArrow().to_pandas().sort_values("grp")
        arrays = {c: [getattr(top, c).copy()] for c in ("feature", "cut", "left", "counts", "rows")}
        kinds = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "counts": np.int32, "rows": np.int32}
        size = len(top.feature)
        for r in found.itertuples():
            roots = self.members[r.grp]
            for c, kind in kinds.items():
                part = np.frombuffer(getattr(r, c), kind)
                if c == "counts":
                    part = part.reshape(-1, len(top.labels))
                elif c == "left":  # children are no roots, so they all move alike
                    part = np.where(part >= 0, part + (size - len(roots)), -1)
                arrays[c][0][roots] = part[: len(roots)]
                arrays[c].append(part[len(roots) :].astype(arrays[c][0].dtype))
            size += len(part) - len(roots)
        whole = {c: np.concatenate(parts) for c, parts in arrays.items()}
        left = whole["left"]
        return Forest(top.labels, top.columns, top.edges, top.trees, top.root[first * top.trees : last * top.trees].copy(), whole["feature"], whole["cut"], left, np.where(left >= 0, left + 1, -1), whole["counts"], whole["rows"])

    def importances(self) -> np.ndarray:
        """(fit, feature): see Forest.importances; the subtrees' nodes stay with the tasks that grew them."""
        trees, total = self.top.trees, self.gains.copy()
        parts = self.subtrees.select(F.explode(F.arrays_zip("tree", "gain")).alias("x")).select("x.tree", F.posexplode("x.gain").alias("at", "gain"))
        for tree, at, gain in parts.groupBy("tree", "at").agg(F.sum("gain")).toArrow().to_pandas().itertuples(index=False):
            total[tree, at] += gain
        over = total.sum(axis=1, keepdims=True)
        each = (total / np.where(over > 0, over, 1.0)).reshape(-1, trees, total.shape[1]).sum(axis=1)
        over = each.sum(axis=1, keepdims=True)
        return each / np.where(over > 0, over, 1.0)


def grow(stored: DataFrame, labels: list[str], columns: list[str], edges: list[np.ndarray], fits: int = 1, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, split: int = SPLIT, seed: int = SEED) -> Grown:
    """Forests of ``fits`` parts of the rows of store_bins."""
    classes, m, bins = len(labels), max(1, int(np.sqrt(len(columns)))), max(len(e) for e in edges) + 1
    total = fits * trees
    none = np.zeros(0, np.int32)
    one = Forest(labels, columns, edges, trees, np.arange(total, dtype=np.int32), np.full(total, -1, np.int16), np.zeros(total, np.uint8), np.full(total, -1, np.int32), np.full(total, -1, np.int32), np.zeros((total, classes)), np.zeros(total, np.int32))
    train = stored.filter((F.col("code") >= 0) & (F.size("fits") > 0))
    sent = hold(train, len(columns), fits)
    if sent is not None:
        return _whole(train, one, sent, (classes, m, bins), depth, leaf, split, seed)

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(total, np.int64)
        for _, _, some, weight in _drawn(batches, fits, trees, seed):
            n[some] += (weight > 0).sum(axis=0)
        yield pd.DataFrame({"tree": np.flatnonzero(n), "n": n[n > 0]})

    rows = train.mapInPandas(sized, "tree int, n long").groupBy("tree").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    one.rows[rows["tree"]] = rows["n"]
    ids, tree, level = np.arange(total, dtype=np.uint64), np.arange(total, dtype=np.int32), np.zeros(total, np.int32)
    gains = np.zeros((total, len(columns)))
    new = np.flatnonzero(one.rows > LOCAL)
    for k in range(depth):
        if not len(new):
            break
        found = _level(train, one, ids, new, k, (classes, m, bins), leaf, seed).sort_values("node")
        at = new[found["node"].to_numpy(np.int64)]
        sums = lambda c: np.frombuffer(b"".join(found[c]), np.float64).reshape(len(found), classes)
        if k == 0:
            one.counts[at] = sums("lefts") + sums("rights")
        good = ((found["gain"] > 1e-9) & (one.rows[at] >= split)).to_numpy()
        at, found = at[good], found[good]
        n, grown = len(one.feature), 2 * len(at)
        one.feature[at], one.cut[at], one.left[at], one.right[at] = found["feature"].to_numpy(), found["cut"].to_numpy(), n + 2 * np.arange(len(at)), n + 2 * np.arange(len(at)) + 1
        np.add.at(gains, (tree[at], found["feature"].to_numpy(np.int64)), found["gain"].to_numpy())
        pair = lambda a, b: np.stack((a, b), axis=1).reshape(2 * len(at), *a.shape[1:])
        more = {"feature": np.full(grown, -1), "cut": np.zeros(grown), "left": np.full(grown, -1), "right": np.full(grown, -1), "counts": pair(sums("lefts"), sums("rights")), "rows": pair(found["n_left"].to_numpy(np.int64), found["n_right"].to_numpy(np.int64))}
        for c, v in more.items():
            setattr(one, c, np.concatenate((getattr(one, c), v.astype(getattr(one, c).dtype))))
        ids = np.concatenate((ids, pair(below(ids[at], 0), below(ids[at], 1))))
        tree, level = np.concatenate((tree, np.repeat(tree[at], 2))), np.concatenate((level, np.full(grown, k + 1, np.int32)))
        new = np.arange(n, n + grown)
        new = new[((one.counts[new] > 0).sum(axis=1) > 1) & (one.rows[new] > LOCAL)]

    # Roots of small nodes are searched in any case, as their counts are told there.
    small = np.flatnonzero((one.feature < 0) & (one.rows <= LOCAL) & (one.rows > 0) & ((level == 0) | ((level < depth) & (one.rows >= max(split, 2 * leaf)) & ((one.counts > 0).sum(axis=1) > 1))))
    small = small[np.argsort(tree[small], kind="stable")]
    sizes, fit = one.rows[small].astype(np.int64), tree[small] // trees
    before = np.cumsum(sizes) - sizes
    heads = np.searchsorted(fit, np.arange(fits))  # groups hold one fit
    run = (before - before[np.minimum(heads[fit], max(0, len(small) - 1))]) // LOCAL if len(small) else none
    cuts = np.flatnonzero((np.diff(fit, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0)) if len(small) else none
    members = np.split(small, cuts[1:]) if len(small) else []
    group, slot = np.full(len(one.feature), -1, np.int32), np.zeros(len(one.feature), np.int32)
    for g, some in enumerate(members):
        group[some], slot[some] = g, np.arange(len(some))
    facts = [(int(tree[some[0]]) // trees, ids[some], tree[some], depth - level[some]) for some in members]
    return Grown(one, gains, members, _small(train, one, group, slot, facts, (classes, m, bins), leaf, split, seed))


def hold(stored: DataFrame, columns: int, fits: int, keep: str | None = None):
    """The rows of store_bins as a broadcast (see Held) if they take at most HELD bytes, else None; ``keep`` names an int column to hold too."""
    width = columns + 16 + -(-fits // 8)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                within = np.zeros((len(pdf), fits), bool)
                for k, f in enumerate(pdf["fits"]):
                    within[k, np.asarray(f, np.int64)] = True
                parts = (pdf["h"].to_numpy(np.int64), pdf["code"].to_numpy(np.int32), pdf[keep].to_numpy(np.int32) if keep else np.zeros(0), np.packbits(within, axis=1))
                yield pd.DataFrame([[*(x.tobytes() for x in parts), b"".join(pdf["bins"])]], columns=["h", "code", "kept", "fits", "bins"])

    if stored.count() * width > HELD:
        return None
    found = stored.mapInPandas(packed, "h binary, code binary, kept binary, fits binary, bins binary").toArrow()
    return stored.sparkSession.sparkContext.broadcast([b"".join(v.as_buffer() for part in found[c].chunks for v in part) for c in ("h", "code", "kept", "fits", "bins")])


class Held:
    """Views of what ``hold`` sent: hashes, labels' places, the kept column, bins, and the rows of a fit."""

    def __init__(self, parts: list[bytes], columns: int, fits: int):
        self.h, self.code, self.kept = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.int32), np.frombuffer(parts[2], np.int32)
        self.within, self.x = np.frombuffer(parts[3], np.uint8).reshape(len(self.h), -(-fits // 8)), np.frombuffer(parts[4], np.uint8).reshape(len(self.h), columns)

    def learned(self, fit: int) -> np.ndarray:
        return np.flatnonzero(self.within[:, fit // 8] >> np.uint8(7 - fit % 8) & np.uint8(1))

    def grow(self, learned: np.ndarray, some: np.ndarray, depth: int, sizes: tuple, leaf: int, split: int, seed: int) -> tuple:
        """See subtrees; of the trees ``some`` on the rows ``learned``."""
        weight = draws(self.h[learned], some, seed).T
        at, r = np.nonzero(weight)
        row = learned[r]
        return subtrees(self.x, self.code[row], weight[at, r], at.astype(np.int32), some.astype(np.uint64), np.full(len(some), depth), sizes, leaf, split, seed, row)


def _whole(train: DataFrame, one: Forest, sent, sizes: tuple, depth: int, leaf: int, split: int, seed: int) -> Grown:
    """Grown of whole trees, some of a fit in a task; ``sent`` is of ``hold``."""
    columns, trees, fits, spark = len(one.columns), one.trees, one.fits, train.sparkSession
    rows = Held(sent.value, columns, fits)
    members = []
    for fit in range(fits):
        step = max(1, LOCAL // max(1, len(rows.learned(fit))))
        members += [np.arange(t, min(t + step, (fit + 1) * trees)) for t in range(fit * trees, (fit + 1) * trees, step)]

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, fit, learned = Held(sent.value, columns, fits), -1, None
        for pdf in batches:
            for g in pdf["grp"].tolist():
                some = members[g]
                if some[0] // trees != fit:
                    fit = int(some[0]) // trees
                    learned = rows.learned(fit)
                *nodes, gain = rows.grow(learned, some, depth, sizes, leaf, split, seed)
                yield pd.DataFrame([_packed(g, fit, nodes, some, gain)], columns=PACKED)

    tasks = min(len(members), 8 * spark.sparkContext.defaultParallelism)
    groups = spark.range(0, len(members), 1, tasks).select(F.col("id").cast("int").alias("grp"))
    return Grown(one, np.zeros((fits * trees, columns)), members, groups.mapInPandas(grown, SUBTREES))


PACKED = ["grp", "fit", "sizes", "feature", "cut", "left", "counts", "rows", "tree", "gain"]
SUBTREES = "grp int, fit int, sizes int, feature binary, cut binary, left binary, counts binary, rows binary, tree array<int>, gain array<array<double>>"


def _packed(grp: int, fit: int, nodes: list[np.ndarray], trees: np.ndarray, gain: np.ndarray) -> tuple:
    """A row of Grown's subtrees."""
    kinds = (np.int16, np.uint8, np.int32, np.int32, np.int32)
    return (grp, fit, len(nodes[0]), *[x.astype(k).tobytes() for x, k in zip(nodes, kinds)], trees.tolist(), gain.tolist())


def _level(train: DataFrame, one: Forest, ids: np.ndarray, new: np.ndarray, level: int, sizes: tuple, leaf: int, seed: int) -> pd.DataFrame:
    """The best split of each of the nodes ``new`` at the border: node (its place in ``new``), feature, cut, gain and both sides' counts."""
    classes, m, bins = sizes
    columns, trees, fits = len(one.columns), one.trees, one.fits
    cells = m * bins * classes
    context = train.sparkSession.sparkContext
    sent = context.broadcast((vars(one), ids, new))  # plain values, as workers may not have this module on their path

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told, ids, border = sent.value
        forest = Forest(**told)
        place = np.full(len(forest.feature), -1, np.int64)
        place[border] = np.arange(len(border))
        features = chosen_features(ids[border], columns, seed)

        def packed(keys, weights, rows):
            cuts = np.searchsorted(keys, np.arange(0, len(border) + CHUNK, CHUNK) * cells)
            out = [(c, (keys[i:j] - c * CHUNK * cells).astype(np.int32).tobytes(), weights[i:j].astype(np.int32).tobytes(), rows[i:j].astype(np.int32).tobytes()) for c, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            return pd.DataFrame(out, columns=["chunk", "keys", "weights", "rows"])

        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for x, code, some, weight in _drawn(batches, fits, trees, seed):
            node = place[forest.descend(x, slice(some[0], some[-1] + 1), level)]
            r, c = np.nonzero((weight > 0) & (node >= 0))
            for lo in range(0, len(r), 1 << 16):
                ri, ci = r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
                a = node[ri, ci]
                key = ((a[:, None] * m + np.arange(m)) * bins + x[ri[:, None], features[a]]) * classes + code[ri][:, None]
                often = np.broadcast_to(weight[ri, ci].astype(np.int64)[:, None], key.shape)
                for parts, x_ in zip(held, sums := _added([key.ravel()], [often.ravel()], [np.ones(key.size, np.int64)])):
                    parts.append(x_)
                size += len(sums[0])
                if size > COUNTS:
                    held = tuple([x_] for x_ in _added(*held))
                    size = len(held[0][0])
                    if size > COUNTS // 2:  # more may be counted than a task should hold
                        yield packed(*[x_[0] for x_ in held])
                        held, size = ([], [], []), 0
        yield packed(*_added(*held))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, ids, border = sent.value
        now, w, n = None, None, None

        def best():
            some = border[now * CHUNK : (now + 1) * CHUNK]
            shape = (-1, m, bins, classes)
            return best_splits(w.reshape(shape)[: len(some)], n.reshape(shape)[: len(some)].sum(axis=-1), chosen_features(ids[some], columns, seed), now * CHUNK, leaf)

        for pdf in batches:
            for chunk, *parts in zip(pdf["chunk"], pdf["keys"], pdf["weights"], pdf["rows"]):
                if chunk != now:
                    if now is not None:
                        yield best()
                    now, w, n = chunk, np.zeros(CHUNK * cells), np.zeros(CHUNK * cells)
                keys, weights, rows = (np.frombuffer(b, np.int32) for b in parts)
                w[keys] += weights
                n[keys] += rows
        if now is not None:
            yield best()

    parts = train.mapInPandas(counted, "chunk int, keys binary, weights binary, rows binary")
    found = parts.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(searched, "node long, feature int, cut int, gain double, lefts binary, rights binary, n_left long, n_right long").toArrow().to_pandas()
    sent.destroy()
    return found


def _small(train: DataFrame, one: Forest, group: np.ndarray, slot: np.ndarray, facts: list, sizes: tuple, leaf: int, split: int, seed: int) -> DataFrame:
    """The subtrees of the nodes that have a ``group``; see Grown. ``facts`` has each group's fit and its nodes' names, trees and levels left."""
    columns, trees, fits = len(one.columns), one.trees, one.fits
    sent = train.sparkSession.sparkContext.broadcast((vars(one), group, slot, facts))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told, group, slot, _ = sent.value
        forest = Forest(**told)
        for x, code, some, weight in _drawn(batches, fits, trees, seed):
            node = forest.descend(x, slice(some[0], some[-1] + 1))
            r, c = np.nonzero((weight > 0) & (group[node] >= 0))
            at = node[r, c]
            order = np.argsort(group[at], kind="stable")
            r, c, at = r[order], c[order], at[order]
            cuts = np.flatnonzero(np.diff(group[at], prepend=-1))
            out = []
            for i, j in zip(cuts, np.append(cuts[1:], len(at))):
                out.append((int(group[at[i]]), slot[at[i:j]].tobytes(), code[r[i:j]].astype(np.int32).tobytes(), weight[r[i:j], c[i:j]].astype(np.uint8).tobytes(), x[r[i:j]].tobytes()))
            yield pd.DataFrame(out, columns=["grp", "slot", "code", "weight", "bins"])

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, ids, tree, levels = sent.value[3][int(pdf["grp"].iloc[0])]
        at, code = (np.frombuffer(b"".join(pdf[c]), np.int32) for c in ("slot", "code"))
        weight, x = np.frombuffer(b"".join(pdf["weight"]), np.uint8), np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(at), columns)
        *nodes, gain = subtrees(x, code, weight, at, ids, levels, sizes, leaf, split, seed)
        which, place = np.unique(tree, return_inverse=True)
        added = np.zeros((len(which), columns))
        np.add.at(added, place, gain)
        return pd.DataFrame([_packed(int(pdf["grp"].iloc[0]), fit, nodes, which, added)], columns=PACKED)

    moved = train.mapInPandas(dealt, "grp int, slot binary, code binary, weight binary, bins binary")
    return moved.groupBy("grp").applyInPandas(grown, SUBTREES)


def subtrees(x: np.ndarray, code: np.ndarray, weight: np.ndarray, at: np.ndarray, ids: np.ndarray, levels: np.ndarray, sizes: tuple, leaf: int, split: int, seed: int, row: np.ndarray | None = None) -> tuple:
    """(feature, cut, left, counts, rows) of all nodes below the roots ``ids``, roots first, right children beside left ones, and (root, feature) gains; row k lies in root ``at[k]`` and is row ``row[k]`` of ``x``, or k."""
    classes, m, bins = sizes
    row, flat, weight = np.arange(len(code)) if row is None else row, x.reshape(-1), weight.astype(float)
    slots = np.arange(CHUNK * m).reshape(CHUNK, m) * bins  # of (node, feature, bin), and what they lack to be of (node, feature, class, bin)
    turned = slots * (classes - 1)
    roots, columns = len(ids), x.shape[1]
    counts = np.bincount(at.astype(np.int64) * classes + code, weights=weight, minlength=roots * classes).reshape(roots, classes)
    rows, gain = np.bincount(at, minlength=roots), np.zeros((roots, columns))
    told = {"feature": [np.full(roots, -1)], "cut": [np.zeros(roots, np.int64)], "left": [np.full(roots, -1)], "counts": [counts], "rows": [rows]}
    # The last level's nodes: their first number, names, root and the rows that lie in them, in order of node.
    first, root, left_over = 0, np.arange(roots), levels.astype(np.int64)
    order = np.argsort(at, kind="stable")
    node = at[order].astype(np.int64)
    while True:
        last = {c: told[c][-1] for c in told}
        open_ = (last["rows"] >= max(split, 2 * leaf)) & ((last["counts"] > 0).sum(axis=1) > 1) & (left_over > 0)
        keep = open_[node]
        order, node = order[keep], node[keep]
        if not len(order):
            break
        border = np.flatnonzero(open_)
        starts = np.searchsorted(node, np.append(border, len(open_)))
        found, lo = [], 0
        while lo < len(border):
            hi = max(lo + 1, min(lo + CHUNK, int(np.searchsorted(starts, starts[lo] + STEP, "right")) - 1))
            some = border[lo:hi]
            features = chosen_features(ids[some], columns, seed)
            w = n = None
            for i in range(starts[lo], starts[hi], STEP):
                mine = slice(i, min(i + STEP, starts[hi]))
                pick, rel = order[mine], np.repeat(np.arange(hi - lo), np.diff(np.clip(starts[lo : hi + 1], i, i + STEP)))
                place = features.take(rel, axis=0)
                place += (row.take(pick) * columns)[:, None]
                key = slots.take(rel, axis=0)
                key += flat.take(place)
                n_ = np.bincount(key.ravel(), minlength=len(some) * m * bins)
                key += turned.take(rel, axis=0)
                key += (code.take(pick) * bins)[:, None]
                w_ = np.bincount(key.ravel(), weights=np.repeat(weight.take(pick), m), minlength=len(some) * m * classes * bins)
                w, n = (w_, n_) if w is None else (np.add(w, w_, out=w), np.add(n, n_, out=n))
            found.append(_best(w.reshape(len(some), m, classes, bins), n.reshape(len(some), m, bins), features, leaf))
            lo = hi
        f, cut, won, lefts, rights, n_left, n_right = (np.concatenate(v) for v in zip(*found))
        good = won > 1e-9
        at_, f, cut, won = border[good], f[good], cut[good], won[good]
        np.add.at(gain, (root[at_], f), won)
        base = first + len(open_)
        last["feature"][at_], last["cut"][at_], last["left"][at_] = f, cut, base + 2 * np.arange(len(at_))
        pair = lambda a, b: np.stack((a, b), axis=1).reshape(2 * len(at_), *a.shape[1:])
        grown = 2 * len(at_)
        for c, v in {"feature": np.full(grown, -1), "cut": np.zeros(grown, np.int64), "left": np.full(grown, -1), "counts": pair(lefts[good], rights[good]), "rows": pair(n_left[good], n_right[good])}.items():
            told[c].append(v)
        inner = last["feature"][node] >= 0
        order, node = order[inner], node[inner]
        node = last["left"].take(node) - base + (flat.take(row.take(order) * columns + last["feature"].take(node)) > last["cut"].take(node))
        again = np.argsort(node, kind="stable")
        order, node = order[again], node[again]
        ids, root, left_over, first = pair(below(ids[at_], 0), below(ids[at_], 1)), np.repeat(root[at_], 2), np.repeat(left_over[at_] - 1, 2), base
    return (*[np.concatenate(v) for v in told.values()], gain)


def add_shares(out: np.ndarray, x: np.ndarray, rows: np.ndarray, nodes: tuple, trees: int, depth: int) -> None:
    """Add to ``out`` the class shares of the leaves that ``rows`` of ``x`` reach in each of the trees of ``subtrees``, in order of tree."""
    feature, cut, left, counts = nodes[:4]
    inner = feature >= 0
    # A node as one number: its left child (itself at a leaf, where no bin is beyond the cut), its feature and its cut.
    told = np.where(inner, left, np.arange(len(left))) << 24 | np.maximum(feature, 0) << 8 | np.where(inner, cut, 255)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
    for lo in range(0, len(rows), 1 << 13):
        some = x[rows[lo : lo + (1 << 13)]]
        flat, base = some.reshape(-1), np.arange(len(some)) * x.shape[1]
        for tree in range(trees):
            at = np.full(len(some), tree)
            for _ in range(depth):
                one = told[at]
                at = (one >> 24) + (flat[base + (one >> 8 & 0xFFFF)] > (one & 0xFF))
            out[lo : lo + (1 << 13)] += shares[at]


def _best(w: np.ndarray, n: np.ndarray, features: np.ndarray, leaf: int) -> tuple:
    """Of weights (node, feature, class, bin) and rows (node, feature, bin), each node's best split: feature, cut, gain, both sides' counts and rows."""
    left, n_left = np.cumsum(w, axis=3), np.cumsum(n, axis=2)
    # Squares of the right sides' counts follow from products of whole numbers, which are exact.
    all_, n_right, sums = left[..., -1], n_left[..., -1:] - n_left, np.cumsum(w.sum(axis=2), axis=2)
    squares, whole = np.einsum("abcd,abcd->abd", left, left), np.einsum("abc,abc->ab", all_, all_)[..., None]
    others = whole - 2 * np.einsum("abc,abcd->abd", all_, left) + squares
    over = lambda x, y: x / np.maximum(y, 1e-300)
    gain = np.where((n_left >= leaf) & (n_right >= leaf), over(squares, sums) + over(others, sums[..., -1:] - sums) - over(whole, sums[..., -1:]), 0.0)
    flat = gain.reshape(len(w), -1)
    best, at = flat.argmax(axis=1), np.arange(len(w))
    slot, cut = best // w.shape[3], best % w.shape[3]
    lefts = left[at, slot, :, cut]
    return features[at, slot], cut, flat[at, best], lefts, all_[at, slot] - lefts, n_left[at, slot, cut], n_right[at, slot, cut]


def best_splits(w: np.ndarray, n: np.ndarray, features: np.ndarray, first: int, leaf: int) -> pd.DataFrame:
    """Of weights (node, feature, bin, class) and rows (node, feature, bin), each node's split of most Gini gain; gain 0 if none leaves ``leaf`` rows on both sides."""
    feature, cut, gain, lefts, rights, n_left, n_right = _best(w.transpose(0, 1, 3, 2), n, features, leaf)
    sides = {k: [x.tobytes() for x in v] for k, v in {"lefts": lefts, "rights": rights}.items()}
    return pd.DataFrame({"node": first + np.arange(len(w)), "feature": feature, "cut": cut, "gain": gain, **sides, "n_left": n_left.astype(np.int64), "n_right": n_right.astype(np.int64)})


@dataclass
class Paths:
    """The leaves of a fit as tables: a row per leaf and feature on its path, in order of leaf; leaves of fewer features come first."""

    feature: np.ndarray
    low: np.ndarray  # bins in (low, high] stay on the path
    high: np.ndarray
    zero: np.ndarray  # share of rows that stay on it if the feature is hidden
    start: np.ndarray  # the first row of each leaf
    value: np.ndarray  # (leaf, class) share of the forest's probability
    alone: np.ndarray  # class shares of leaves that are roots


def path_tables(forest: Forest, fit: int = 0) -> Paths:
    """All paths of a fit, followed level by level."""
    shares, weight = forest.shares(), forest.counts.sum(axis=1)
    node = np.asarray(forest.root[fit * forest.trees : (fit + 1) * forest.trees], np.int64)
    alone = shares[node[forest.feature[node] < 0]].sum(axis=0) / forest.trees
    node = node[forest.feature[node] >= 0]
    # A path's distinct features in order of their first place, -1 beyond the last one.
    width = min(len(forest.columns), 1)
    path = {"feature": np.full((len(node), width), -1, np.int16), "low": np.full((len(node), width), -1, np.int16), "high": np.full((len(node), width), 255, np.int16), "zero": np.ones((len(node), width))}
    leaves: list[tuple] = []
    while len(node):
        f, cut, at = forest.feature[node], forest.cut[node], np.arange(len(node))
        same = path["feature"] == f[:, None]
        size = (path["feature"] >= 0).sum(axis=1)
        place = np.where(same.any(axis=1), same.argmax(axis=1), size)
        if place.max() >= width:
            width += 1
            path = {c: np.concatenate((v, np.full((len(v), 1), {"feature": -1, "low": -1, "high": 255, "zero": 1}[c], v.dtype)), axis=1) for c, v in path.items()}
        path["feature"][at, place] = f
        both = []
        for side, child in enumerate((forest.left[node], forest.right[node])):
            one = {c: v.copy() for c, v in path.items()}
            if side:
                one["low"][at, place] = np.maximum(one["low"][at, place], cut)
            else:
                one["high"][at, place] = np.minimum(one["high"][at, place], cut)
            one["zero"][at, place] *= weight[child] / weight[node]
            both.append(one)
        node = np.concatenate((forest.left[node], forest.right[node])).astype(np.int64)
        path = {c: np.concatenate([one[c] for one in both]) for c in path}
        ends = forest.feature[node] < 0
        size = (path["feature"][ends] >= 0).sum(axis=1)
        for d in np.unique(size):
            some = np.flatnonzero(ends)[size == d]
            leaves.append((d, {c: v[some, :d] for c, v in path.items()}, shares[node[some]] / forest.trees))
        node, path = node[~ends], {c: v[~ends] for c, v in path.items()}
    leaves.sort(key=lambda x: x[0])
    flat = {c: np.concatenate([np.zeros(0, v), *[one[c].ravel() for _, one, _ in leaves]]) for c, v in (("feature", np.int16), ("low", np.int16), ("high", np.int16), ("zero", float))}
    many = np.repeat([d for d, _, _ in leaves], [len(v) for _, _, v in leaves]).astype(np.int64)
    return Paths(*flat.values(), np.cumsum(many) - many, np.concatenate([np.zeros((0, len(forest.labels))), *[v for _, _, v in leaves]]), alone)


def _products(one: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """(leaf, row, point): products over a leaf's entries of ``yes`` where ``one`` (leaf, entry, row) holds, of ``no`` elsewhere; both (leaf, entry, point).

    The products of up to 6 entries are looked up by the bits of these.
    """
    leaves, many, rows = one.shape
    out = None
    for lo in range(0, many, 6):
        table = np.ones((leaves, 1, yes.shape[2]))
        bits = np.zeros((leaves, rows), np.uint8)
        for k, j in enumerate(range(lo, min(lo + 6, many))):
            table = np.concatenate((table * no[:, j, None], table * yes[:, j, None]), axis=1)
            bits |= one[:, j].view(np.uint8) << np.uint8(k)
        found = table.reshape(-1, yes.shape[2])[bits + (np.arange(leaves) * table.shape[1])[:, None]]
        out = found if out is None else np.multiply(out, found, out=out)
    return out


def _points(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss's points and weights between 0 and 1."""
    t, w = np.polynomial.legendre.leggauss(n)
    return (t + 1) / 2, w / 2


def _terms(zero: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``zero`` (leaf, entry): ``yes`` and ``no`` of _products, and Gauss's weights over the divided-out term (leaf, entry, point), for each feature that is met, and once, as the last entry, for those that aren't."""
    t, w = points
    no = zero[:, :, None] * (1 - t)
    yes = no + t
    return yes, no, np.concatenate((w * (1 - zero[:, :, None]) / yes, np.broadcast_to(-w / (1 - t), (len(zero), 1, len(t)))), axis=1)


def _answers(zero: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(leaf, entry, bits): what each entry adds for each set of met features, the bits' places being the entries."""
    yes, no, parts = _terms(zero, points)
    product = np.ones((len(zero), 1, yes.shape[2]))
    for j in range(zero.shape[1]):
        product = np.concatenate((product * no[:, j, None], product * yes[:, j, None]), axis=1)
    told = np.matmul(parts, product.transpose(0, 2, 1))
    for j in range(zero.shape[1]):  # where it isn't met
        halves = (len(zero), -1, 2, 1 << j)
        told[:, j].reshape(halves)[:, :, 0] = told[:, -1].reshape(halves)[:, :, 0]
    return told[:, :-1]


def shap(paths: Paths, x: np.ndarray, columns: int, cells: int = 1 << 21) -> np.ndarray:
    """(row, feature, class) SHAP values of rows of bins, conditional on the trees' paths.

    With t the share of features known before, a leaf's weights of feature sets are an integral over
    t of the product of ``zero + (one - zero) * t`` over the path's other features, a polynomial
    that half as many of Gauss's points as there are features integrate exactly. The product over
    all features of a path is looked up once for each row and leaf; a matrix product over the
    points divides each feature out, and features that are not met share one result. Where there are
    at least as many rows as sets of features on a path, that is done once for each set, and rows look theirs up.
    """
    classes = paths.value.shape[1] if len(paths.value) else len(paths.alone)
    out = np.zeros((columns, classes, len(x)))
    turned = np.ascontiguousarray(x.T)
    many = np.diff(np.append(paths.start, len(paths.feature)))
    lo = 0
    while lo < len(many) and len(x):
        d = int(many[lo])
        points, sets = _points((d + 1) // 2), d <= 16 and 1 << d <= len(x)
        hi = min(int(np.searchsorted(many, d, side="right")), lo + max(1, (4 if sets else 1) * cells // (d * len(x))))
        rows = slice(paths.start[lo], paths.start[lo] + d * (hi - lo))
        f, zero = paths.feature[rows].astype(np.int64), paths.zero[rows].reshape(-1, d)
        low = (paths.low[rows] + 1).astype(np.uint8)[:, None]
        one = (turned[f] - low < np.maximum(paths.high[rows] - paths.low[rows], 0).astype(np.uint8)[:, None]).reshape(hi - lo, d, -1)
        order = np.argsort(f, kind="stable")
        if sets:
            told, place = np.empty((len(f), len(x))), np.argsort(order).reshape(-1, d)
            for i in range(0, hi - lo, 4):
                for k, answers in enumerate(_answers(zero[i : i + 4], points), i):
                    met = np.zeros(len(x), np.uint16)
                    for j in range(d):
                        met |= one[k, j].astype(np.uint16) << np.uint16(j)
                    met = met.astype(np.int64)
                    for j in range(d):
                        np.take(answers[j], met, out=told[place[k, j]], mode="clip")
        else:
            yes, no, parts = _terms(zero, points)
            told = np.matmul(parts, _products(one, yes, no).transpose(0, 2, 1))
            told = np.where(one, told[:, :d], told[:, d:]).reshape(-1, len(x))[order]
        value = np.repeat(paths.value[lo:hi], d, axis=0)[order]
        cuts = np.flatnonzero(np.diff(f[order], prepend=-1))
        for i, j in zip(cuts, np.append(cuts[1:], len(f))):
            out[f[order[i]]] += value[i:j].T @ told[i:j]
        lo = hi
    return out.transpose(2, 0, 1)


def expected(forest: Forest, paths: Paths) -> np.ndarray:
    """The class probabilities with all features hidden: what SHAP values add to."""
    ends = np.append(paths.start[1:], len(paths.feature))
    cover = np.array([paths.zero[a:b].prod() for a, b in zip(paths.start, ends)])
    return (cover[:, None] * paths.value).sum(axis=0) + paths.alone
