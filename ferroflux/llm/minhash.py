"""Near-duplicate documents: circulant MinHash, banding and exact Jaccard.

One permutation sigma deals the shingles to positions; a second one, pi, read at
the positions shifted by k, gives coordinate k of the signature:
``min over x of pi[(sigma(x) + k) mod D]``. Bands of coordinates are the buckets.
Links are confirmed on the full sets. Only links that can join two components
are looked at: each member of a bucket is first held against the bucket's
smallest document, components are formed, and only buckets that still hold
several components are searched further, at last in blocks of bitmaps: first by the nearest
pairs that would join them, then by all that are left between those still apart. So a
group of thousands of copies costs a link per member, and no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .base import cached, doc_words, materialize, mix64, ngram_hashes, runs, texts_of

SHINGLE = 5
ROWS, BANDS = 4, 32
UNIVERSE = 1 << 22
NUM, DEN = 75, 100
#: Members of a block in the pairwise search.
BLOCK = 64


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes; fewer words than a shingle count as one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(words, min(SHINGLE, len(words))))


def _circulant() -> np.ndarray:
    """pi, with its start repeated after its end, as overlapping rows of ROWS * BANDS."""

    def build():
        pi = np.random.default_rng(7).permutation(UNIVERSE).astype(np.uint32)
        return np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: ROWS * BANDS])), ROWS * BANDS)

    return cached("circulant", build)


def signature(shingles: np.ndarray) -> np.ndarray:
    rows = _circulant()
    at = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    out = np.full(ROWS * BANDS, UNIVERSE, dtype=np.uint32)
    for i in range(0, len(at), 1024):
        np.minimum(out, rows[at[i : i + 1024]].min(axis=0), out=out)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("mark", F.xxhash64("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, h1, h2, bands): mark names the text, h1 and h2 the set, bands its buckets.

    Null and wordless texts have n_shingles 0 and no bands.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches):
            rows, ids, marks = [], pdf["doc_id"].tolist(), pdf["mark"].tolist()
            for first, words, bounds in doc_words(texts_of(pdf["text"])):
                for k in range(len(bounds) - 1):
                    s = shingle_set(words[bounds[k] : bounds[k + 1]])
                    if len(s):
                        name = [int(mix64(s ^ np.uint64(x)).sum(dtype=np.uint64).astype(np.int64)) for x in (1, 2)]
                        sig = signature(s).reshape(BANDS, ROWS).astype(np.uint64)
                        band = mix64((sig[:, 0] << np.uint64(32) | sig[:, 1]) * np.uint64(0x9E3779B97F4A7C15) + (sig[:, 2] << np.uint64(32) | sig[:, 3]))
                        rows.append((ids[first + k], marks[first + k], len(s), *name, band.view(np.int64)))
                    else:
                        rows.append((ids[first + k], marks[first + k], 0, 0, 0, []))
            out = pd.DataFrame(rows, columns=["doc_id", "mark", "n_shingles", "h1", "h2", "bands"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return _texts(docs).mapInPandas(sign, "doc_id long, mark long, n_shingles long, h1 long, h2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets reach the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(left, "a").join(right, "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for pdf in runs(batches):
            new = {i: t for side in "ab" for i, t in zip(pdf[side].tolist(), pdf[f"{side}_text"]) if i not in kept}
            ids = list(new)
            for first, words, bounds in doc_words(texts_of(new.values())):
                for k in range(len(bounds) - 1):
                    kept[ids[first + k]] = shingle_set(words[bounds[k] : bounds[k + 1]])
            yes = [linked(kept[a], kept[b]) for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf.loc[yes, ["a", "b"]]
            hub = pdf["b"].iloc[-1] if len(pdf) else None
            kept = {hub: kept[hub]} if hub is not None else {}

    return both.select("a", "a_text", "b", "b_text").mapInPandas(check, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, of distinct sorted sets."""
    if DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)) or not len(x):
        return False
    common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
    return DEN * common >= NUM * (len(x) + len(y) - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the smallest node reachable.

    Alternating large-star and small-star steps until each node points at the end
    of its star alone; every step groups by node with partial aggregation, and its
    result is a table in the shared folder. Edges that are such stars take no step.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not _are_stars(pairs):
        ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored first, the least neighbours are a join's own input, whose hot keys Spark can split.
        low = materialize(ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "low")
        large = ways.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = materialize(small.filter("u <> v").distinct(), "edges")
    ends = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each u of distinct pairs (u, v), u > v, has one v, which is no u itself."""
    one, none = F.lit(1), F.lit(0)
    sides = pairs.select(F.col("u").alias("node"), one.alias("up"), none.alias("down")).unionByName(pairs.select(F.col("v").alias("node"), none.alias("up"), one.alias("down")))
    nodes = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (doc_id, component) after more links: these join components, of which there are ever fewer, so no link is looked at twice."""
    ends = links
    for side in "ab":
        ends = ends.join(labels.select(F.col("doc_id").alias(side), F.col("component").alias(f"{side}_component")), side)
    found = components(ends.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    return materialize(labels.join(found, labels["component"] == found["node"], "left").select("doc_id", F.coalesce(found["component"], labels["component"]).alias("component")), "labels")


def _opened(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with their component."""
    named = members.join(labels, "doc_id")
    several = named.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return materialize(named.join(several.select("band", "value"), ["band", "value"]), "open")


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits that flip with each shingle, a power of two of at least four times as many as there are: they differ in no more places than the sets, and hardly in fewer."""
    width = max(64, 1 << (max(0, len(shingles) - 1).bit_length() + 2))
    flips = np.bincount((mix64(shingles) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes: the parts of a wider one flip each other."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def _crossing(x: list, y: list, spanning: bool = False) -> list[tuple[int, int]]:
    """Pairs of members (doc_id, component, n, bits) of two blocks, across components, that sizes and bitmaps don't exclude.

    With ``spanning``, nearest pairs first, only those that join components which no earlier pair has joined.
    """
    size = min(len(m["bits"]) for m in (*x, *y))
    bits = np.array([_folded(m["bits"], size) for m in (*x, *y)]).view(np.uint64)
    n, comp = (np.array([m[c] for m in (*x, *y)], dtype=np.int64) for c in ("n", "component"))
    found, k = [], len(x)
    for i in range(k):
        both = n[k:] + n[i]
        apart = np.bitwise_count(bits[k:] ^ bits[i]).sum(axis=1, dtype=np.int64)
        hit = (comp[k:] != comp[i]) & (DEN * np.minimum(n[k:], n[i]) >= NUM * np.maximum(n[k:], n[i])) & ((DEN + NUM) * ((both - apart) // 2) >= NUM * both)
        found += [(apart[j] / both[j], i, j) for j in np.flatnonzero(hit)]
    if spanning:
        up = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while up[c] != c:
                c = up[c]
            return c

        every, found = sorted(found), []
        for apart, i, j in every:
            a, b = top(int(comp[i])), top(int(comp[k + j]))
            if a != b:
                up[a] = b
                found.append((apart, i, j))
    return [(x[i]["doc_id"], y[j]["doc_id"]) for _, i, j in found]


def _bitmaps(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, n, bits) of the members of open buckets."""

    def bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches):
            sets = []
            for _, words, bounds in doc_words(texts_of(pdf["text"])):
                sets += [shingle_set(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets]})

    wanted = texts.join(opened.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return materialize(wanted.mapInPandas(bitmaps, "doc_id long, n long, bits binary"), "bitmaps")


def _near(opened: DataFrame, sets: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b) across components within buckets, in blocks, that may be links; see ``_crossing``.

    A bucket's members are cut into blocks in order of component, and blocks
    that hold one and the same component don't meet. Blocks hold bitmaps, not sets.
    """
    placed = numbered(opened.select("band", "value", "doc_id", "component"), ["band", "value"], ["component", "doc_id"], "place")
    ranked = placed.withColumn("block", F.floor(F.col("place") / BLOCK)).join(sets, "doc_id")
    blocks = ranked.groupBy("band", "value", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.collect_list(F.struct("doc_id", "component", "n", "bits")).alias("m"))
    blocks = materialize(blocks, "blocks")
    x, y = (blocks.select("band", "value", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high", "m")]) for s in "xy")
    pairs = x.join(y, ["band", "value"]).filter("block_x <= block_y and (low_x <> high_y or high_x <> low_y)")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {(min(hit), max(hit)) for x, y in zip(pdf["m_x"], pdf["m_y"]) for hit in _crossing(x, y, spanning)}
            yield pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")

    return materialize(pairs.select("m_x", "m_y").mapInPandas(search, "a long, b long").distinct(), "near")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents without words, null texts among them, link with nothing. Rows with
    null doc_id have a null component and are kept. Of rows that repeat a doc_id with
    other words, each is in the class of its own set; for links the doc_id, where it is its
    class's smallest, stands for the one set whose hashed name is smallest. Ties go to the smaller doc_id. Other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    sets = materialize(signatures(docs), "signatures")
    named = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    heads = named.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    # A doc_id that several rows have stands for the set of the smallest name.
    heads = heads.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "mark", "bands")).alias("one")).select("doc_id", "one.mark", "one.bands")
    heads = materialize(heads, "heads")
    buckets = heads.select("doc_id", F.posexplode("bands").alias("band", "value"))
    shared = materialize(buckets.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = materialize(buckets.join(shared, ["band", "value"]), "members")
    # A document that shares its buckets with most others is the most central one.
    central = members.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    members = members.join(central, "doc_id").withColumn("rank", F.struct("weight", (-F.col("doc_id")).alias("neg")))
    hubs = materialize(members.groupBy("band", "value").agg(F.max("rank").alias("hub")), "hubs")
    members = materialize(members.join(hubs, ["band", "value"]).select("band", "value", "doc_id", (-F.col("hub.neg")).alias("hub"), F.col("hub")["weight"].alias("weight")), "members")
    wanted = heads.select("doc_id", "mark").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = materialize(_texts(docs).join(wanted, ["doc_id", "mark"], "left_semi").select("doc_id", "text"), "texts")

    others = members.filter("doc_id <> hub")
    first = others.groupBy(F.col("doc_id").alias("a")).agg(F.max(F.struct("weight", (-F.col("hub")).alias("neg"))).alias("best"))
    first = materialize(first.select("a", (-F.col("best.neg")).alias("b")), "pairs")
    each = members.select("doc_id").distinct().withColumn("component", F.col("doc_id"))
    labels = _joined(each, materialize(confirm(first, texts), "links"))
    opened = _opened(members, labels)
    if not opened.isEmpty():
        apart = opened.join(labels.select(F.col("doc_id").alias("hub"), F.col("component").alias("hub_component")), "hub").filter("component <> hub_component")
        again = apart.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
        labels = _joined(labels, materialize(confirm(again, texts), "links"))
        opened = _opened(members, labels)
        if not opened.isEmpty():
            # Pairs that may join what is apart come first, as few as would do; then what is left between those still apart.
            sets_of = _bitmaps(opened, texts)
            near = _near(opened, sets_of, spanning=True)
            labels = _joined(labels, materialize(confirm(near, texts), "links"))
            opened = _opened(members, labels)
            if not opened.isEmpty():
                rest = _near(opened, sets_of, spanning=False).join(near, ["a", "b"], "left_anti")
                labels = _joined(labels, materialize(confirm(rest, texts), "links"))
    found = labels.withColumnRenamed("doc_id", "node")
    classes = materialize(classes.join(found, classes["rep"] == found["node"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id")), "classes")
    # Rows without words have no class to meet; those of a large class are split by Spark, as both sides are stored.
    has = F.col("n_shingles") > 0
    rows = sets.select("doc_id", "n_shingles", F.when(has, F.col("h1")).alias("h1"), F.when(has, F.col("h2")).alias("h2")).join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
