"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Benchmark items and documents are sequences of words (lower-cased A-Z, split at
ASCII that is no letter or digit). Runs of ``least`` words are the seeds. One scan
of the documents keeps those that may hold a seed, by a filter of bounded size;
their seeds are joined to the items' seeds, whatever the benchmark's size, and each
text that shares one with an item is tiled: the longest common runs of unmarked
words are marked again and again, whatever their order, and the marked share of
the item is its coverage. Texts and items that repeat are tiled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import doc_words, fresh, materialize, mix64, ngram_hashes, powers, quoted, runs, separators, texts_of

LEAST = 5
THRESHOLD = 0.5
#: Bits of the filter of seeds that is sent to all tasks, at most, as a power of two.
FILTER_BITS = 27
#: Places of a seed's bits in the filter: shifts of its hash.
PROBES = (0, 18, 36)
#: Candidate items of a text that meet one copy of it.
SHARE = 256
#: Leaks that are sent to all tasks, at most; more are joined by a shuffle.
SENT = 50_000
#: Hits of two sequences that are looked at together.
HITS = 1 << 20
LEAKS = "array<struct<item_id:bigint,item_tokens:bigint,n_covered:bigint,n_tiles:bigint>>"


def _windows(words: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes and starts of all windows of s unmarked words."""
    n = len(words) - s + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(words))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    used = np.concatenate(([0], np.cumsum(marked)))
    starts = np.flatnonzero(used[s:] == used[:n])
    return (total[starts + s] - total[starts]) * down[starts], starts


def _matches(item: np.ndarray, doc: np.ndarray, mi: np.ndarray, md: np.ndarray, s: int) -> np.ndarray:
    """Rows (length, i, j) of maximal runs of at least s unmarked words in common."""
    hi, si = _windows(item, mi, s)
    hd, sd = _windows(doc, md, s)
    order = np.argsort(hi, kind="stable")
    hi, si = hi[order], si[order]
    lo = np.searchsorted(hi, hd)
    n = np.searchsorted(hi, hd, "right") - lo
    some = np.flatnonzero(n)
    ends = np.cumsum(n[some])
    out, total = [np.zeros((0, 3), np.int64)], int(n.sum())
    for a in range(0, total, HITS):  # a repetitive text has as many hits as places squared
        k = np.arange(a, min(a + HITS, total))
        of = np.searchsorted(ends, k, "right")
        x = some[of]
        j, i = sd[x], si[lo[x] + k - (ends - n[some])[of]]
        # Starts that a longer run holds go; equal hashes are verified word by word below.
        left = (i > 0) & (j > 0)
        left[left] = (item[i[left] - 1] == doc[j[left] - 1]) & ~mi[i[left] - 1] & ~md[j[left] - 1]
        i, j = i[~left], j[~left]
        length, going = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(going):
            p, q = i[going] + length[going], j[going] + length[going]
            ok = (p < len(item)) & (q < len(doc))
            ok[ok] = (item[p[ok]] == doc[q[ok]]) & ~mi[p[ok]] & ~md[q[ok]]
            going = going[ok]
            length[going] += 1
        keep = length >= s
        out.append(np.stack((length[keep], i[keep], j[keep]), axis=1))
    return np.concatenate(out)


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length), longest first, none overlapping."""
    mi, md, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    s = max(least, min(len(item), len(doc)))
    while True:
        found = _matches(item, doc, mi, md, s)
        if len(found) and found[:, 0].max() > 2 * s:
            s = int(found[:, 0].max())
            continue
        again = False
        for length, i, j in found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))].tolist():
            if mi[i : i + length].any() or md[j : j + length].any():
                again = True  # what is left of it may still be long enough
                continue
            mi[i : i + length] = md[j : j + length] = True
            out.append((i, j, length))
        if again:
            continue
        if s <= least:
            return out
        s = max(least, s // 2)


def covered(item: np.ndarray, doc: np.ndarray, threshold: float, least: int) -> tuple[int, int] | None:
    """(words of ``item`` that tiles of ``doc`` cover, number of tiles) if these reach ``threshold``."""
    n = min(least, len(item))
    seeds = np.flatnonzero(np.isin(ngram_hashes(item, n), ngram_hashes(doc, n)))
    reach = np.zeros(len(item), bool)
    for k in range(n):
        reach[seeds + k] = True
    if not len(seeds) or reach.sum() < threshold * len(item):
        return None
    found = tiles(item, doc, n)
    total = sum(t[2] for t in found)
    return (total, len(found)) if total and total >= threshold * len(item) else None


def _named(grams: np.ndarray, n: int) -> np.ndarray:
    """Seed hashes as Spark's longs; seeds of other lengths have other hashes."""
    return mix64(grams + np.uint64(n)).view(np.int64)


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, n, words): the items that have words; ``item`` names their sequence of words."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches):
            words = []
            for _, w, bounds in doc_words(texts_of(pdf["text"]), separators()):
                words += [w[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pd.DataFrame({"item_id": pdf["item_id"].astype("Int64"), "n": [len(w) for w in words], "words": [w.tobytes() for w in words]})

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInPandas(told, "item_id long, n long, words binary").filter("n > 0")
    return materialize(rows.select("item_id", F.sha2("words", 256).alias("item"), "n", "words"), "items")


def seed_table(items: DataFrame, least: int) -> DataFrame:
    """(seed, item, n, places): each distinct sequence's seeds and how often it has them."""

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, 64):
            for item, n, words in zip(pdf["item"], pdf["n"], pdf["words"]):
                k = min(least, int(n))
                seed, places = np.unique(_named(ngram_hashes(np.frombuffer(words, np.uint64), k), k), return_counts=True)
                yield pd.DataFrame({"seed": seed, "item": item, "n": int(n), "places": places})

    one = items.dropDuplicates(["item"]).select("item", "n", "words")
    return materialize(one.mapInPandas(seeds, "seed long, item string, n long, places long"), "seeds")


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the seeds, of at most 2**bits bits whatever their number: a fuller one lets more through to the join."""
    count = seeds.select("seed").distinct().count()
    size = min(bits, max(12, (64 * max(1, count) - 1).bit_length()))
    spots = F.array(*[F.shiftrightunsigned("seed", k).bitwiseAND(F.lit((1 << size) - 1)) for k in PROBES])
    cells = seeds.select(F.explode(spots).alias("at")).select(F.shiftright("at", 6).alias("cell"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << max(0, size - 6), np.uint64)
    out[got["cell"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def touched(docs: DataFrame, seeds: DataFrame, least: int) -> DataFrame:
    """(doc_id, key, text, hits): the documents that hold a seed, and these seeds; ``key`` names the text."""
    lengths = sorted({min(least, r["n"]) for r in seeds.select(F.least("n", F.lit(least)).alias("n")).distinct().collect()})
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        mask = np.uint64(len(cells) * 64 - 1)
        for pdf in runs(batches):
            hits: list[list] = [[] for _ in range(len(pdf))]
            for first, words, bounds in doc_words(texts_of(pdf["text"]), separators()):
                for n in lengths:
                    seed = _named(ngram_hashes(words, n), n).view(np.uint64)
                    held = np.ones(len(seed), bool)
                    for k in PROBES:
                        at = (seed >> np.uint64(k)) & mask
                        held &= ((cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
                    at = np.flatnonzero(held)
                    doc = np.searchsorted(bounds, at, "right") - 1
                    inside = at + n <= bounds[doc + 1]
                    at, doc = at[inside], doc[inside]
                    for d in np.unique(doc):
                        hits[first + d].append(np.unique(seed[at[doc == d]].view(np.int64)))
            some = [k for k, x in enumerate(hits) if x]
            if some:
                part = pdf.iloc[some]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "text": part["text"], "hits": [np.concatenate(hits[k]) for k in some]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInPandas(look, "doc_id long, text binary, hits array<long>").select("doc_id", F.sha2("text", 256).alias("key"), "text", "hits"), "touched")


def candidates(texts: DataFrame, seeds: DataFrame, threshold: float, least: int) -> DataFrame:
    """(key, item): texts and items that share a seed, but for the item's most frequent seeds.

    Tiles that reach the threshold hold at least ``need`` of an item's seeds, so a
    text that holds only the ``need - 1`` most frequent ones can't leak it.
    """
    flat = texts.select("key", F.explode("hits").alias("seed"))
    often = flat.groupBy("seed").agg(F.count("*").alias("often"))
    need = F.ceil(F.ceil(F.lit(threshold) * F.col("n")) / F.least("n", F.lit(least)))
    order = Window.partitionBy("item").orderBy(F.col("often").desc(), "seed").rowsBetween(Window.unboundedPreceding, 0)
    rare = seeds.join(often, "seed").withColumn("upto", F.sum("places").over(order)).filter(F.col("upto") >= F.greatest(need, F.lit(1)))
    rare = materialize(rare.select("seed", "item"), "rare")
    return flat.join(rare, "seed").select("key", "item").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(touched documents, (key, item_id, item_tokens, n_covered, n_tiles) of the texts that leak an item)."""
    items = item_table(benchmark)
    seeds = seed_table(items, least)
    found = touched(docs, seeds, least)
    texts = found.dropDuplicates(["key"]).select("key", "text", "hits")
    pairs = materialize(candidates(texts, seeds, threshold, least), "pairs")
    # A text goes out once for every SHARE of its candidates, which may be many.
    number = materialize(pairs.groupBy("key").agg(F.count("*").alias("number")), "numbers")
    number = number.withColumn("chunks", F.ceil(F.col("number") / SHARE).cast("int"))
    asked = pairs.join(number, "key").withColumn("chunk", F.pmod(F.xxhash64("item"), "chunks").cast("int"))
    asked = asked.join(items.dropDuplicates(["item"]), "item").select("key", "chunk", "item", "words")
    held = texts.join(number, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit("").alias("item"), F.col("text").alias("words"))
    both = held.unionByName(asked).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "item")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc = np.zeros(0, np.uint64)
        for pdf in runs(batches):
            out = []
            for key, item, words in zip(pdf["key"], pdf["item"], pdf["words"]):
                if not item:  # a text stands before its items
                    doc = np.concatenate([np.zeros(0, np.uint64), *(w for _, w, _ in doc_words([bytes(words)], separators()))])
                elif got := covered(np.frombuffer(words, np.uint64), doc, threshold, least):
                    out.append((key, item, *got))
            yield pd.DataFrame(out, columns=["key", "item", "n_covered", "n_tiles"])

    told = both.mapInPandas(tile, "key string, item string, n_covered long, n_tiles long")
    told = told.join(items.select("item", "item_id", F.col("n").alias("item_tokens")), "item")
    return found, materialize(told.select("key", "item_id", "item_tokens", "n_covered", "n_tiles"), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, into: str = "leaks") -> DataFrame:
    """Add ``into``, an array of (item_id, item_tokens, n_covered, n_tiles), to every row of ``docs``.

    Null and wordless texts and items match nothing; items of fewer than
    ``least`` words must occur whole as one seed. Rows that repeat an item_id or
    doc_id are items and documents of their own, and equal texts leak the same
    items. Leaks are in order of item_id. An own column of the name ``into`` is
    replaced, other columns stay, whatever their names; without documents there are
    no rows, without items no leaks.
    """
    columns = [c for c in docs.columns if c.lower() != into.lower()]
    key, name = fresh("key", columns), fresh("found", columns)
    _, told = leaks(docs, benchmark, threshold, least)
    each = told.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("item_id", "item_tokens", "n_covered", "n_tiles"))).alias(name))
    if told.count() <= SENT:
        each = F.broadcast(each)  # bounded by the count; more are joined by a shuffle
    rows = docs.withColumn(key, F.sha2(F.col("text").cast("binary"), 256)).join(each, key, "left")
    return rows.select(*map(quoted, columns), F.coalesce(F.col(name), F.expr(f"cast(array() as {LEAKS})")).alias(into))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, item_tokens, n_covered, n_tiles, coverage) of every document and item it leaks."""
    found, told = leaks(docs, benchmark, **options)
    rows = found.select("doc_id", "key").join(told, "key")
    return rows.select("doc_id", "item_id", "item_tokens", "n_covered", "n_tiles", (F.col("n_covered") / F.col("item_tokens")).alias("coverage"))
