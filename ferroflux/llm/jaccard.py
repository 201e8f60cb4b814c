"""Exact n-gram Jaccard join by an inverted index of prefixes, with set-relation skipping.

Sets of shingles are put in one global order, frequent shingles last, and only a
set's first ``n - ceil(0.9 n) + 1`` are indexed: sets that reach the threshold share
one of those. An index list is cut into blocks by size and by the position that its
shingle has in each set. At the first shingle that two sets share, no more than what
follows it in the shorter rest can be common, so whole blocks that lie too far behind are
skipped against each other.

Relations between sets spare the rest of the work:

* Sets with equal elements are one class.
* In a list each set is held against the list's leader. The symmetric difference is a metric, so a
  set's answer follows from its leader's where bounds decide.
* Bitmaps whose bits flip with each element bound the symmetric difference from below, so a
  pair is held element by element only if they can't exclude it.
* Within a component, answers of a set are derived from those of its most similar
  leader: with the differences D to the leader, sets y and z differ in
  ``|Dy| + |Dz| - 2 |Dy & Dz|`` elements, so only the differences meet, never whole sets.

All bounds are exact; every link between different sets is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .base import doc_words, materialize, mix64, ngram_hashes, runs, squeezed, texts_of, unsqueezed
from .minhash import components

SHINGLE = 3
NUM, DEN = 90, 100
#: Counters of the sketch of shingle frequencies, in slices that tasks add up.
COUNTERS, SLICES = 1 << 18, 16
#: Members of a block of an index list, of a component.
BLOCK, PART = 128, 256
#: Bytes of the bitmaps in blocks of lists.
NARROW = 64
#: Bits of the filter of doc_ids whose texts are read again, at most, as a power of two, and shifts of a hash that give their places.
FILTER_BITS, PROBES = 27, (0, 31)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, sorted; fewer words than a shingle count as one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(words, min(SHINGLE, len(words))))


def names_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(mix64(s ^ np.uint64(x)).sum(dtype=np.uint64).astype(np.int64)) for x in (1, 2))


def _sets(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of the texts of a batch."""
    for first, words, bounds in doc_words(texts_of(pdf["text"])):
        for k in range(len(bounds) - 1):
            yield first + k, shingle_set(words[bounds[k] : bounds[k + 1]])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def named_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, h1, h2) of every row, n 0 without words; and (slice, part, counters): each task's sketch of how often shingles occur."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sketch = np.zeros(COUNTERS, np.uint64)
        for pdf in runs(batches):
            rows, ids, seen = [], pdf["doc_id"].tolist(), []
            for k, s in _sets(pdf):
                rows.append((ids[k], len(s), *(names_of(s) if len(s) else (0, 0)), -1, 0, b""))
                seen.append(s)
            flat = np.concatenate([np.zeros(0, np.uint64), *seen])
            sketch += np.bincount((flat >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint64)
            yield _frame(rows)
        part = TaskContext.get().partitionId()
        yield _frame([(None, 0, 0, 0, i, part, squeezed(x)) for i, x in enumerate(np.split(sketch, SLICES))])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "n", "h1", "h2", "slice", "part", "counters"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    both = materialize(_texts(docs).mapInPandas(told, "doc_id long, n long, h1 long, h2 long, slice int, part long, counters binary"), "sets")
    return both.filter("slice < 0").select("doc_id", "n", "h1", "h2"), both.filter("slice >= 0").select("slice", "part", "counters")


def frequency_classes(sketches: DataFrame) -> np.ndarray:
    """A byte for each counter, rising with twice the logarithm of its sum over all tasks. Tasks' sketches are added up by 64."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(unsqueezed([x], np.uint64) for x in pdf["counters"])
        return pd.DataFrame([(pdf["slice"].iloc[0], pdf["part"].min() // 64, squeezed(total))], columns=["slice", "part", "counters"])

    tasks = (sketches.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        sketches = sketches.groupBy("slice", F.floor(F.col("part") / 64).alias("_to")).applyInPandas(added, "slice int, part long, counters binary")
        tasks = -(-tasks // 64)
        if tasks <= 1:
            break
    slices = {r["slice"]: r["counters"] for r in sketches.collect()}  # SLICES rows, 2 MB in all
    total = unsqueezed([slices[i] for i in sorted(slices)], np.uint64)
    return np.floor(2 * np.log2(total.astype(np.float64) + 1)).astype(np.uint8)


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def bitmap_width(n: int) -> int:
    """Bits of a set's bitmap, a power of two of at least half its elements: unlike sets of one size differ in a quarter of those, linking ones in a tenth at most."""
    return max(64, 1 << max(0, (n - 1).bit_length() - 1))


def index_rows(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(doc_id, h1, h2, n, bits, prefix) of texts with words: their bitmaps; the prefix the first shingles in order."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = np.uint64(64 - COUNTERS.bit_length() + 1)
        for pdf in runs(batches):
            rows, ids = [], pdf["doc_id"].tolist()
            for k, s in _sets(pdf):
                n = len(s)
                if not n or pd.isna(ids[k]):
                    continue
                width = bitmap_width(n)
                mixed = mix64(s)
                flips = np.bincount((mixed & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                order = classes[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(55) | mixed >> np.uint64(9)
                first = np.sort(np.partition(order, prefix_size(n) - 1)[: prefix_size(n)])
                rows.append((ids[k], *names_of(s), n, np.packbits(flips.astype(np.uint8)).tobytes(), first.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "h1", "h2", "n", "bits", "prefix"])

    return _texts(docs).mapInPandas(told, "doc_id long, h1 long, h2 long, n long, bits binary, prefix array<long>")


def _reach(common, x, y):
    """Whether so many common elements of sets of x and y are enough."""
    return (NUM + DEN) * common >= NUM * (x + y)


def _fit(x, y):
    return (DEN * F.least(x, y) >= NUM * F.greatest(x, y)) & (x > 0)


def least_difference(x: bytes, y: bytes) -> int:
    """A bound from below of the symmetric difference of two sets, from their bitmaps."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):  # a place modulo half the width: halves of the wider one flip each other
        if len(a) > len(b):
            a = _folded(a)
        else:
            b = _folded(b)
    return int(np.bitwise_count(a ^ b).sum())


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def may_link(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Of pairs (a, b) of sets, those that bitmaps don't exclude."""
    x, y = (index.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    both = pairs.join(x, "a").join(y, "b").filter(_fit(F.col("n_a"), F.col("n_b")))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n_a"].to_numpy() + pdf["n_b"].to_numpy()
            apart = np.array([least_difference(p, q) for p, q in zip(pdf["bits_a"], pdf["bits_b"])], dtype=np.int64)
            yield pdf.loc[_reach((n - apart) // 2, n, 0), ["a", "b"]]

    return both.select("a", "n_a", "bits_a", "b", "n_b", "bits_b").mapInPandas(told, "a long, b long")


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n, m, linked, differ) of pairs of sets: sizes, whether they link, and the hashes that one of them alone has.

    Pairs are grouped by b in chunks of some 64; a chunk reads b's text once and then
    one text for each of its pairs, so no group is held, whatever b's number of pairs.
    """
    sizes = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    dealt = materialize(pairs.join(sizes, "b").withColumn("chunk", F.pmod(F.xxhash64("a"), F.ceil(F.col("_n") / 64))).drop("_n"), "dealt")
    left = dealt.join(texts.select(F.col("sid").alias("a"), "text"), "a").select("b", "chunk", "a", "text")
    right = dealt.select("b", "chunk").distinct().join(texts.select(F.col("sid").alias("b"), "text"), "b").select("b", "chunk", F.lit(-1).cast("long").alias("a"), "text")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = held = None
        for pdf in runs(batches, 64):
            rows, who = [], list(zip(pdf["b"].tolist(), pdf["chunk"].tolist(), pdf["a"].tolist()))
            for k, s in _sets(pdf):
                b, chunk, a = who[k]
                if a < 0:
                    key, held = (b, chunk), s
                elif key == (b, chunk):
                    apart = np.setxor1d(s, held, assume_unique=True)
                    common = (len(s) + len(held) - len(apart)) // 2
                    rows.append((a, b, len(s), len(held), bool(_reach(common, len(s), len(held))), apart.tobytes()))
            yield pd.DataFrame(rows, columns=["a", "b", "n", "m", "linked", "differ"])

    ordered = left.unionByName(right).repartition("b", "chunk").sortWithinPartitions("b", "chunk", "a")
    return ordered.mapInPandas(told, "a long, b long, n long, m long, linked boolean, differ binary")


def index_lists(index: DataFrame) -> DataFrame:
    """(token, band, sid, n, pos, c, leader, leader_n, leader_pos) of the lists in which several sets of near sizes meet.

    Bands of sizes overlap, so sets whose sizes allow a link share one. A list's
    leader is the set that meets most others over all lists.
    """
    posted = index.select("sid", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    shared = materialize(posted.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    met = materialize(posted.join(shared, "token"), "met")
    central = met.groupBy("sid").agg(F.sum("c").alias("weight"))
    band = F.floor(F.log("n") / float(1.0001 * np.log(DEN / NUM)))
    ranked = met.join(central, "sid").withColumn("band", F.explode(F.array(band, band + 1))).withColumn("rank", F.struct("weight", (-F.col("sid")).alias("neg"), "n", "pos"))
    ranked = materialize(ranked.select("token", "band", "sid", "n", "pos", "rank"), "ranked")
    leaders = materialize(ranked.groupBy("token", "band").agg(F.count("*").alias("c"), F.max("rank").alias("top")).filter("c > 1"), "leaders")
    top = [(-F.col("top.neg")).alias("leader"), F.col("top.n").alias("leader_n"), F.col("top.pos").alias("leader_pos")]
    return materialize(ranked.drop("rank").join(leaders.select("token", "band", "c", *top), ["token", "band"]), "lists")


def _ahead(n, pos, m, at):
    """Whether two sets can still link if the first shingle they share has these positions."""
    return _reach(1 + F.least(n - pos, m - at), n, m)


def crossing(lists: DataFrame, index: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that meet in a list, aren't its leader's and aren't excluded by a bound.

    Lists are cut into blocks in order of component and position. Blocks of one and the same
    component don't meet, nor do those whose sizes or positions exclude any link. A
    set is in many lists, so blocks hold bitmaps folded to NARROW bytes; whole ones are asked of what is left.
    """
    named = lists.filter("c > 2").join(members, "sid")
    several = named.groupBy("token", "band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    opened = named.filter("sid <> leader").join(materialize(several.select("token", "band"), "several"), ["token", "band"]).select("token", "band", "sid", "n", "pos", "component")
    placed = numbered(opened, ["token", "band"], ["component", "pos", "sid"], "place").withColumn("block", F.floor(F.col("place") / BLOCK))
    held = placed.join(narrowed(index), "sid")
    blocks = held.groupBy("token", "band", "block").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("room"), F.collect_list(F.struct("sid", "n", "pos", "component", "bits")).alias("m")
    )
    blocks = materialize(blocks, "blocks")
    x, y = (blocks.select("token", "band", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high", "least", "most", "room", "m")]) for s in "xy")
    skip = (F.col("low_x") == F.col("high_y")) & (F.col("high_x") == F.col("low_y"))
    near = (DEN * F.col("most_x") >= NUM * F.col("least_y")) & (DEN * F.col("most_y") >= NUM * F.col("least_x"))
    pairs = x.join(y, ["token", "band"]).filter((F.col("block_x") <= F.col("block_y")) & ~skip & near & _reach(1 + F.least("room_x", "room_y"), F.col("least_x"), F.col("least_y")))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = {pair for p, q in zip(pdf["m_x"], pdf["m_y"]) for pair in _open_pairs(p, q)}
            yield pd.DataFrame(list(hits), columns=["a", "b"], dtype="int64")

    found = pairs.select("m_x", "m_y").mapInPandas(told, "a long, b long").distinct()
    return may_link(materialize(found, "met"), index)


def narrowed(index: DataFrame) -> DataFrame:
    """(sid, bits): bitmaps folded to at most NARROW bytes."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for bits in pdf["bits"]:
                b = np.frombuffer(bits, np.uint8)
                while len(b) > NARROW:
                    b = _folded(b)
                out.append(b.tobytes())
            yield pdf.assign(bits=out)

    return index.select("sid", "bits").mapInPandas(told, "sid long, bits binary")


def _open_pairs(x: list, y: list) -> Iterator[tuple[int, int]]:
    """Pairs of two blocks across components that positions, sizes and bitmaps don't exclude."""
    width = min(len(m["bits"]) for m in (*x, *y))

    def part(rows: list) -> tuple[np.ndarray, ...]:
        bits = []
        for m in rows:
            b = np.frombuffer(m["bits"], np.uint8)
            while len(b) > width:
                b = _folded(b)
            bits.append(b)
        return (*(np.array([m[c] for m in rows], dtype=np.int64) for c in ("sid", "n", "pos", "component")), np.array(bits).view(np.uint64))

    sid, n, pos, comp, bits = part(y)
    for a, a_n, a_pos, a_comp, a_bits in zip(*part(x)):
        both = n + a_n
        apart = np.bitwise_count(bits ^ a_bits).sum(axis=1, dtype=np.int64)
        ahead = 1 + np.minimum(n - pos, a_n - a_pos)
        hit = (comp != a_comp) & (DEN * np.minimum(n, a_n) >= NUM * np.maximum(n, a_n)) & _reach(ahead, both, 0) & _reach((both - apart) // 2, both, 0)
        for b in sid[hit].tolist():
            yield min(int(a), b), max(int(a), b)


def link_counts(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, others): rows of other sets that each set of ``members`` (sid, component, weight, copies) links with.

    Answers are derived from those of the component's leader, the set of most weight:
    a member's difference to it is formed once, and two members' difference from
    those two. Components are cut into parts, which meet two by two.
    """
    top = members.groupBy("component").agg(F.count("*").alias("_k"), F.max(F.struct("weight", "sid")).alias("_top")).filter("_k > 1")
    led = materialize(members.join(top, "component").select("sid", "component", "copies", F.col("_top.sid").alias("leader")), "led")
    apart = differences(led.filter("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b")), texts)
    apart = materialize(apart, "apart")
    leaders = apart.groupBy("b").agg(F.first("m").alias("n")).select(F.col("b").alias("sid"), "n", F.lit(b"").alias("differ"))
    held = apart.select(F.col("a").alias("sid"), "n", "differ").unionByName(leaders).join(led.drop("leader"), "sid")
    placed = numbered(held, ["component"], ["n", "sid"], "place").withColumn("part", F.floor(F.col("place") / PART))
    parts = placed.groupBy("component", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.collect_list(F.struct("sid", "n", "copies", "differ")).alias("m"))
    parts = materialize(parts, "parts")
    x, y = (parts.select("component", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "least", "most", "m")]) for s in "xy")
    # Parts come in order of size, so the earlier one's sets are the smaller ones.
    pairs = x.join(y, "component").filter((F.col("part_x") <= F.col("part_y")) & (DEN * F.col("most_x") >= NUM * F.col("least_y")))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same, p, q in zip(pdf["part_x"] == pdf["part_y"], pdf["m_x"], pdf["m_y"]):
                yield pd.DataFrame(_derived(p, q, same), columns=["sid", "others"])

    return pairs.select("part_x", "part_y", "m_x", "m_y").mapInPandas(told, "sid long, others long").groupBy("sid").agg(F.sum("others").alias("others"))


def _derived(x: list, y: list, same: bool) -> list[tuple[int, int]]:
    """(sid, linked rows of the other part) from differences to one leader: |Dy ^ Dz| = |Dy| + |Dz| - 2 |Dy & Dz|."""
    rows = x if same else [*x, *y]
    sets = [np.frombuffer(m["differ"], np.uint64) for m in rows]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    cut = 0 if same else len(x)
    common = np.zeros((len(x), len(rows) - cut), dtype=np.float32)
    for lo in range(0, len(flat), 1 << 14):  # bounded slices of the differences
        here = (at >= lo) & (at < lo + (1 << 14))
        held = np.zeros((len(sets), 1 << 14), dtype=np.float32)
        held[owner[here], at[here] - lo] = 1
        common += held[: len(x)] @ held[cut:].T
    n = np.array([m["n"] for m in rows], dtype=np.int64)
    copies = np.array([m["copies"] for m in rows], dtype=np.int64)
    apart = sizes[: len(x), None] + sizes[None, cut:] - 2 * common.astype(np.int64)
    both = n[: len(x), None] + n[None, cut:]
    hit = _reach((both - apart) // 2, both, 0)
    if same:
        np.fill_diagonal(hit, False)
        return list(zip([m["sid"] for m in x], (hit @ copies).tolist()))
    return [*zip([m["sid"] for m in x], (hit @ copies[cut:]).tolist()), *zip([m["sid"] for m in y], (copies[:cut] @ hit).tolist())]


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text).

    Rows link at 100 * intersection >= 90 * union of their sets of 3-word shingles;
    n_links counts the other rows that a row links with, copies included. Rows without words, null texts
    among them, have n_shingles 0, link with nothing and are their own component. Rows with a
    null doc_id link with nothing and have a null component. Rows that repeat a doc_id are one
    document in the graph, which links as any of them does. Texts of any length are hashed by slices.
    Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    sets, sketches = named_sets(docs)
    order = frequency_classes(sketches)
    worded = sets.filter("n > 0 and doc_id is not null")
    classes = worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("sid", F.monotonically_increasing_id()), "classes")
    heads = classes.select(F.col("rep").alias("doc_id"), "h1", "h2", "sid")
    index = index_rows(docs, order).join(heads, ["doc_id", "h1", "h2"]).dropDuplicates(["doc_id", "h1", "h2"]).select("sid", "n", "bits", "prefix")
    index = materialize(index, "index")
    lists = index_lists(index)

    asked = lists.filter((F.col("sid") != F.col("leader")) & _fit(F.col("n"), F.col("leader_n")) & _ahead(F.col("n"), F.col("pos"), F.col("leader_n"), F.col("leader_pos")))
    asked = materialize(asked.select(F.col("sid").alias("a"), F.col("leader").alias("b")).distinct(), "asked")
    near = materialize(may_link(asked, index), "near")
    texts = _texts_of(docs, heads, near)
    links = materialize(differences(near, texts).filter("linked").select("a", "b"), "links")
    doubled = _repeated(worded, classes)
    found = _labels(classes, links, doubled)

    more = materialize(crossing(lists, index, found.select("sid", "component")), "crossing")
    if not more.isEmpty():
        rest = _texts_of(docs, heads, more)
        fresh = differences(more, rest).filter("linked").select("a", "b")
        links = materialize(links.unionByName(fresh), "links")
        texts = texts.unionByName(rest).dropDuplicates(["sid"])
        found = _labels(classes, links, doubled)
    ends = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("weight"))
    members = found.join(ends, "sid").select("sid", "component", "weight", "copies")
    others = link_counts(materialize(members, "members"), texts)
    told = found.join(others, "sid", "left").select("h1", "h2", F.col("component").alias("component_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    has = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), *[F.when(has, F.col(c)).alias(c) for c in ("h1", "h2")]).join(materialize(told, "told"), ["h1", "h2"], "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of ids, as 64-bit cells, of at most 2**FILTER_BITS bits whatever their number: a fuller one lets more through to the join."""
    size = min(FILTER_BITS, max(12, (16 * max(1, ids.count()) - 1).bit_length()))
    spots = F.array(*[F.shiftrightunsigned(F.xxhash64(column), k).bitwiseAND(F.lit((1 << size) - 1)) for k in PROBES])
    cells = ids.select(F.explode(spots).alias("at")).select(F.shiftright("at", 6).alias("cell"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow().to_pandas()
    out = np.zeros(1 << max(0, size - 6), np.uint64)
    out[got["cell"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def _texts_of(docs: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, text) of the sets in ``pairs``. A doc_id that several texts have is told apart by its set's name."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = materialize(heads.join(wanted, "sid"), "wanted")
    # Most texts are in no pair; the filter spares their shuffle.
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "doc_id"))

    def may_be(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = sent.value
        mask = np.uint64(len(cells) * 64 - 1)
        for pdf in runs(batches):
            h = pdf["h"].to_numpy(np.int64).view(np.uint64)
            at = [(h >> np.uint64(k)) & mask for k in PROBES]
            pdf = pdf[np.logical_and.reduce([((cells[(a >> np.uint64(6)).astype(np.int64)] >> (a & np.uint64(63))) & np.uint64(1)).astype(bool) for a in at])]
            names = [names_of(s) if len(s) else (0, 0) for _, s in _sets(pdf)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(np.int64), "h1": [x for x, _ in names], "h2": [x for _, x in names], "text": pdf["text"].to_numpy()})

    rows = _texts(docs).filter("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    found = rows.mapInPandas(may_be, "doc_id long, h1 long, h2 long, text binary").join(wanted, ["doc_id", "h1", "h2"]).select("sid", "text")
    return materialize(found.dropDuplicates(["sid"]), "texts")


def _repeated(worded: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): a doc_id that rows with several sets share, and each such set's smallest doc_id."""
    name = F.struct("h1", "h2")
    twice = worded.groupBy("doc_id").agg(F.min(name).alias("_lo"), F.max(name).alias("_hi")).filter("_lo <> _hi").select("doc_id")
    return materialize(worded.join(twice, "doc_id").join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "repeated")


def _labels(classes: DataFrame, links: DataFrame, doubled: DataFrame) -> DataFrame:
    """Classes with ``component``, the smallest doc_id that links reach."""
    reps = classes.select("sid", "rep")
    edges = links.join(reps.withColumnsRenamed({"sid": "a", "rep": "u"}), "a").join(reps.withColumnsRenamed({"sid": "b", "rep": "v"}), "b").select("u", "v").unionByName(doubled)
    reached = components(edges.withColumnsRenamed({"u": "a", "v": "b"}))
    return materialize(classes.join(reached, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node"), "labels")
