"""Prefix trie of conversations, its subtree totals by messages from peeled leaves.

A node is a distinct sequence of first turns. It is named by its depth and by 128
bits: the exclusive or of hashes of each turn with its place, which running
aggregates give without a task that holds a conversation. Texts are read once, for
their hash and size, and never move.

Totals climb from the leaves. Each node has a counter of children that haven't
reported. A chain of nodes with one child each has but one counter, its lowest
node's: its own sums are formed once, by a running sum along the chain, so a
conversation of thousands of turns is one step. A round takes the chains whose
counter is 0, sends their totals to the parents, lowers those counters and goes
on until only the root is left. Rounds are as many as branchings lie above each
other; whatever a parent's number of children, their messages are added up before
they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered, prefix_scan
from .base import materialize

#: Members of a block of the lists of conversations that end at a node.
BLOCK = 4096
KEY = ["depth", "k1", "k2"]


def turn_names(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, t1, t2, size): the turns in order, by hashes of role and text and the text's UTF-8 bytes.

    Turns of one number come in order of role and text; rows of a null conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.xxhash64(F.lit(s), role, text).alias(f"t{s}") for s in (1, 2)], F.octet_length(text).cast("long").alias("size"), F.xxhash64(role).alias("_r")
    )
    return numbered(rows, ["conv_id"], ["turn", "_r", "t1", "t2"]).drop("turn", "_r")


def rebuilt(turns: DataFrame, share: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, place, t1, t2, size): each conversation with the head of another one in place of its own.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation
    c - c % ``share``, as many as there are, and then its own turns after its first h.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("_n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = ids.withColumn("_h", head).withColumn("_from", F.col("conv_id") - F.col("conv_id") % share)
    lengths = ids.select(F.col("conv_id").alias("_source"), F.col("_n").alias("_there"))
    ids = materialize(ids.join(lengths, F.col("_from") == F.col("_source"), "left").select("conv_id", "_h", "_from", F.least("_h", F.coalesce("_there", F.lit(0))).alias("_taken")), "plans")
    # Of a source only its first turns are read, so a conversation has less than ``most`` rows in this join.
    heads = turns.filter(F.col("i") < most).withColumnRenamed("conv_id", "_source").join(ids.select("conv_id", "_from", "_taken"), F.col("_source") == F.col("_from")).filter("i < _taken")
    own = turns.filter(F.col("i") < most).join(ids.select("conv_id", "_h", "_taken"), "conv_id").filter("i >= _h")
    # Turns beyond every head keep their conversation whatever it is, only their place moves.
    shift = ids.select("conv_id", "_h", "_taken")
    late = turns.filter(F.col("i") >= most).join(shift, "conv_id")
    place = (F.col("_taken") + F.col("i") - F.col("_h")).alias("place")
    cols = ["t1", "t2", "size"]
    return heads.select("conv_id", F.col("i").alias("place"), *cols).unionByName(own.select("conv_id", place, *cols)).unionByName(late.select("conv_id", place, *cols))


def paths(turns: DataFrame, every: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, size): a row for each node on the path of each conversation, with its parent's name.

    ``turns`` has (conv_id, place, t1, t2, size), places 0, 1, ... in order;
    ``every`` (conv_id) holds those without turns too, whose path is the root alone.
    """
    marked = turns.select("conv_id", "place", "size", *[F.xxhash64("place", f"t{s}").alias(f"_m{s}") for s in (1, 2)])
    ran = prefix_scan(marked, ["conv_id"], ["place"], k1=("xor", F.col("_m1")), k2=("xor", F.col("_m2")))
    below = ran.select("conv_id", (F.col("place") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("_m1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("_m2")).alias("p2"), "size")
    zero = F.lit(0).cast("long")
    root = every.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("size"))
    return below.unionByName(root)


def nodes(path: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, n_convs, own, n_children, parent_conv_id, top): the trie, stored.

    ``own`` is what sharing the node's last turn saves. ``top`` says that a chain of only
    children begins here: at the root and at each child of a node with several.
    """
    seen = path.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("size").alias("_size"))
    seen = materialize(seen.withColumn("own", (F.col("n_convs") - 1) * F.col("_size")).drop("_size"), "nodes")
    children = seen.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    counted = materialize(seen.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    parents = counted.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("top"))
    # Children of one parent may be most of the nodes; both sides are stored, so Spark can split them.
    told = counted.join(parents, ["depth", "p1", "p2"], "left").withColumn("top", F.coalesce("top", F.lit(True)))
    return materialize(told.drop("p1", "p2"), "trie")


def on_chains(found: DataFrame, path: DataFrame) -> DataFrame:
    """Nodes with ``at``, the name of the chain's top, ``up``, that of the chain above, and ``upto``, the own sums from the root to the node."""
    least = found.select("conv_id").distinct()
    flags = found.filter("depth > 0").select(*KEY, "top", "own", F.col("conv_id").alias("_least"))
    # Paths of conversations that are no node's smallest aren't needed, so copies of one conversation drop out here.
    steps = path.filter("depth > 0").select("conv_id", *KEY).join(least, "conv_id", "left_semi")
    steps = materialize(steps, "steps").join(flags, KEY)
    name = F.when(F.col("top"), F.struct("depth", "k1", "k2"))
    ran = prefix_scan(steps, ["conv_id"], ["depth"], at=("last", name), up=("last", name, "before"), upto=("sum", F.col("own")))
    root = F.struct(*[F.lit(0).cast("long").alias(c) for c in KEY])
    # What a row says of its node is the same on every path; that of the node's smallest conversation is taken.
    below = ran.filter(F.col("conv_id") == F.col("_least")).select(*KEY, F.coalesce("at", root).alias("at"), F.when(F.coalesce("at", root) != root, F.coalesce("up", root)).alias("up"), "upto")
    # On a path, what lies before a chain's inner node is the chain itself; its top alone tells the chain above.
    below = below.withColumn("up", F.when((F.col("depth") == F.col("at.depth")), F.col("up")))
    first = found.filter("depth = 0").select(*KEY, root.alias("at"), F.lit(None).cast("struct<depth:bigint,k1:bigint,k2:bigint>").alias("up"), F.lit(0).cast("long").alias("upto"))
    return materialize(found.drop("top").join(below.unionByName(first), KEY), "chained")


def peel(chained: DataFrame) -> DataFrame:
    """(at, leaves, saved, bottom): of each chain, its leaves, what the nodes below its lowest node save, and the own sums from the root to that node."""
    lowest = F.max_by(F.struct("n_children", "upto"), "depth")
    chains = chained.groupBy("at").agg(lowest.alias("low"), F.min_by(F.col("upto") - F.col("own"), "depth").alias("above"), F.first("up", ignorenulls=True).alias("up"))
    zero = F.lit(0).cast("long")
    open_ = materialize(chains.select("at", "up", F.col("low.n_children").alias("waits"), (F.col("low.n_children") == 0).cast("long").alias("leaves"), zero.alias("saved"), F.col("low.upto").alias("bottom"), (F.col("low.upto") - F.col("above")).alias("own")), "chains")
    done = None
    while True:
        ready = open_.filter("waits = 0").select("at", "leaves", "saved", "bottom")
        done = ready if done is None else done.unionByName(ready)
        sent = open_.filter("waits = 0 and up is not null").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum(F.col("saved") + F.col("own")).alias("_saved"))
        left = open_.filter("waits > 0").join(sent, "at", "left")
        left = left.select("at", "up", *[(F.col(c) + sign * F.coalesce(x, zero)).alias(c) for c, sign, x in (("waits", -1, "_n"), ("leaves", 1, "_leaves"), ("saved", 1, "_saved"))], "bottom", "own")
        open_ = materialize(left, "chains")
        if open_.isEmpty():
            return done


def end_digests(path: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end.

    A digest runs over its list from first to last, so the ids are sorted by ranges of
    (node, id) and packed in blocks by many tasks; what is left for one task is to
    hash a node's blocks one after another, of which it holds one at a time.
    """
    ends = path.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("end.*", "conv_id")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            names, ids = pdf[KEY].to_numpy(np.int64), pdf["conv_id"].to_numpy(np.int64)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            bounds = [x for lo, hi in zip([0, *cuts], [*cuts, len(ids)]) for x in range(lo, hi, BLOCK)]
            rows = [(*names[lo].tolist(), int(ids[lo]), ids[lo:hi].tobytes()) for lo, hi in zip(bounds, [*bounds[1:], len(ids)])]
            yield pd.DataFrame(rows, columns=[*KEY, "first", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = sha = None
        for pdf in batches:
            rows = []
            for *key, ids in pdf[[*KEY, "ids"]].itertuples(index=False, name=None):
                text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode()
                if key == name:
                    sha.update(b"," + text)
                else:
                    if name is not None:
                        rows.append((*name, sha.hexdigest()))
                    name, sha = key, hashlib.sha256(text)
            yield pd.DataFrame(rows, columns=[*KEY, "ends_sha256"])
        if name is not None:
            yield pd.DataFrame([(*name, sha.hexdigest())], columns=[*KEY, "ends_sha256"])

    packed = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInPandas(blocks, "depth long, k1 long, k2 long, first long, ids binary")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, every: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, place, t1, t2, size); ``every`` has all their ids.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256 of each. No conversations, no nodes.
    """
    path = materialize(paths(turns, every), "paths")
    found = nodes(path)
    chained = on_chains(found, path)
    totals = materialize(peel(chained), "totals")
    saved = F.col("saved") + F.col("bottom") - F.col("upto") + F.col("own")
    out = chained.join(totals, "at").join(end_digests(path), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, share: int = 5, most: int = 9) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text); see rebuilt, prefix_trie.

    Null turns come first, turns of one number by their hashes, so repeated rows are
    turns of their own. Null roles and texts are empty. Rows with a null conv_id belong to no
    conversation and are left out. Texts of any length are only hashed. Other columns,
    whatever their names, are not read; an empty table gives no rows.
    """
    turns = materialize(turn_names(conversations), "turns")
    every = turns.select("conv_id").distinct()
    return prefix_trie(materialize(rebuilt(turns, share, most), "rebuilt"), every)
