"""Running aggregates and selection by rank in which no task holds a whole group.

Rows are dealt to ranges of (keys, order) by sampled bounds, each range is scanned
by itself, and what a key has gathered in the ranges before is added: a range
begins with at most one key that an earlier one began, so those sums are one row
per range at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize

#: kind of running aggregate: (its function, how the sums of earlier ranges join a range's own).
KINDS = {
    "count": (lambda c: F.count(c), lambda before, own: before + own),
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "xor": (F.bit_xor, lambda before, own: F.coalesce(before.bitwiseXOR(own), before, own)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda before, own: F.coalesce(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def prefix_scan(rows: DataFrame, keys: list[str], order: list, **running: tuple) -> DataFrame:
    """Add running aggregates over the rows of each key, from its first row in ``order`` to the row itself.

    ``running`` is name=(kind, column), or name=(kind, column, "before") to leave
    the row itself out; kinds are count, sum, max, xor, first and last, which pass
    over nulls; first and last need rising orders. Nothing before a row is null, a count 0. Rows that tie in the whole
    ``order`` come in any order. Null keys are a key like others.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    own = "_scan"
    while any(c.lower().startswith(own) for c in rows.columns):
        own += "_"
    part, at, head, more = (own + x for x in ("_range", "_at", "_head", "_more"))
    asked = {f"{own}{i}": (name, *spec) for i, (name, spec) in enumerate(running.items())}
    held = rows.withColumns({x: spec[2] for x, spec in asked.items()})
    ranged = materialize(held.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranges")

    # Only the first key of a range can have begun in an earlier one, so no other key's sums are of use.
    totals = ranged
    if keys:
        heads = ranged.groupBy(part).agg(F.min(F.struct(*keys)).alias(head)).select(head).distinct()
        totals = ranged.join(F.broadcast(heads), F.struct(*keys).eqNullSafe(F.col(head)), "left_semi")  # a row per range at most
    totals = totals.groupBy(part, *keys).agg(*[KINDS[kind][0](x).alias(x) for x, (_, kind, *_) in asked.items() if kind not in ("first", "last")], *_ends(asked, order))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"count": F.sum, "sum": F.sum, "max": F.max, "xor": F.bit_xor, "first": KINDS["first"][0], "last": KINDS["last"][0]}
    carried = totals.withColumn(more, F.row_number().over(Window.partitionBy(*keys).orderBy(part)) > 1)
    carried = carried.withColumns({x: merge[kind](x).over(earlier) for x, (_, kind, *_) in asked.items()}).filter(more)
    carried = carried.select(F.col(part).alias(at), *[F.col(k).alias(f"{own}_key{i}") for i, k in enumerate(keys)], *[F.col(x).alias(f"{x}_before") for x in asked])

    out = ranged
    for x, (_, kind, _, *before) in asked.items():
        w = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        out = out.withColumn(f"{x}_own", KINDS[kind][0](x).over(w))
    same = F.col(part) == F.col(at)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{own}_key{i}"))
    out = out.join(F.broadcast(carried), same, "left")  # a row per range at most
    final = {}
    for x, (name, kind, *_) in asked.items():
        before = F.coalesce(f"{x}_before", F.lit(0)) if kind == "count" else F.col(f"{x}_before")
        final[name] = KINDS[kind][1](before, F.col(f"{x}_own"))
    return out.select(*[F.col(c) for c in rows.columns if c not in final], *[c.alias(n) for n, c in final.items()])


def _ends(asked: dict, order: list) -> list[Column]:
    """The first and the last value of a range, by order: the extremes of (order, value) over rows that have one."""
    out = []
    for x, (_, kind, *_) in asked.items():
        if kind in ("first", "last"):
            key = F.struct(*order, x)
            pick = F.min if kind == "first" else F.max
            out.append(pick(F.when(F.col(x).isNotNull(), key))[x].alias(x))
    return out


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "i") -> DataFrame:
    """Add ``name``, the ordinal of each row among its key's, from 0."""
    out = prefix_scan(rows, keys, order, **{name: ("count", F.lit(1), "before")})
    return out.withColumn(name, F.col(name).cast("long"))
