"""Exact selection by rank: order statistics and quantiles of groups of any size.

No group's values are gathered or sorted as a whole. A group's bracket around the
wanted rank is narrowed by passes: each takes a fixed grid of approximate
percentiles within the bracket, which tasks sum up in bounded sketches, moves the
bracket to the grid points around the rank, whose distance exceeds the sketch's
error, and counts exactly what lies below. When few distinct values are left inside,
they are counted one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize
from .scan import prefix_scan

#: Grid of percentiles of a pass, and the sketch's accuracy; the grid's step must be well above one in ACCURACY.
GRID, ACCURACY = 256, 10000
#: Values strictly inside a bracket that may be counted one by one.
MOST = 10000


def order_statistics(values: DataFrame, keys: list[str], ranks: Callable[[Column], Column], value: str = "v", most: int = MOST) -> DataFrame:
    """(keys, n, rank, value, below) of the ranks, from 0, that ``ranks`` makes of each group's count: an array of longs.

    Nulls don't count, NaN is the largest value as in a sort; ``below`` counts smaller
    values. Ranks outside a group give no row. Null keys are a key like others.
    """
    kind = dict(values.dtypes)[value]
    held = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sizes = held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asked = sizes.withColumn("rank", F.explode(F.array_distinct(ranks(F.col("n"))))).filter("rank >= 0 and rank < n")
    # _below: values under _lo; _m: values in [_lo, _hi]; _in: those strictly inside.
    state = ["n", "rank", "_lo", "_hi", "_below", "_m", "_in"]
    open_ = asked.withColumns({"_below": F.lit(0).cast("long"), "_m": F.col("n"), "_in": F.col("n")})
    closed = None
    while True:
        open_ = materialize(open_.select(*keys, *state), "brackets")
        ready = open_.filter(F.col("_in") <= most)
        closed = ready if closed is None else closed.unionByName(ready)
        wide = open_.filter(F.col("_in") > most)
        if wide.isEmpty():
            break
        points = F.percentile_approx("_v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY))
        grid = _meet(held, wide, keys).filter("_v between _lo and _hi").groupBy(*keys, "rank").agg(points.alias("_grid"))
        place = (F.col("rank") - F.col("_below")) / F.col("_m") * GRID
        low = F.get("_grid", F.greatest(F.floor(place) - 1, F.lit(0)).cast("int"))
        high = F.get("_grid", F.least(F.ceil(place) + 1, F.lit(GRID)).cast("int"))
        moved = _meet(wide, grid, [*keys, "rank"]).withColumns({"_a": low.cast(kind), "_b": high.cast(kind)}).drop("_grid")
        moved = materialize(moved, "moved")
        counts = {"_less": F.col("_v") < F.col("_a"), "_held": F.col("_v").between(F.col("_a"), F.col("_b")), "_inner": (F.col("_v") > F.col("_a")) & (F.col("_v") < F.col("_b"))}
        counted = _meet(held, moved, keys).filter("_v between _lo and _hi").groupBy(*keys, "rank").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
        told = _meet(moved, counted, [*keys, "rank"]).withColumn("_under", F.col("_below") + F.col("_less"))
        # A bracket that missed its rank or shrank by nothing stays as it was and is counted value by value.
        good = (F.col("_under") <= F.col("rank")) & (F.col("rank") < F.col("_under") + F.col("_held")) & (F.col("_inner") < F.col("_in"))
        new = {"_lo": "_a", "_hi": "_b", "_below": "_under", "_m": "_held", "_in": "_inner"}
        open_ = told.withColumn("_good", good).withColumns({c: F.when(F.col("_good"), F.col(x)).otherwise(F.lit(0) if c == "_in" else F.col(c)) for c, x in new.items()})
    # Ranks of one bracket share its values, which are counted and put in order once for all of them.
    brackets = closed.groupBy(*keys, "n", "_lo", "_hi", "_below").agg(F.array_sort(F.collect_list("rank")).alias("_ranks"))
    # Distinct values of a bracket: its two ends and at most ``most`` between them.
    last = _meet(held, brackets, keys).filter("_v between _lo and _hi").groupBy(*keys, "n", "_ranks", "_below", "_v").agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*keys, "_ranks").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = last.withColumn("below", F.col("_below") + F.sum("_c").over(run) - F.col("_c"))
    found = found.withColumn("rank", F.explode(F.filter("_ranks", lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("_c")))))
    return found.select(*keys, "n", "rank", F.col("_v").alias(value), "below")


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null ones too; both sides are stored or aggregates, so Spark can split a large key."""
    there = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(there, same).drop(*[f"_on_{k}" for k in keys])


def exact_quantiles(values: DataFrame, keys: list[str], shares: list[float], value: str = "v", most: int = MOST) -> DataFrame:
    """(keys, q): an array with each share's quantile, linear between the two order statistics around (n - 1) * share."""
    place = lambda n, p: (n - 1) * F.lit(float(p))
    ranks = lambda n: F.array(*[x for p in shares for x in (F.floor(place(n, p)), F.least(F.floor(place(n, p)) + 1, n - 1))])
    found = order_statistics(values, keys, ranks, value, most)
    one = found.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", F.col(value).cast("double").alias("x")))).alias("_m"))

    def quantile(p: float) -> Column:
        at = place(F.col("n"), p)
        low = F.col("_m")[F.floor(at)]
        high = F.col("_m")[F.least(F.floor(at) + 1, F.col("n") - 1)]
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return one.select(*keys, F.array(*[quantile(p) for p in shares]).alias("q"))


def smallest(rows: DataFrame, keys: list[str], order: str, tie: list[str], count: Callable[[Column], Column], name: str = "chosen") -> DataFrame:
    """Add ``name``: whether a row is among the ``count(n)`` of its key's n with the smallest ``order``.

    The count-th smallest value is selected and rows are compared with it; only those
    that equal it are put in order, by ``tie``. Rows with a null ``order`` are never chosen.
    """
    edge = order_statistics(rows, keys, lambda n: F.array(count(n).cast("long") - 1), order)
    edge = edge.select(*[F.col(k).alias(f"_on_{k}") for k in keys], F.col(order).alias("_edge"), (F.col("rank") + 1 - F.col("below")).alias("_left"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    held = rows.join(materialize(edge, "edges"), same, "left").drop(*[f"_on_{k}" for k in keys])
    even = prefix_scan(held.filter(F.col(order) == F.col("_edge")), keys, tie, _before=("count", F.lit(1), "before"))
    even = even.withColumn(name, F.col("_before") < F.col("_left")).drop("_before")
    rest = held.filter((F.col(order) == F.col("_edge")).isNull() | (F.col(order) != F.col("_edge"))).withColumn(name, F.coalesce(F.col(order) < F.col("_edge"), F.lit(False)))
    return rest.unionByName(even).drop("_edge", "_left")
