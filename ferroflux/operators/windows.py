"""Count-based sliding windows, clipping, trailing views, retention and segments.

Every function takes rows (series, i, ...) in which i is the row's ordinal from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, quantile
from ..schema import AXES, RETAIN, STRIDE, WINDOW
from ..store import materialize
from .scan import numbered
from .select import exact_quantiles


def ordinals(rows: DataFrame, series: str, *order: str, chunk: Column | None = None) -> DataFrame:
    """Add ``i``, the ordinal of each row in its series.

    Rows are numbered by ranges, see ``scan``, so that a series of any length is many
    tasks'. With ``chunk``, a coarse key that rises with the order, such as the day,
    the chunks are the ranges, and nothing is stored.
    """
    if chunk is None:
        return numbered(rows, [series], list(order))
    cut = rows.withColumn("_chunk", chunk)
    before = Window.partitionBy(series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(series, "_chunk").agg(F.count("*").alias("_size"))
    starts = sizes.select(F.col(series).alias("_series"), F.col("_chunk").alias("_part"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(series, "_chunk").orderBy(*order)).cast("long") - 1
    joined = cut.withColumn("_inside", inside).join(starts, F.col(series).eqNullSafe(F.col("_series")) & F.col("_chunk").eqNullSafe(F.col("_part")))
    return joined.withColumn("i", F.col("_inside") + F.col("_start")).drop("_chunk", "_part", "_series", "_inside", "_start")


def with_totals(rows: DataFrame, by: list[str], **totals: Column) -> DataFrame:
    """Add aggregates over each group to its rows.

    They are summed up before the shuffle and joined back, so that a group of most
    rows is no single task's; few groups are sent to all tasks, if Spark finds them small.
    """
    found = rows.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    return rows.join(found, by)


def clip_series(rows: DataFrame, columns: tuple[str, ...] = AXES, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clamp each column to its exact quantiles over the whole series, selected by rank without gathering it.

    NaN in a column makes the whole column of its series NaN.
    """
    held = rows.select("series", *columns).unpivot(["series"], list(columns), "_axis", "v")
    found = exact_quantiles(held.filter(~F.isnan("v")), ["series", "_axis"], [low, high])
    nan = held.groupBy("series", "_axis").agg(F.max(F.isnan("v")).alias("nan"))
    per = nan.join(found, ["series", "_axis"], "left").groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("_axis", F.struct("q", "nan")))).alias("_bounds"))
    out = rows.join(materialize(per, "bounds"), "series")
    for c in columns:
        b = F.col("_bounds")[c]
        out = out.withColumn(c, F.when(b["nan"], F.lit(float("nan"))).otherwise(clip(F.col(c), b["q"][0], b["q"][1])))
    return out.drop("_bounds")


def window_starts(n: Column, size: int = WINDOW, stride: int = STRIDE) -> Column:
    """Starts 0, stride, ... below n - size; a series of exactly ``size`` rows has none."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0)).cast("long"), F.lit(stride).cast("long")), lambda s: s < n - size)


def assign_windows(rows: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """A row per window it lies in: adds win_start. Arithmetic, so no range join.

    A window is there only if a row beyond its end is, hence the count of rows.
    """
    last = F.floor(F.col("i") / stride) * stride
    starts = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // stride)), lambda k: (last - k * stride).cast("long"))
    good = F.filter(starts, lambda s: (s >= 0) & (s < F.col("_n") - size) & (F.col("i") < s + size))
    return with_totals(rows, ["series"], _n=F.count("*")).withColumn("win_start", F.explode(good)).drop("_n")


def window_arrays(rows: DataFrame, columns: tuple[str, ...] = AXES, low: float = 0.01, high: float = 0.99, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(series, win_start, and an array per column), each clamped again to its quantiles in the window."""
    cut = assign_windows(rows.select("series", "i", *columns), size, stride)
    held = cut.groupBy("series", "win_start").agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("_w"))
    for c in columns:
        raw = F.col(f"_w.{c}")
        held = held.withColumn(c, raw).withColumn("_s", F.array_sort(c))
        held = held.withColumn("_lo", quantile(F.col("_s"), low)).withColumn("_hi", quantile(F.col("_s"), high))
        held = held.withColumn(c, F.transform(c, lambda v: clip(v, F.col("_lo"), F.col("_hi"))))
    return held.drop("_w", "_s", "_lo", "_hi")


def from_end(rows: DataFrame, by: str = "series") -> DataFrame:
    """Add ``back``, 1 for the last row of each series, whose ordinals count from 0 without gaps."""
    return with_totals(rows, [by], _n=F.count("*")).withColumn("back", F.col("_n") - F.col("i")).drop("_n")


def trailing(rows: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` rows of each series."""
    return from_end(rows).filter(F.col("back") <= n).drop("back")


def retained(rows: DataFrame, n: int = RETAIN) -> DataFrame:
    return trailing(rows, n)


def decimated(rows: DataFrame, limit: int = 5000, head: int = 1000) -> DataFrame:
    """Every second of the first ``head`` rows of series longer than ``limit``; other rows stay."""
    return with_totals(rows, ["series"], _n=F.count("*")).filter((F.col("_n") <= limit) | (F.col("i") >= head) | (F.col("i") % 2 == 0)).drop("_n")


def recent_view(rows: DataFrame, time: str = "t_s", seconds: int = 30, ahead: int = 5) -> DataFrame:
    """Rows of each series within [max(0, int(latest - seconds)), latest + ahead]."""
    from_ = F.greatest(F.lit(0), F.col("_latest").cast("double") - seconds).cast("long")
    return with_totals(rows, ["series"], _latest=F.max(time)).filter((F.col(time) >= from_) & (F.col(time) <= F.col("_latest") + ahead)).drop("_latest")


def markers(rows: DataFrame, last: int = 20, every: int = 4) -> DataFrame:
    """Every fourth of the last 20 rows of each series, from the first of them on."""
    found = with_totals(rows, ["series"], _n=F.count("*")).withColumn("_back", F.col("_n") - F.col("i"))
    return found.filter((F.col("_back") <= last) & (F.pmod(F.least("_n", F.lit(last)) - F.col("_back"), F.lit(every)) == 0)).drop("_back", "_n")


def segments(rows: DataFrame, count: int = 5) -> DataFrame:
    """Add ``segment``: equal runs of n div count rows, the last with the remainder."""
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / count))
    return with_totals(rows, ["series"], _n=F.count("*")).withColumn("segment", F.least(F.floor(F.col("i") / size), F.lit(count - 1)).cast("int")).drop("_n")


def three_sigma(rows: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Rows strictly within three population deviations of their group's mean; a constant group keeps none."""
    kept = with_totals(rows, by, _m=F.avg(value), _s=F.stddev_pop(value))
    return kept.filter(F.abs(F.col(value) - F.col("_m")) < 3 * F.col("_s")).drop("_m", "_s")


def pooled(rows: DataFrame, columns: tuple[str, ...] = AXES) -> DataFrame:
    """The columns' values under each other: axis, v."""
    return rows.unpivot([c for c in rows.columns if c not in columns], list(columns), "axis", "v")


def pooled_stats(rows: DataFrame, n: int = 100) -> DataFrame:
    """Mean, deviation, least and largest of the last ``n`` rows of all axes of each series with over 5 rows."""
    last = trailing(with_totals(rows, ["series"], _n=F.count("*")).filter("_n > 5").drop("_n"), n)
    v = pooled(last.select("series", "i", *AXES))
    return v.groupBy("series").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))


def axis_range(rows: DataFrame, n: int = 100, calibration: bool = False) -> DataFrame:
    """(series, dmin, dmax, pad, ymin, ymax) that a live view wants after 3-sigma filtering; without state."""
    outer, inner = (300.0, 50.0) if calibration else (150.0, 20.0)
    last = trailing(with_totals(rows, ["series"], _n=F.count("*")).filter("_n > 5").drop("_n"), n)
    kept = three_sigma(pooled(last.select("series", "i", *AXES)), ["series"])
    out = kept.groupBy("series").agg(F.min("v").alias("dmin"), F.max("v").alias("dmax"))
    out = out.withColumn("pad", F.greatest(F.lit(20.0), 0.2 * (F.col("dmax") - F.col("dmin"))))
    low = F.greatest(F.lit(-outer), F.least(F.lit(-inner), F.col("dmin") - F.col("pad")))
    high = F.least(F.lit(outer), F.greatest(F.lit(inner), F.col("dmax") + F.col("pad")))
    return out.withColumn("ymin", low).withColumn("ymax", high)
