"""Preparation: variance mask, scaling, encoding, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import smallest


def variances(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, var): population variance of each column; NaN where a value is NaN."""
    one = rows.agg(*[F.var_pop(c).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "var")


def varying(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose variance is above 0; one row of sums comes to the driver."""
    one = variances(rows, columns).filter((F.col("var") > 0) & ~F.isnan("var"))
    found = {r["feature"] for r in one.collect()}
    return [c for c in columns if c in found]


def masks(train: DataFrame, test: DataFrame, columns: list[str], legacy: bool = False) -> tuple[list[str], list[str]]:
    """The columns that train and test keep: those that vary in train, for both; with ``legacy`` each by its own rows."""
    kept = varying(train, columns)
    return kept, varying(test, columns) if legacy else kept


def fit_scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std) of each column, std over the population."""
    one = rows.agg(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns])).alias("m"))
    return one.select(F.explode("m").alias("feature", "s")).select("feature", "s.mean", "s.std")


def scaled(rows: DataFrame, scaler: DataFrame) -> DataFrame:
    """(x - mean) / std of the scaler's features; constant ones become 0. The scaler, a row per feature, comes to the driver once."""
    held = {r["feature"]: r for r in scaler.collect()}
    cell = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lit(held[c]["mean"]), F.lit(held[c]["std"])), F.lit(0.0))
    return rows.withColumns({c: cell(c) for c in rows.columns if c in held})


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation over all rows; constant columns become 0."""
    return scaled(rows, fit_scaler(rows, columns))


def label_codes(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, code): the distinct labels numbered in order of code point. Labels are few, so one task numbers them."""
    return rows.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)


def encoded(rows: DataFrame, codes: DataFrame, label: str = "label") -> DataFrame:
    return rows.join(codes, label, "left")


def stratified_split(rows: DataFrame, label: str, key: Column, tie: list[str], share: float = 0.2) -> DataFrame:
    """Add ``split``: within each label the share with the smallest ``key``, a number, is test, rounded; ties go by ``tie``.

    The key at each label's border is selected by rank, so no label is sorted.
    """
    cut = smallest(rows.withColumn("_key", key), [label], "_key", tie, lambda n: F.round(n * F.lit(share)), "_test")
    return cut.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_key", "_test")


def temporal_split(windows: DataFrame, lengths: DataFrame, size: int = 50, share: float = 0.8, legacy: bool = False, stride: int = 25) -> DataFrame:
    """Windows (series, win_start, split) of the first ``share`` of each series and of the rest.

    ``lengths`` has (series, n). Test windows are cut from the rest of the rows;
    with ``legacy`` their starts count from the series' head instead, which
    repeats train windows. ``windows`` has any columns beside series and win_start.
    """
    return _plan(lengths, size, share, legacy, stride).join(windows, ["series", "win_start"])


def _plan(lengths: DataFrame, size: int = 50, share: float = 0.8, legacy: bool = False, stride: int = 25) -> DataFrame:
    head = F.floor(F.col("n") * F.lit(share)).cast("long")

    def starts(n: Column, offset: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0).cast("long")), F.lit(stride).cast("long")), lambda s: s < n - size), lambda s: s + offset)

    plan = lengths.withColumn("_train", starts(head, F.lit(0).cast("long"))).withColumn("_test", starts(F.col("n") - head, F.lit(0).cast("long") if legacy else head))
    cut = plan.select("series", F.explode(F.concat(F.transform("_train", lambda s: F.struct(s.alias("win_start"), F.lit("train").alias("split"))), F.transform("_test", lambda s: F.struct(s.alias("win_start"), F.lit("test").alias("split"))))).alias("_c"))
    return cut.select("series", "_c.win_start", "_c.split")


def planned_windows(lengths: DataFrame, **options) -> DataFrame:
    """(series, win_start, split) alone; see temporal_split."""
    return _plan(lengths, **options)
