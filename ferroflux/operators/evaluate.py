"""Evaluation of predictions as tables: confusion, report, ROC, AUC, histograms, correlation, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import prefix_scan


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for every pair of classes seen, absent pairs with 0."""
    counts = rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).filter("c is not null").distinct()
    grid = classes.select(F.col("c").alias("label")).crossJoin(classes.select(F.col("c").alias("prediction")))  # classes squared, a few rows
    return grid.join(counts, ["label", "prediction"], "left").fillna(0, "n")


def confusion_matrix(table: DataFrame, classes: list) -> DataFrame:
    return table.groupBy("label").pivot("prediction", classes).agg(F.first("n"))


def report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) per class, then accuracy, macro avg and weighted avg; 0 over 0 is 0."""
    pairs = confusion(rows, label, prediction)
    each = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("actual")), F.struct(F.col("prediction").alias("c"), F.lit(0).alias("actual")))).alias("x"), "n", (F.col("label") == F.col("prediction")).alias("hit"))
    each = each.groupBy(F.col("x.c").alias("c")).agg(
        F.sum(F.when(F.col("x.actual") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.actual") == 0, F.col("n")).otherwise(0)).alias("told"),
        F.sum(F.when(F.col("hit") & (F.col("x.actual") == 1), F.col("n")).otherwise(0)).alias("hits"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = each.withColumn("precision", zero(F.col("hits"), F.col("told"))).withColumn("recall", zero(F.col("hits"), F.col("support")))
    each = each.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    classes = each.select(F.col("c").cast("string").alias("class"), *names, "support")
    every = F.sum("support").alias("support")
    accuracy = zero(F.sum("hits"), F.sum("support"))
    one = each.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in names], accuracy.alias("accuracy"), every)
    rows_ = F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(c) for c in names], "support"),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"m_{c}").alias(c) for c in names], "support"),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"w_{c}").alias(c) for c in names], "support"),
    )
    return classes.unionByName(one.select(F.explode(rows_).alias("r")).select("r.*"))


def roc(scores: DataFrame) -> DataFrame:
    """(class, threshold, tp, fp, tpr, fpr) at every distinct score of ``scores`` (class, score, positive).

    Equal scores are counted first; the sums then run over ranges of scores, so
    that no task holds a class.
    """
    steps = scores.groupBy("class", "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    run = prefix_scan(steps, ["class"], [F.col("score").desc()], tp=("sum", F.col("p")), fp=("sum", F.col("n")))
    whole = steps.groupBy(F.col("class").alias("_class")).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = run.join(whole, F.col("class").eqNullSafe(F.col("_class")))
    return out.select("class", F.col("score").alias("threshold"), "tp", "fp", zero(F.col("tp"), F.col("_p")).alias("tpr"), zero(F.col("fp"), F.col("_n")).alias("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    """(class, auc) by trapezoids from (0, 0) through the points of a curve, which rise in fpr and tpr."""
    rates = curve.select("class", "fpr", "tpr")
    steps = prefix_scan(rates, ["class"], ["fpr", "tpr"], _f=("last", F.col("fpr"), "before"), _t=("last", F.col("tpr"), "before"))
    zero = F.lit(0.0)
    return steps.groupBy("class").agg(F.sum((F.col("fpr") - F.coalesce("_f", zero)) * (F.col("tpr") + F.coalesce("_t", zero)) / 2).alias("auc"))


def probability_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """(class, bin, n) of ``scores`` (class, p): equal bins over the class's own range, the last one closed."""
    bounds = scores.groupBy("class").agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    share = F.coalesce(F.try_divide(F.col("p") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5))
    bin_ = F.least(F.floor(share * bins) + 1, F.lit(bins)).cast("int")
    return scores.join(bounds, "class").groupBy("class", bin_.alias("bin")).agg(F.count("*").alias("n"))


def learning_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of (size, train, validation)."""
    return folds.groupBy("size").agg(*[f(c).alias(f"{c}_{n}") for c in ("train", "validation") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's r of every pair of columns, within [-1, 1]; NaN where one is constant.

    Columns are centred by a first aggregation; tasks add up the products of a
    batch as one matrix product, so hundreds of columns are still one pass. Whether
    a column is constant is told by its extremes, not by sums that leave rounding. Rows
    with a null or NaN in a column make that column's r NaN.
    """
    n = len(columns)
    one = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
    means = np.array([np.nan if one[f"m{i}"] is None else one[f"m{i}"] for i in range(n)], float)
    still = [one[f"a{i}"] is None or one[f"a{i}"] == one[f"b{i}"] for i in range(n)]
    flat = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((n, n))
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, float) for v in pdf["x"]]) - means
                held += x.T @ x
        i, j = np.triu_indices(n)
        yield pd.DataFrame({"i": i, "j": j, "s": held[i, j]})

    sums = flat.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    diagonal = sums.filter("i = j").select("i", F.sqrt("s").alias("d"))
    both = sums.join(diagonal, "i").join(diagonal.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    constant, nan = F.array(*map(F.lit, still)), F.lit(float("nan"))
    ratio = F.try_divide("s", F.col("d") * F.col("e"))
    bounded = F.when(F.isnan(ratio), nan).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    r = F.when(F.get(constant, "i") | F.get(constant, "j"), nan).otherwise(F.coalesce(bounded, nan))
    names = F.array(*map(F.lit, columns))
    pair = lambda i, j: F.struct(F.get(names, i).alias("a"), F.get(names, j).alias("b"), r.alias("r"))
    sides = F.when(F.col("i") == F.col("j"), F.array(pair("i", "j"))).otherwise(F.array(pair("i", "j"), pair("j", "i")))
    return both.select(F.explode(sides).alias("p")).select("p.*")


def top_importances(importances: DataFrame, k: int = 20, ascending: bool = False) -> DataFrame:
    """The k features (feature, idx, importance) of most importance; ties go to the later one."""
    best = importances.orderBy(F.col("importance").desc(), F.col("idx").desc()).limit(k)
    return best.orderBy("importance", "idx") if ascending else best


def named(rows: DataFrame, names: DataFrame, key: str = "label") -> DataFrame:
    """Add ``english``, the name of a label or the label itself."""
    return rows.join(F.broadcast(names.select(F.col("label").alias(key), "english")), key, "left").withColumn("english", F.coalesce("english", key))
