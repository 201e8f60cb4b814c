"""Random forests over DataFrames: fit, predict, importances, learning curve, SHAP; they are grown in ``forest``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import materialize
from .forest import DEPTH, LEAF, LOCAL, SEED, SPLIT, TREES, Forest, Held, Paths, add_shares, bin_edges, grow, hold, path_tables, shap, store_bins
from .prep import fit_scaler, label_codes, scaled, varying
from .scan import numbered
from .windows import segments

#: Nodes of forests that a task holds at once to score rows by.
NODES = 1 << 20
#: Rows whose SHAP values a task sums up at once.
EXPLAINED = 1 << 13


def _labels(rows: DataFrame, label: str) -> list[str]:
    """The distinct labels as text, in order; they are few."""
    return sorted(r[0] for r in rows.select(F.col(label).cast("string")).distinct().collect() if r[0] is not None)


def fit_forest(rows: DataFrame, columns: list[str], label: str = "label", trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, split: int = SPLIT, seed: int = SEED) -> Forest:
    """A forest of rows with a label; those without one aren't learned from."""
    return _fitted(rows, columns, label, trees=trees, depth=depth, leaf=leaf, split=split, seed=seed)[0]


def _fitted(rows: DataFrame, columns: list[str], label: str, **options) -> tuple[Forest, DataFrame]:
    """A forest and the bins of its rows, as stored."""
    labels, edges = _labels(rows, label), bin_edges(rows, columns)
    stored = store_bins(rows, columns, edges, labels, label)
    return grow(stored, labels, columns, edges, **options).forest(), stored


def predict(model: Forest, rows: DataFrame, label: str = "label") -> DataFrame:
    """Add prediction (the label's text) and probability (one number per label in sorted order)."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(model))  # its size is set by the forest's parameters

    @F.pandas_udf("array<double>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Forest(**sent.value)
        shares = held.shares()
        for x in batches:
            yield pd.Series(list(held.probabilities(held.binned(np.array(x.tolist(), float)), shares=shares)) if len(x) else [], dtype=object)

    names = F.array(*[F.lit(x) for x in model.labels])
    out = rows.withColumn("probability", told(F.array(*[F.col(c).cast("double") for c in model.columns])))
    best = F.array_position("probability", F.array_max("probability")) - 1
    return out.withColumn("prediction", F.get(names, best.cast("int"))).withColumn(label, F.col(label).cast("string"))


def class_scores(told: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """(class, score, positive): one-vs-rest scores of every class for each row."""
    cells = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("c"), F.col("probability").alias("p"))
    return told.select(F.col(label).alias("_l"), F.explode(cells).alias("x")).select(F.col("x.c").alias("class"), F.col("x.p").alias("score"), (F.col("_l") == F.col("x.c")).alias("positive"))


def importances(model: Forest, spark: SparkSession, fit: int = 0) -> DataFrame:
    """(feature, idx, importance): mean decrease of impurity, normalised."""
    return spark.createDataFrame([(c, i, float(v)) for i, (c, v) in enumerate(zip(model.columns, model.importances(fit)))], "feature string, idx int, importance double")


def segment_importances(rows: DataFrame, columns: list[str], top: list[str], label: str = "label", count: int = 5, trees: int = 100) -> DataFrame:
    """(segment, feature, importance) of forests fitted on consecutive segments of rows (series, i, ...), grown side by side."""
    cut, labels, edges = segments(rows, count), _labels(rows, label), bin_edges(rows, columns)
    stored = store_bins(cut, columns, edges, labels, label, F.array("segment"))
    model = grow(stored, labels, columns, edges, fits=count, trees=trees, depth=30, leaf=1, split=2)
    told = [(k, c, float(v)) for k, one in enumerate(model.importances()) for c, v in zip(columns, one) if c in top]
    return rows.sparkSession.createDataFrame(told, "segment int, feature string, importance double")


def learning_curve(rows: DataFrame, columns: list[str], key: str, label: str = "label", sizes: int = 10, folds: int = 5, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(size, fold, train, validation): accuracies of forests on growing shares of each fold's training rows.

    Rows are dealt to folds within their label in order of a hash of ``key``. All sizes and
    folds are grown side by side over one binned table: a fit in a task that holds the whole table,
    if that is small enough (see HELD), else by all tasks, and then scored in runs.
    """
    labels, edges = _labels(rows, label), bin_edges(rows, columns)
    dealt = numbered(rows.withColumn("_h", F.xxhash64(key)), [label], ["_h", key], "_i")
    dealt = dealt.withColumn("_fold", (F.col("_i") % folds).cast("int")).withColumn("_j", F.floor(F.col("_i") / folds))
    held = dealt.groupBy(F.col(label).alias("_label"), F.col("_fold").alias("_of")).agg(F.count("*").alias("_n"))
    dealt = dealt.join(held, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_fold") == F.col("_of")))
    every = F.sequence(F.lit(0), F.lit(sizes * folds - 1))
    mine = lambda k: (k % folds != F.col("_fold")) & (F.col("_j") < F.greatest(F.lit(1), F.round(F.col("_n") * (F.floor(k / folds) + 1) / sizes)))
    stored = store_bins(dealt, columns, edges, labels, label, F.filter(every, mine), ["_fold"])
    size = F.round((F.floor(F.col("fit") / folds) + 1) / sizes, 6)
    told = _scores(stored, labels, columns, edges, sizes * folds, folds, trees, depth)
    told = told.groupBy("fit").pivot("part", ["train", "validation"]).agg(F.sum("hits") / F.sum("n"))
    return told.select(size.alias("size"), (F.col("fit") % folds).cast("int").alias("fold"), "train", "validation")


def _scores(stored: DataFrame, labels: list[str], columns: list[str], edges: list[np.ndarray], fits: int, folds: int, trees: int, depth: int) -> DataFrame:
    """(fit, part, hits, n) of a learning curve's fits on rows that have a ``_fold``."""
    schema, classes, m, bins = "fit int, part string, hits long, n long", len(labels), max(1, int(np.sqrt(len(columns)))), max(len(e) for e in edges) + 1
    # A task that holds all rows holds the nodes of one step's trees.
    every = hold(stored.filter("code >= 0"), len(columns), fits, "_fold") if NODES >= max(LOCAL, 2 << depth) else None
    width = len(columns)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task grows a fit and scores its rows tree by tree, as it holds all of them."""
        rows = Held(every.value, width, fits)
        for pdf in batches:
            for fit in (fits - 1 - pdf["id"]).tolist():  # the largest come first
                learned, fold = rows.learned(fit), np.flatnonzero(rows.kept == fit % folds)
                asked = np.concatenate((learned, fold))
                out = np.zeros((len(asked), classes))
                step = max(1, LOCAL // max(1, len(learned)))
                for t in range(fit * trees, (fit + 1) * trees, step):
                    some = np.arange(t, min(t + step, (fit + 1) * trees))
                    add_shares(out, rows.x, asked, rows.grow(learned, some, depth, (classes, m, bins), LEAF, SPLIT, SEED), len(some), depth)
                hit = out.argmax(axis=1) == rows.code[asked]
                yield pd.DataFrame([(fit, "train", int(hit[: len(learned)].sum()), len(learned)), (fit, "validation", int(hit[len(learned) :].sum()), len(fold))], columns=["fit", "part", "hits", "n"])

    if every is not None:
        return materialize(stored.sparkSession.range(0, fits, 1, fits).mapInPandas(fitted, schema), "scores")
    grown = grow(stored, labels, columns, edges, fits=fits, trees=trees, depth=depth).stored()

    def score(first: int, last: int) -> DataFrame:
        """Hits of the fits ``first`` to ``last``, which are sent to all tasks."""
        sent = stored.sparkSession.sparkContext.broadcast(vars(grown.forest(first, last)))

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forest = Forest(**sent.value)
            shares = forest.shares()
            for pdf in batches:
                x = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), -1)
                code, fold = pdf["code"].to_numpy(), pdf["_fold"].to_numpy()
                train = [set(f) for f in pdf["fits"]]
                told = []
                for fit in range(first, last):
                    hit = forest.probabilities(x, fit - first, shares).argmax(axis=1) == code
                    for part, some in (("train", np.array([fit in t for t in train])), ("validation", fold == fit % folds)):
                        told.append((fit, part, int((hit & some).sum()), int(some.sum())))
                yield pd.DataFrame(told, columns=["fit", "part", "hits", "n"])

        found = materialize(stored.filter("code >= 0").mapInPandas(scored, schema).groupBy("fit", "part").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")), "scores")
        sent.destroy()
        return found

    # Fits are scored in runs of about NODES nodes, one at least, so what is sent doesn't grow with their number.
    nodes = {r["fit"]: r["n"] for r in grown.subtrees.groupBy("fit").agg(F.sum("sizes").alias("n")).collect()}
    told, first, held = None, 0, 0
    for fit in range(fits):
        held += nodes.get(fit, 0)
        if fit + 1 == fits or held + nodes.get(fit + 1, 0) > NODES:
            part = score(first, fit + 1)
            told, first, held = part if told is None else told.unionByName(part), fit + 1, 0
    return told


@dataclass
class Bundle:
    """All that scoring needs: the forest, the labels with their codes, the scaler and the columns kept."""

    forest: Forest
    codes: DataFrame
    scaler: DataFrame
    columns: list[str]

    def save(self, path: str) -> None:
        """Write the four parts below ``path``."""
        spark = self.codes.sparkSession
        self.forest.save(spark, f"{path}/forest")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
        spark.createDataFrame(list(enumerate(self.columns)), "idx int, feature string").write.mode("overwrite").parquet(f"{path}/mask")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        mask = spark.read.parquet(f"{path}/mask").orderBy("idx").collect()
        return cls(Forest.load(spark, f"{path}/forest"), spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/scaler"), [r["feature"] for r in mask])

    def predict(self, rows: DataFrame, label: str = "label") -> DataFrame:
        """Scale by the training rows' statistics and predict."""
        return predict(self.forest, scaled(rows, self.scaler), label)


def fit_bundle(rows: DataFrame, columns: list[str], label: str = "label", **options) -> Bundle:
    """Mask, scaler, codes and forest, all learned from ``rows``, which should be a stored table."""
    kept = varying(rows, columns)
    # A row per feature, computed once.
    scaler = rows.sparkSession.createDataFrame(fit_scaler(rows, kept).collect(), "feature string, mean double, std double")
    return Bundle(fit_forest(scaled(rows, scaler), kept, label, **options), label_codes(rows, label), scaler, kept)


def shap_values(model: Forest, rows: DataFrame, key: str) -> DataFrame:
    """(key, class, feature, shap) of each row: what each feature adds to each class's probability."""
    sent = rows.sparkSession.sparkContext.broadcast((model.labels, model.columns, vars(path_tables(model))))
    stored = store_bins(rows.withColumn("_none", F.lit(None).cast("string")), model.columns, model.edges, model.labels, "_none", keep=[key])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, columns, told = sent.value
        paths = Paths(**told)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                phi = shap(paths, np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), -1), len(columns))
                # All values of a row are one array, which Spark takes apart.
                yield pd.DataFrame({key: part[key].to_numpy(), "_phi": list(phi.transpose(0, 2, 1).reshape(len(part), -1))})

    kind, n = dict(rows.dtypes)[key], len(model.columns)
    wide = stored.select(key, "bins").mapInPandas(explain, f"`{key}` {kind}, _phi array<double>").select(key, F.posexplode("_phi").alias("_at", "shap"))
    name = lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), at.cast("int"))
    return wide.select(key, name(model.labels, F.floor(F.col("_at") / n)).alias("class"), name(model.columns, F.col("_at") % n).alias("feature"), "shap")


def fitted_shap_summary(rows: DataFrame, columns: list[str], label: str = "label", **options) -> DataFrame:
    """shap_summary of the values of a forest's own rows, told by fit_forest.

    A row's values depend on its bins only, so equal rows are explained once and counted; absolute values are
    added up in the tasks, so no value leaves them alone.
    """
    model, stored = _fitted(rows, columns, label, **options)
    spark, n, m = rows.sparkSession, len(columns), len(model.labels)
    sent, count = spark.sparkContext.broadcast(vars(path_tables(model))), stored.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // (8 * EXPLAINED)))  # large runs of rows share more

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, total = Paths(**sent.value), np.zeros(n * m)
        for x, often in _runs(batches, EXPLAINED):
            total += often @ np.abs(shap(paths, x, n).transpose(0, 2, 1).reshape(len(x), -1))
        yield pd.DataFrame([[total]], columns=["total"])

    distinct = stored.select("bins").repartition(tasks, "bins").groupBy("bins").agg(F.count("*").alias("n"))
    parts = distinct.mapInPandas(explain, "total array<double>").select(F.posexplode("total").alias("at", "total"))
    name = lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), at.cast("int"))
    found = parts.groupBy("at").agg((F.sum("total") / F.lit(count)).alias("mean_abs")) if count else parts.select("at", F.col("total").alias("mean_abs")).limit(0)
    return found.select(name(model.labels, F.floor(F.col("at") / n)).alias("class"), name(model.columns, F.col("at") % n).alias("feature"), "mean_abs")


def _runs(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of bins, how often each occurs) of about ``most`` rows, whatever the batches' sizes."""
    held, size = [], 0
    for pdf in batches:
        for lo in range(0, len(pdf), most):
            held.append(pdf.iloc[lo : lo + most])
            size += len(held[-1])
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if size:
        yield _joined(held)


def _joined(held: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    often = np.concatenate([pdf["n"].to_numpy(float) for pdf in held])
    return np.frombuffer(b"".join(b for pdf in held for b in pdf["bins"]), np.uint8).reshape(len(often), -1), often


def shap_summary(values: DataFrame) -> DataFrame:
    """(class, feature, mean_abs)."""
    return values.groupBy("class", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs"))
