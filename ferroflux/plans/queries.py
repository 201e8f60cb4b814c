"""Registered queries over the reference tables; their SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import elapsed_name, raw_counts
from ..operators import evaluate, features, ingest, model, prep
from ..operators import windows as win
from ..schema import AXES, feature_names, materials
from ..store import materialize, scratch
from ..streaming import banner, received, within
from . import signals as s


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with -0.0 as 0.0, so that results compare by value."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.long_form(ingest.accepted(ingest.parse(s.lines(spark, sf_dir))))
    return rounded(rows.select("session", "seq", "ms", "sensor", "axis", "raw", "ut"))


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejects(ingest.parse(s.lines(spark, sf_dir))).select("session", "seq", F.col("value").alias("line"), "reason")


def parse_one_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.long_form(ingest.accepted(ingest.parse(s.lines(spark, sf_dir), sensor=2)))
    return rounded(rows.select("session", "seq", "ms", "sensor", "axis", "raw", "ut"))


def parse_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.elapsed(ingest.accepted(ingest.parse(s.lines(spark, sf_dir))))
    return rounded(ingest.wide_form(rows.drop("value")))


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse(s.lines(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at the ticks that events name."""
    return rounded(sources.simulated(s.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))).select("ms", "sensor", *AXES))


def duration_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = within(ingest.elapsed(ingest.accepted(ingest.parse(s.lines(spark, sf_dir)))), 600)
    return rounded(rows.select("session", "seq", "t_s", banner(F.col("t_s"), 600).alias("banner")))


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(win.clip_series(s.signal(spark, sf_dir)).select("series", "i", *AXES))


def window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = win.assign_windows(s.signal(spark, sf_dir).select("series", "i"))
    return cut.groupBy("series", "win_start").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


def _features(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = features.extract(s.windows(spark, sf_dir), kind)
        return rounded(wide.unpivot(["series", "win_start"], [c for c in feature_names() if c[2] == kind], "feature", "value"))

    return query


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 126 features of every window with its material: the flagship query."""
    wide = s.feature_rows(spark, sf_dir)
    return rounded(wide.select("series", "win_start", "label", *feature_names()))


def feature_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance of each of the 126 features, as they are told by feature_matrix; large ones to the hundred."""
    found = prep.variances(rounded(features.extract(s.windows(spark, sf_dir))), feature_names())
    return found.select("feature", F.when(F.col("var") < 1e6, F.round("var", 4)).otherwise(F.round("var", -2)).alias("var"), ((F.col("var") > 0) & ~F.isnan("var")).alias("kept"))


def vector_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = s.vectors(spark, sf_dir)
    return rounded(prep.standardized(rows, columns))


def vector_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = s.vectors(spark, sf_dir)
    return rounded(evaluate.correlations(rows, columns))


def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the 126 window features, as they are told by feature_matrix, and of a constant."""
    rows = rounded(features.extract(s.windows(spark, sf_dir))).withColumn("flat", F.lit(0.1))
    return rounded(evaluate.correlations(materialize(rows, "features"), [*feature_names(), "flat"]))


def scaled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled by the statistics of the rows that an even vec_id makes train rows."""
    rows, columns = s.vectors(spark, sf_dir)
    return rounded(prep.scaled(rows, prep.fit_scaler(rows.filter("vec_id % 2 = 0"), columns)))


def _masks(legacy: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, columns = s.vectors(spark, sf_dir)
        # v1 is constant in train rows, v2 in test rows.
        train = rows.filter("vec_id % 5 <> 0").withColumn("v1", F.lit(1.0))
        test = rows.filter("vec_id % 5 = 0").withColumn("v2", F.lit(1.0))
        kept = prep.masks(train, test, columns, legacy)
        return spark.createDataFrame([(c, c in kept[0], c in kept[1]) for c in columns], "feature string, train boolean, test boolean")

    return query


def log_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.usable(s.logs(spark, sf_dir)).groupBy("file_name").agg(F.count("*").alias("n"))


def log_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.broken(sources.cells(s.logs(spark, sf_dir)))


def log_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.decode(sources.cells(s.logs(spark, sf_dir))).select("file_name", "i", *AXES)


def inverse_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.long_form(ingest.accepted(ingest.parse(s.lines(spark, sf_dir))))
    return rounded(rows.select("session", "seq", "sensor", "axis", raw_counts(F.col("ut")).alias("raw")))


def data_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return received(s.lines(spark, sf_dir).withColumn("session", (F.col("seq") % 40).cast("string")))


def device_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"))
    word = F.when(F.col("seq") % 5 == 0, F.lit("g")).when(F.col("seq") % 7 == 0, F.lit("s ")).otherwise(F.lit("#"))
    return ingest.device_state(e.withColumn("value", word)).select("session", "seq", "streaming")


def log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("began"))
    return rows.select("session", elapsed_name(F.col("began"), "log").alias("name"))


def material_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From signals to a report: windows, 126 features, split by time, mask, scaler, forest with its defaults, report on the test windows."""
    rows = materialize(s.feature_rows(spark, sf_dir), "features")
    last = rows.groupBy("series").agg(F.max("win_start").alias("_last"))
    cut = rows.join(last, "series").withColumn("split", F.when((F.col("win_start") == F.col("_last")) & (F.col("_last") > 0), "test").otherwise("train"))
    path = scratch(spark, "bundle")
    model.fit_bundle(cut.filter("split = 'train'"), feature_names()).save(path)
    bundle = model.Bundle.load(spark, path)  # what a later job would score with
    return evaluate.report(materialize(bundle.predict(cut.filter("split = 'test'")).select("label", "prediction"), "told"))


def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.label_codes(s.labelled(s.signal(spark, sf_dir), spark))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return prep.stratified_split(rows, "label", (F.col("vec_id") * 7919 + 42) % 104729, ["vec_id"])


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.signal(spark, sf_dir).groupBy("series").agg((F.count("*") * 8).alias("n"))


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.planned_windows(_lengths(spark, sf_dir))


def temporal_split_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.planned_windows(_lengths(spark, sf_dir), legacy=True)


def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.signal(spark, sf_dir).groupBy("series").agg(F.count("*").alias("n"))
    return rows.select("series", "n", F.floor(F.col("n") * 0.8).alias("head"), (F.col("n") - F.floor(F.col("n") * 0.8)).alias("tail"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(s.scored(spark, sf_dir), "actual", "predicted")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.report(s.scored(spark, sf_dir), "actual", "predicted"))


def _one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.scored(spark, sf_dir)
    one = lambda c, p: F.struct(F.lit(c).alias("class"), p.alias("score"), (F.col("actual") == c).alias("positive"))
    return rows.select(F.explode(F.array(one("1", F.col("score")), one("0", 1 - F.col("score")))).alias("x")).select("x.*")


def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.roc(_one_vs_rest(spark, sf_dir)), 9)


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.auc(evaluate.roc(_one_vs_rest(spark, sf_dir))))


def probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.probability_histogram(s.scored(spark, sf_dir).select(F.col("actual").alias("class"), F.floor(F.col("score") * 4096).alias("p")))


def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events")
    folds = e.select((F.col("event_id") % 10).alias("size"), F.col("value").alias("train"), (F.col("value") / 2 + F.col("user_id") % 3).alias("validation"))
    return rounded(evaluate.learning_summary(folds))


def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = s.vectors(spark, sf_dir)
    spread = prep.variances(rows, columns).select("feature", F.regexp_extract("feature", r"\d+", 0).cast("int").alias("idx"), F.round("var", 6).alias("importance"))
    return evaluate.top_importances(spread, 20)


def top_features_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = s.vectors(spark, sf_dir)
    spread = prep.variances(rows, columns).select("feature", F.regexp_extract("feature", r"\d+", 0).cast("int").alias("idx"), F.round("var", 6).alias("importance"))
    return evaluate.top_importances(spread, 10, ascending=True)


def pooled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(win.pooled_stats(s.signal(spark, sf_dir), 30))


def three_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = win.pooled(s.signal(spark, sf_dir).select("series", "i", *AXES))
    kept = win.three_sigma(v, ["series", "axis"])
    return rounded(kept.groupBy("series", "axis").agg(F.count("*").alias("n"), F.sum("v").alias("total")))


def axis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(win.axis_range(s.signal(spark, sf_dir), 40))


def recent_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.signal(spark, sf_dir).withColumn("t_s", F.col("t_s") / 86400)
    return rounded(win.recent_view(rows, seconds=10).select("series", "i", "t_s"))


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = win.retained(s.signal(spark, sf_dir), 60)
    return kept.groupBy("series").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.decimated(s.signal(spark, sf_dir).select("series", "i"), limit=60, head=20)


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.markers(s.signal(spark, sf_dir).select("series", "i"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = win.segments(s.signal(spark, sf_dir).select("series", "i"))
    return cut.groupBy("series", "segment").agg(F.count("*").alias("n"), F.min("i").alias("first_i"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of customers: some name a material, one in nine two, one in seven none."""
    codes = F.array(*[F.lit(r) for r in ("fanguangbu", "tianerong", "dengxinrong", "muoshayuyi", "shawang", "luowenbu")])
    k = F.col("c_custkey")
    pick = lambda n: F.get(codes, F.pmod(n, F.lit(6)).cast("int"))
    name = F.when(k % 7 == 0, F.concat(F.lit("log_"), k.cast("string"), F.lit("_none_05.csv"))).when(k % 9 == 0, F.concat(F.lit("x_"), pick(k), F.lit("_"), pick(k + 1), F.lit("_"), k.cast("string"), F.lit(".csv"))).otherwise(F.concat(F.lit("log_sensor0_"), pick(k), F.lit("_"), k.cast("string"), F.lit(".csv")))
    return s.table(spark, sf_dir, "customer").select(name.alias("file_name"))


def file_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.with_materials(_files(spark, sf_dir), materials(spark)).select("file_name", "label", "code", "english")


def missing_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.missing_materials(_files(spark, sf_dir), materials(spark)).select("label", "code", "english")


def english_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 == 0, F.lit("纱网布")).otherwise(F.col("event_type")).alias("label"))
    return evaluate.named(rows, materials(spark)).groupBy("label", "english").agg(F.count("*").alias("n"))


def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.labelled(win.assign_windows(s.signal(spark, sf_dir).select("series", "i")).select("series", "win_start").distinct(), spark)
    return rows.groupBy("label", "english").agg(F.count("*").alias("windows"), F.countDistinct("series").alias("series"))


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of a forest on held-out vectors."""
    rows, columns = s.vectors(spark, sf_dir)
    cut = materialize(prep.stratified_split(rows, "label", F.xxhash64("vec_id", F.lit(42)), ["vec_id"]), "split")
    fitted = model.fit_forest(cut.filter("split = 'train'"), columns)
    return evaluate.report(materialize(model.predict(fitted, cut.filter("split = 'test'")).select("label", "prediction"), "told"))


def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = s.vectors(spark, sf_dir)
    return evaluate.top_importances(model.importances(model.fit_forest(rows, columns), spark), 20)


def forest_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute SHAP values of a forest with its defaults over the 126 features of all windows."""
    rows = s.feature_rows(spark, sf_dir).select("label", *feature_names())
    rows = materialize(rows, "features")
    return model.fitted_shap_summary(rows, feature_names())


def segment_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = s.vectors(spark, sf_dir)
    rows = win.ordinals(rows.withColumn("series", F.lit(0)), "series", "vec_id")
    return model.segment_importances(rows, columns, columns)


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sizes and five folds of forests with their defaults."""
    rows, columns = s.vectors(spark, sf_dir)
    return evaluate.learning_summary(model.learning_curve(rows, columns, "vec_id"))


def queries() -> dict:
    named: list[tuple[str, object]] = [(f.__name__, f) for f in (
        parse_all, parse_rejects, parse_one_sensor, parse_wide, reject_counts, simulated, duration_limit, clipped, window_index,
        feature_matrix, feature_variance, vector_scaling, vector_correlation, label_codes, random_split, temporal_split,
        temporal_split_legacy, prefix_suffix, confusion, report, roc, auc, probability_histogram, learning_summary, top_features,
        top_features_ascending, pooled_stats, three_sigma, axis_range, recent_view, retained, decimated, markers, segments,
        file_materials, missing_materials, english_names, dataset_shape, forest, forest_importance, forest_shap, segment_importance, learning_curve,
        feature_correlation, scaled_split, log_guard, log_quarantine, log_decoded, inverse_scale, data_received, device_state, log_names, material_report,
    )]
    return dict(named) | {"time_features": _features("t"), "spectral_features": _features("f"), "wavelet_features": _features("w"), "split_masks": _masks(False), "split_masks_legacy": _masks(True)}


