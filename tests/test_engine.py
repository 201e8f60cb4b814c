"""Kernels, parsers, windows, sources and streams on small fixtures."""

import math
import subprocess
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from ferroflux import functions as fn
from ferroflux import sources, streaming
from ferroflux.operators import evaluate, features, forest, ingest, model, prep, scan, select
from ferroflux.operators import windows as win
from ferroflux.schema import feature_names, materials
from ferroflux.sources import serial

LINE17 = "1200 25.0 100 -50 20 25.1 10 20 30 24.9 0 0 0 25.0 -100 50 -20"
LINE20 = "1 t 1 2 3 x t 4 5 6 x t 7 8 9 x t 10 11 12"


def lines(spark, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session string, seq long, value string")


def test_parser_worked_line(spark):
    rows = ingest.long_form(ingest.accepted(ingest.parse(lines(spark, [LINE17])))).collect()
    got = {(r.sensor, r.axis): (r.raw, round(r.ut, 4)) for r in rows}
    assert len(got) == 12 and got[0, "X"] == (100.0, 16.1) and got[3, "Z"] == (-20.0, -3.22) and got[1, "Y"] == (20.0, 3.22)


def test_parser_outcomes(spark):
    cases = [
        (LINE17, None, None), (LINE17.replace("25.1", "abc"), "number", "number"), (LINE20, None, None), (LINE20.replace("10", "1_0"), "number", None),
        ("1 2 3", "count", "count"), (LINE17.replace(" ", " \t "), None, None), (LINE17.replace("100", "1.0d"), "number", "number"), (LINE17.replace("100", "NaN", 1), None, None), (LINE17.replace("100", "-inf", 1), None, None),
    ]
    df = lines(spark, [c[0] for c in cases])
    for sensor, at in ((None, 1), (0, 2)):
        got = {r.seq: r.reason for r in ingest.parse(df, sensor).collect()}
        assert [got[i] for i in range(len(cases))] == [c[at] for c in cases]
    assert ingest.parse(lines(spark, ["", "  ", "# x", "#"])).count() == 0
    with pytest.raises(ValueError):
        ingest.parse(df, 4)


def test_wide_form_and_simulated_lines(spark):
    sim = sources.as_lines(sources.simulated(spark.range(3))).withColumn("session", F.lit("s")).withColumn("seq", F.lit(0))
    wide = ingest.wide_form(ingest.accepted(ingest.parse(sim))).orderBy("ms").first()
    assert (wide.S0_X, wide.S0_Y, wide.S1_X, wide.S2_Y, wide.S3_X) == (0.0, 100.0, 100.0, -100.0, -100.0)


@pytest.mark.parametrize("n,starts", [(0, []), (49, []), (50, []), (51, [0]), (75, [0]), (76, [0, 25]), (100, [0, 25]), (101, [0, 25, 50])])
def test_window_starts(spark, n, starts):
    rows = spark.range(n).select(F.lit(1).alias("series"), F.col("id").alias("i"))
    cut = win.assign_windows(rows).groupBy("win_start").count().orderBy("win_start").collect()
    assert [r.win_start for r in cut] == starts and all(r["count"] == 50 for r in cut)
    assert spark.range(1).select(win.window_starts(F.lit(n)).alias("s")).first().s == starts


def one_window(spark, x, kinds):
    df = spark.createDataFrame([(1, 0, [float(v) for v in x])], "series long, win_start long, X array<double>")
    return features.extract(df, kinds, ("X",)).first().asDict()


def test_spectrum_against_fft(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(50) / 50)
    p = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (100 * 18.75)
    p[1:-1] *= 2
    got = one_window(spark, x, "f")
    assert math.isclose(got["X_f0"], p.sum()) and math.isclose(got["X_f1"], p[:5].sum()) and math.isclose(got["X_f3"], p[25])
    assert got["X_f7"] == 2.0 * np.argmax(p) and math.isclose(got["X_f10"], p.std())
    assert one_window(spark, np.sin(2 * np.pi * 10 * np.arange(50) / 100), "f")["X_f7"] == 10.0


def test_constant_window(spark):
    got = one_window(spark, [3.0] * 50, "tfw")
    assert got["X_t7"] == 450 and got["X_t1"] == got["X_t4"] == got["X_t8"] == got["X_t10"] == 0 and math.isnan(got["X_t5"])
    assert [got[f"X_f{i}"] for i in (4, 5, 6)] == [0, 0, 0]
    assert abs(got["X_w0"] - 6.0) < 1e-9 and abs(got["X_w9"]) < 1e-9 and abs(got["X_w14"]) < 1e-9


def test_sign_changes_and_wavelet_shape(spark):
    assert one_window(spark, [(-1) ** i for i in range(50)], "t")["X_t10"] == 49
    a2, d2, d1 = fn.wavelet_rows(50)
    assert (len(a2), len(d2), len(d1)) == (17, 17, 28)
    assert np.allclose((np.array(d1) @ np.arange(50))[4:-4], 0, atol=1e-9)
    assert len(feature_names()) == 126


def test_wavelet_against_direct_convolution():
    from ferroflux.schema import DB4_LOW

    rng = np.random.default_rng(2)
    low = np.array(DB4_LOW)
    high = np.array([(-1) ** (j + 1) * low[7 - j] for j in range(8)])

    def half(x, taps):
        mirrored = np.concatenate((x[::-1], x, x[::-1]))
        return np.convolve(mirrored, taps)[len(x) + 1 : len(x) + len(x) + 7 : 2]

    x = rng.normal(size=50)
    a = half(x, low)
    expected = [half(a, low), half(a, high), half(x, high)]
    for rows, y in zip(fn.wavelet_rows(50), expected):
        assert np.allclose(np.array(rows) @ x, y[: len(rows)])


def test_short_and_long_windows(spark):
    assert [fn.wavelet_level(n) for n in (0, 6, 7, 13, 14, 27, 28, 500)] == [0, 0, 0, 0, 1, 1, 2, 2]
    assert [len(fn.wavelet_rows(n)) for n in (10, 20, 50)] == [0, 2, 3]
    df = spark.createDataFrame([(n, [float(i % 5) for i in range(n)]) for n in (1, 10, 20, 50, 600)] + [(0, []), (-1, None)], "n long, X array<double>")
    got = {r.n: r for r in features.extract(df, "tfw", ("X",)).collect()}
    assert len(got) == 7 and math.isnan(got[0].X_t0) and got[0].X_f0 == got[-1].X_f0 == got[0].X_w0 == 0
    assert got[10].X_w0 == got[10].X_t0 and got[10].X_w5 == 0 and got[20].X_w5 != 0 and got[20].X_w10 == 0 and got[50].X_w10 != 0
    assert got[1].X_f0 == 0 and got[600].X_f0 > 0 and got[600].X_f7 == pytest.approx(20, abs=1)


def test_ordinals_by_chunks(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("s"), ((F.col("id") * 37) % 499).alias("t"), "id")
    plain = win.ordinals(rows, "s", "t", "id").select("id", "i")
    cut = win.ordinals(rows, "s", "t", "id", chunk=F.floor(F.col("t") / 50)).select("id", "i")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_correlation_of_many_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 126))
    x[:, 5] = 1.0
    names = [f"c{i}" for i in range(126)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r.a, r.b): r.r for r in evaluate.correlations(df, names).collect()}
    assert len(got) == 126 * 126 and math.isnan(got["c5", "c0"])
    expected = np.corrcoef(np.delete(x, 5, axis=1).T)
    rest = [c for c in names if c != "c5"]
    assert all(abs(got[a, b] - expected[i, j]) < 1e-9 for i, a in enumerate(rest) for j, b in enumerate(rest))


def test_bundle_scores_new_rows(spark, tmp_path):
    rows = [(i, float(i % 2) + i / 1000, 7.0, float(i % 5), "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, same double, y double, label string")
    bundle = model.fit_bundle(df, ["x", "same", "y"], trees=5, depth=3)
    assert bundle.columns == ["x", "y"]
    bundle.save(str(tmp_path / "b"))
    again = model.Bundle.load(spark, str(tmp_path / "b"))
    one = df.limit(1)  # a row alone is scaled by the training rows
    assert [r.prediction for r in again.predict(one).collect()] == [r.label for r in one.collect()]
    assert again.columns == bundle.columns and sorted(map(tuple, again.codes.collect())) == [("a", 0), ("b", 1)]


def test_idle_views_and_back_off(spark):
    lines = spark.createDataFrame([("a", "# hello"), ("a", " "), ("b", "not valid"), ("b", "#")], "session string, value string")
    assert {r.session: (r.lines, r.received) for r in streaming.received(lines).collect()} == {"a": (0, False), "b": (1, True)}
    assert [streaming.poll_interval(n) for n in (300, 301)] == ["50 milliseconds", "500 milliseconds"]


def test_nan_makes_the_axis_nan(spark):
    rows = [(1, i, float("nan") if i == 3 else float(i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "series long, i long, X double, Y double")
    got = win.clip_series(df, ("X", "Y")).agg(F.sum(F.isnan("X").cast("int")), F.sum(F.isnan("Y").cast("int"))).first()
    assert tuple(got) == (60, 0)


def test_varying_drops_constant_and_nan(spark):
    df = spark.createDataFrame([(1.0, 5.0, float("nan")), (2.0, 5.0, 1.0)], "a double, b double, c double")
    assert prep.varying(df, ["a", "b", "c"]) == ["a"]
    assert [r.b for r in prep.standardized(df, ["a", "b"]).collect()] == [0.0, 0.0]


def test_temporal_split_fixture(spark):
    lengths = spark.createDataFrame([("f", 1000)], "series string, n long")
    for legacy, test in ((False, [800, 825, 850, 875, 900, 925]), (True, [0, 25, 50, 75, 100, 125])):
        got = prep.planned_windows(lengths, legacy=legacy).collect()
        assert sorted(r.win_start for r in got if r.split == "test") == test
        assert sorted(r.win_start for r in got if r.split == "train") == list(range(0, 750, 25))


def test_evaluation_invariants(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    pairs = evaluate.confusion(df)
    assert pairs.count() == 9 and pairs.agg(F.sum("n")).first()[0] == 4
    rows = {r["class"]: r for r in evaluate.report(df).collect()}
    assert rows["accuracy"].f1 == 0.5 and rows["c"].precision == 0 and rows["a"].recall == 0.5
    scores = spark.createDataFrame([("k", 0.9, True), ("k", 0.8, False), ("k", 0.8, True), ("k", 0.1, False)], "class string, score double, positive boolean")
    assert abs(evaluate.auc(evaluate.roc(scores)).first().auc - 0.875) < 1e-12
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    r = {(x.a, x.b): x.r for x in evaluate.correlations(flat, ["a", "b"]).collect()}
    assert math.isnan(r["a", "b"]) and abs(r["b", "b"] - 1) < 1e-12


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x_shawang_tianerong_1.csv").write_text("Z,Y,X,ms,extra\n3,2,1,0,q\n6,,4,1,q\n")
    (tmp_path / "a" / "b" / "log_sensor0_2_fanguangbu_05.csv").write_text("ms,X,Y,Z\r\n0,1,2,3\r\n")
    (tmp_path / "wide_shawang_1.csv").write_text("ms,S0_X\n0,1\n")
    (tmp_path / "bad_luowenbu_1.csv").write_text("ms,X,Y,Z\n0,1,zz,3\n")
    logs = sources.scan_logs(spark, str(tmp_path))
    held = sources.cells(logs)
    rows = sources.decode(held)
    got = sorted((r.file_name, r.i, r.X, str(r.Y), r.Z) for r in rows.collect())
    assert got == [("log_sensor0_2_fanguangbu_05.csv", 0, 1.0, "2.0", 3.0), ("x_shawang_tianerong_1.csv", 0, 1.0, "2.0", 3.0), ("x_shawang_tianerong_1.csv", 1, 4.0, "nan", 6.0)]
    assert [(r.file.endswith('bad_luowenbu_1.csv'), r.cells) for r in sources.broken(held).collect()] == [(True, 1)]
    files = rows.select("file_name").distinct()
    assert sorted(r.code for r in sources.with_materials(files, materials(spark)).collect()) == ["fanguangbu", "shawang", "tianerong"]
    assert sources.missing_materials(files, materials(spark)).count() == 5
    with pytest.raises(ValueError):
        sources.require_rows(rows.filter("i > 9"))


def test_large_csv_is_read_in_splits(spark, tmp_path):
    """Ordinals and header of a file that many tasks read, with blank lines and CRLF."""
    folder = tmp_path / "in"
    folder.mkdir()
    text = [f"{k},{k * 2},{k % 7}" + ("\r\n\r\n" if k % 5 == 0 else "\r\n") for k in range(4000)]
    (folder / "x_shawang_1.csv").write_bytes(("Y,X,Z\r\n" + "".join(text)).encode())
    (folder / "empty.csv").write_bytes(b"")
    (folder / "head.csv").write_bytes(b"X,Y,Z")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
    got = sources.decode(sources.cells(sources.scan_logs(spark, str(folder)))).orderBy("i").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.i, r.X, r.Y, r.Z) for r in got] == [(k, 2.0 * k, float(k), float(k % 7)) for k in range(4000)]


def test_bundled_logs_read_as_files(spark, tmp_path):
    """Many short logs make few files; headers, blank lines, tabs and a log over several bundles are read as from files of their own."""
    logs = {f"log_{k}.csv": ["X,Y,Z", "", *(f"{k},{n},\t{n}" for n in range(k % 4))] for k in range(300)} | {"long.csv": ["Z,Y,X", *(f"{n},2,3" for n in range(3000))], "head.csv": ["X,Y,Z"]}
    rows = [(name, k, line) for name, lines in logs.items() for k, line in enumerate(lines)] + [(None, 0, "no log's")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sources.write_bundles(spark.createDataFrame(rows, "file string, at long, line string"), str(tmp_path / "bundles"), ["at"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 2 < len(list((tmp_path / "bundles").glob("part-*"))) < 20
    (tmp_path / "files").mkdir()
    for name, lines in logs.items():
        (tmp_path / "files" / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    got, want = ([sorted((r.file_name, r.i, r.header, r.line) for r in found.collect()) for found in (sources.scan_logs(spark, str(tmp_path / "bundles"), "*", bundled=True), sources.scan_logs(spark, str(tmp_path / "files")))])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(got) == 3450


def test_log_queries_write_few_files(spark, monkeypatch):
    """The logs of all users take no file each."""
    from ferroflux.plans import signals
    from ferroflux.store import scratch

    made = []
    monkeypatch.setattr(signals, "scratch", lambda *a: made.append(scratch(*a)) or made[-1])
    names = signals.logs(spark, "/root/testdata/sf0.01").select("file_name").distinct().count()
    assert names == 150 and spark.read.text(made[0]).select("_metadata.file_path").distinct().count() < 20


def test_cached_dataset_follows_its_files(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    (source / "a.csv").write_text("1\n")
    built = []

    def build():
        built.append(1)
        return spark.read.text(str(source))

    get = lambda **settings: sorted(r.value for r in sources.cached_dataset(spark, folder, str(source), settings, build).collect())
    assert get(size=50) == ["1"] and get(size=50) == ["1"] and len(built) == 1
    assert get(size=25) == ["1"] and len(built) == 2
    (source / "a.csv").write_text("1\n2\n")
    assert get(size=50) == ["1", "2"] and len(built) == 3
    (source / "b.csv").write_text("3\n")
    assert get(size=50) == ["1", "2", "3"] and get(size=50) == ["1", "2", "3"] and len(built) == 4


def test_two_writers_of_a_cached_dataset(spark, tmp_path):
    """Both build before either is done; one dataset is left, and both read it."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    source, folder = tmp_path / "in", tmp_path / "cache"
    source.mkdir()
    (source / "a.csv").write_text("1\n")
    both = Barrier(2)

    def build():
        both.wait(60)
        return spark.read.text(str(source))

    with ThreadPoolExecutor(2) as pool:
        found = [f.result() for f in [pool.submit(sources.cached_dataset, spark, str(folder), str(source), {}, build) for _ in range(2)]]
    assert [[r.value for r in d.collect()] for d in found] == [["1"], ["1"]]
    assert len([p for p in folder.iterdir() if p.is_dir()]) == 1


def test_log_sink(spark, tmp_path):
    sources.write_log(spark.range(2), str(tmp_path / "log"), material="x", run="05")
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).columns == ["id", "material", "run"]


class Device:
    def __init__(self, lines):
        self.lines, self.sent, self.closed = list(lines), b"", False

    @property
    def in_waiting(self):
        return len(self.lines)

    def readline(self):
        return self.lines.pop(0) if self.lines else b""

    def write(self, data):
        self.sent += data

    def close(self):
        self.closed = True


def test_serial_helpers():
    assert serial.find_port(["/dev/ttyS0", "/dev/ttyUSB1"]) == "/dev/ttyUSB1"
    with pytest.raises(SystemExit):
        serial.find_port(["/dev/ttyS0"])
    d = Device([b"boot\n", b"# ready\n", b"1 2\n", b"\n", b"3\n"])
    assert serial.handshake(d) and d.sent == b"g"
    assert serial.drain(d) == ["1 2", "3"]
    serial.stop(d)
    assert d.sent == b"gs" and d.closed
    reader = serial.SerialReader({})
    reader.device = Device([b"a\n", b"b\n"])
    got, end = reader.read(reader.initialOffset())
    assert list(got) == [(0, "a"), (1, "b")] and list(reader.readBetweenOffsets({"line": 1}, end)) == [(1, "b")]
    reader.commit(end)
    assert not reader.kept


def test_stream_replay_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("\n".join([LINE17.replace("1200", str(100 * k)), "# c", "", "1 2"]) + "\n")
    batch = ingest.long_form(ingest.accepted(ingest.parse(sources.replay(spark, str(folder)))))
    live = streaming.live_records(sources.replay(spark, str(folder), stream=True))
    q = live.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["ms", "sensor", "axis", "raw", "ut"]
    assert sorted(map(tuple, spark.table("live").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def stream_of(spark, tmp_path, frames, schema):
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def collect_stream(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stateful_streams(spark, tmp_path, rocksdb):
    schema = "session string, seq long, v double"
    rows = [("s", i, float(i)) for i in range(120)]
    src = stream_of(spark, tmp_path, [rows[60:], rows[:60]], schema)
    kept = collect_stream(spark, streaming.retain(src, cap=50), "kept", "update", tmp_path)
    assert (kept[-1].n, kept[-1].first_seq, kept[-1].last_seq, kept[-1].total) == (50, 70, 119, sum(range(70, 120)))
    cut = collect_stream(spark, streaming.stream_windows(src), "cut", "append", tmp_path)
    batch = win.assign_windows(spark.range(120).select(F.lit(1).alias("series"), F.col("id").alias("i"))).groupBy("win_start").agg(F.sum("i").alias("s"))
    assert {r.win_start: sum(r.vs) for r in cut} == {r.win_start: float(r.s) for r in batch.collect()}


def test_live_range_from_lines_equals_batch(spark, tmp_path, rocksdb):
    """Each tick's range is that of the batch operator over all lines so far, folded."""
    folder = tmp_path / "ticks"
    folder.mkdir()
    rng, made, ticks = np.random.default_rng(3), [], (3, 4, 60, 90, 5)
    for k, n in enumerate(ticks):
        some = [(len(made) + j, " ".join(["5"] + [str(int(x)) for x in rng.normal(0, 900 if k == 3 else 60 * (k + 1), 16)])) for j in range(n)]
        some[0] = (some[0][0], "# note" if k % 2 else some[0][1])
        made += some
        spark.createDataFrame([("s", i, v) for i, v in some], "session string, seq long, value string").coalesce(1).write.parquet(str(folder / str(k)))
        time.sleep(0.01)
    src = spark.readStream.schema("session string, seq long, value string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen = []
    q = streaming.live_range(src, last=80).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda d, _: seen.extend(d.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert len(seen) == len(ticks)
    current, upto = (-150.0, 150.0), 0
    for r, n in zip(sorted(seen, key=lambda r: r.records), ticks):
        upto += n
        good = ingest.long_form(ingest.accepted(ingest.parse(lines(spark, [v for _, v in made[:upto]]))))
        rows = good.groupBy(F.col("sensor").alias("series"), F.col("seq")).pivot("axis", ["X", "Y", "Z"]).agg(F.first("ut"))
        wished = win.axis_range(win.ordinals(rows, "series", "seq"), 80).orderBy("series").collect()
        current = streaming.fold_range(current, [(w.ymin, w.ymax, w.dmax - w.dmin, w.pad) for w in wished])
        assert (r.ymin, r.ymax) == pytest.approx(current)
        assert r.last_seq == upto - 1


def test_back_off_takes_effect(spark, tmp_path):
    """Over 300 points the poll goes from 50 to 500 ms; the query goes on from its checkpoint without a lost or repeated row."""
    schema = "seq long"
    for k in range(4):
        spark.range(k * 100, k * 100 + 100).select(F.col("id").alias("seq")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def each(rows, _):
        seen.extend(r.seq for r in rows.collect())
        return len(seen)

    live = streaming.LiveQuery(source, each, str(tmp_path / "c"), "append")
    live.run(12)
    spark.range(400, 450).select(F.col("id").alias("seq")).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    live = streaming.LiveQuery(source, each, str(tmp_path / "c"), "append")
    live.run(6)
    assert sorted(seen) == list(range(450))
    assert live.intervals[-1] == "500 milliseconds" and not live.query.isActive


def test_range_hysteresis():
    wish = lambda low, high: (low, high, high - low, 20.0)
    assert streaming.fold_range((-150.0, 150.0), [wish(-100, 100)]) == (-150.0, 150.0)
    assert streaming.fold_range((-150.0, 150.0), [(-20.0, 20.0, 1.0, 20.0)]) == (-20.0, 20.0)
    assert streaming.fold_range((-20.0, 20.0), [wish(-30, 10), wish(-10, 40)]) == (-10, 40)


def labelled_points(spark, n=200):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), 1.0, "p" if a + 0.1 * b > 0 else "q") for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "id long, a double, b double, same double, label string"), ["a", "b", "same"]


def test_forest_shap_and_persistence(spark, tmp_path):
    df, columns = labelled_points(spark)
    fitted = model.fit_forest(df, columns, trees=20, depth=5)
    told = model.predict(fitted, df)
    assert told.filter("prediction = label").count() > 185
    shown = df.filter("id < 20")
    values = model.shap_values(fitted, shown, "id").collect()
    assert len(values) == 20 * 2 * 3 and not any(r.shap for r in values if r.feature == "same")
    base = forest.expected(fitted, forest.path_tables(fitted))
    added = {}
    for r in values:
        added[r.id, r["class"]] = added.get((r.id, r["class"]), 0.0) + r.shap
    probability = {(r.id, c): p for r in told.filter("id < 20").collect() for c, p in zip(fitted.labels, r.probability)}
    assert added.keys() == probability.keys()
    assert all(abs(base[fitted.labels.index(c)] + added[i, c] - p) < 1e-9 for (i, c), p in probability.items())
    fitted.save(spark, str(tmp_path / "m"))
    again = model.predict(forest.Forest.load(spark, str(tmp_path / "m")), df)
    key = lambda d: sorted((r.id, r.prediction, tuple(r.probability)) for r in d.collect())
    assert key(again) == key(told)


def test_forest_nodes_and_partitions(spark):
    """No node under ``split`` rows is split, no side has under ``leaf``; children hold what their parent holds; partitions change nothing."""
    df, columns = labelled_points(spark, 300)
    df = df.withColumn("label", F.when(F.col("id") % 7 == 0, "q").otherwise(F.col("label")))
    one = model.fit_forest(df.repartition(1), columns, trees=15, depth=8, split=9, leaf=3)
    inner = one.feature >= 0
    assert inner.sum() > 50 and one.rows[inner].min() >= 9 and one.rows[one.left[inner]].min() >= 3 and one.rows[one.right[inner]].min() >= 3
    assert (one.rows[one.left[inner]] + one.rows[one.right[inner]] == one.rows[inner]).all()
    assert np.allclose(one.counts[one.left[inner]] + one.counts[one.right[inner]], one.counts[inner])
    other = model.fit_forest(df.repartition(6), columns, trees=15, depth=8, split=9, leaf=3)
    for a in ("root", "feature", "cut", "left", "right", "counts", "rows"):
        assert (getattr(one, a) == getattr(other, a)).all()


def test_forest_without_rows_labels_or_splits(spark):
    df, columns = labelled_points(spark, 40)
    lone = model.fit_forest(df.withColumn("label", F.lit("k")), columns, trees=3)
    assert (lone.feature < 0).all() and {r.prediction for r in model.predict(lone, df).collect()} == {"k"}
    some = df.withColumn("label", F.when(F.col("id") < 20, F.col("label"))).withColumn("a", F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("a")))
    fitted = model.fit_forest(some, columns, trees=3)
    assert fitted.labels == ["p", "q"] and fitted.rows[fitted.root].max() <= 20
    assert model.predict(fitted, df.limit(0)).collect() == []


def test_best_splits_against_brute_force():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 4, (5, 2, 6))
    w = np.where(n[..., None] > 0, rng.integers(0, 5, (5, 2, 6, 3)), 0).astype(float)
    n[:, 1], w[:, 1] = n[:, 0][:, ::-1], w[:, 0][:, ::-1]  # both features hold the same rows
    got = forest.best_splits(w, n, np.tile([4, 9], (5, 1)), 0, 2)
    gini = lambda x: x.sum() - (x**2).sum() / max(x.sum(), 1e-300)
    for k, r in enumerate(got.itertuples()):
        every = {(f, c): gini(w[k, s].sum(0)) - gini(w[k, s, : c + 1].sum(0)) - gini(w[k, s, c + 1 :].sum(0)) for s, f in enumerate((4, 9)) for c in range(6) if n[k, s, : c + 1].sum() >= 2 and n[k, s, c + 1 :].sum() >= 2}
        best = max(every.values(), default=0.0)
        assert abs(r.gain - max(best, 0.0)) < 1e-9 and (best <= 0 or abs(every[r.feature, r.cut] - best) < 1e-9)


def test_shap_is_shapley():
    """Against the definition over all sets of features, on trees that use a feature several times on a path."""
    import itertools

    rng = np.random.default_rng(1)
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "counts")}

    def build(depth, counts):
        k = len(nodes["feature"])
        for name, v in zip(nodes, (-1, 0, -1, -1, counts)):
            nodes[name].append(v)
        left = np.floor(counts * rng.random(3))
        if depth and left.sum() and (counts - left).sum():
            nodes["feature"][k], nodes["cut"][k] = int(rng.integers(4)), int(rng.integers(8))
            nodes["left"][k] = build(depth - 1, left)
            nodes["right"][k] = build(depth - 1, counts - left)
        return k

    roots = np.array([build(6, rng.integers(9, 60, 3).astype(float)) for _ in range(3)] + [build(0, np.ones(3))])
    one = forest.Forest(list("abc"), list("wxyz"), [np.arange(8)] * 4, 4, roots, *[np.array(nodes[k]) for k in nodes], np.zeros(len(nodes["cut"])))
    shares, weight, x = one.shares(), one.counts.sum(1), rng.integers(0, 9, (6, 4)).astype(np.uint8)
    paths = forest.path_tables(one)
    got = forest.shap(paths, x, 4, cells=30)

    def told(k, row, known):
        f, a, b = one.feature[k], one.left[k], one.right[k]
        if f < 0:
            return shares[k]
        if f in known:
            return told(a if row[f] <= one.cut[k] else b, row, known)
        return (told(a, row, known) * weight[a] + told(b, row, known) * weight[b]) / weight[k]

    for i, j in itertools.product(range(6), range(4)):
        rest = [g for g in range(4) if g != j]
        want = sum(math.factorial(n) * math.factorial(3 - n) / 24 * (told(r, x[i], {*s, j}) - told(r, x[i], {*s})) / 4 for n in range(4) for s in itertools.combinations(rest, n) for r in roots)
        assert np.allclose(got[i, j], want)
    assert np.allclose(forest.expected(one, paths) + got.sum(axis=1), one.probabilities(x))


def test_fits_side_by_side_equal_single_ones(spark):
    df, columns = labelled_points(spark, 120)
    curve = {(r.size, r.fold): (r.train, r.validation) for r in model.learning_curve(df, columns, "id", sizes=2, folds=3, trees=4, depth=4).collect()}
    assert set(curve) == {(s, f) for s in (0.5, 1.0) for f in range(3)}
    assert all(t > 0.8 and 0.5 < v <= 1 for t, v in curve.values())
    rows = df.withColumn("series", F.lit(1)).withColumn("i", F.col("id"))
    told = model.segment_importances(rows, columns, ["a"], count=3, trees=5).collect()
    assert sorted(r.segment for r in told) == [0, 1, 2] and all(r.importance > 0.5 for r in told)


def test_large_nodes_grow_as_small_ones(spark, monkeypatch):
    """Forests don't depend on where histograms end and subtrees begin, nor on how often a task hands on its counts."""
    df, columns = labelled_points(spark, 400)
    df = df.withColumn("series", F.lit(1)).withColumn("i", F.col("id")).withColumn("label", F.when(F.col("id") % 7 == 0, "q").otherwise(F.col("label")))
    told = []
    for local, counts in ((1 << 15, 1 << 20), (60, 1 << 20), (60, 64), (0, 64)):
        monkeypatch.setattr(forest, "LOCAL", local)
        monkeypatch.setattr(forest, "COUNTS", counts)
        one = model.fit_forest(df.repartition(3), columns, trees=8, depth=6)
        segments = {(r.segment, r.feature): r.importance for r in model.segment_importances(df, columns, columns, count=2, trees=4).collect()}
        probability = one.probabilities(one.binned(np.array([r[1:4] for r in df.orderBy("id").collect()])))
        told.append((len(one.feature), one.rows.sum(), one.counts.sum(), probability, one.importances(), segments))
    assert told[0][0] > 60
    for other in told[1:]:
        assert other[:3] == told[0][:3] and (other[3] == told[0][3]).all() and np.allclose(other[4], told[0][4])
        assert other[5].keys() == told[0][5].keys() and all(abs(v - told[0][5][k]) < 1e-9 for k, v in other[5].items())


def test_learning_curve_sends_bounded_runs_of_fits(spark, monkeypatch):
    df, columns = labelled_points(spark, 120)
    curve = lambda: sorted(map(tuple, model.learning_curve(df, columns, "id", sizes=2, folds=3, trees=4, depth=4).collect()))
    whole, sizes, build = curve(), [], forest.Grown.forest
    monkeypatch.setattr(model, "NODES", 1)
    monkeypatch.setattr(forest.Grown, "forest", lambda self, *fits: sizes.append(fits) or build(self, *fits))
    assert curve() == whole and sizes == [(k, k + 1) for k in range(6)]


def test_small_tables_are_held_whole_and_no_row_moves_per_tree(spark, monkeypatch):
    df, columns = labelled_points(spark, 300)
    curve = lambda: sorted(map(tuple, model.learning_curve(df, columns, "id", sizes=2, folds=3, trees=4, depth=4).collect()))

    def all_of() -> tuple:
        one = model.fit_forest(df.repartition(3), columns, trees=8, depth=6)
        shape = sorted((int(c), int(f), tuple(map(float, k))) for c, f, k in zip(one.cut, one.feature, one.counts))
        return curve(), shape, [sorted(map(tuple, model.segment_importances(df.selectExpr("*", "1 AS series", "id AS i"), columns, columns, count=2, trees=3).collect()))]

    with monkeypatch.context() as m:
        m.setattr(forest, "HELD", 0)
        m.setattr(forest, "LOCAL", 100)
        m.setattr(model, "LOCAL", 100)
        moved = all_of()
    monkeypatch.setattr(forest, "LOCAL", 100)
    monkeypatch.setattr(model, "LOCAL", 100)
    for name in ("_level", "_small"):
        monkeypatch.setattr(forest, name, None)
    held = all_of()
    assert held[:2] == moved[:2] and np.allclose([r[2] for r in held[2][0]], [r[2] for r in moved[2][0]])


def test_subtrees_do_not_depend_on_steps(monkeypatch):
    rng = np.random.default_rng(3)
    x, code, weight, at = rng.integers(0, 20, (500, 9), np.uint8), rng.integers(0, 3, 500).astype(np.int32), rng.integers(1, 4, 500).astype(np.uint8), rng.integers(0, 2, 500).astype(np.int32)
    grow = lambda **more: forest.subtrees(x, code, weight, at, np.arange(2, dtype=np.uint64), np.array([7, 6]), (3, 3, 20), 2, 5, 1, **more)
    one = grow()
    monkeypatch.setattr(forest, "STEP", 32)
    assert all((a == b).all() for a, b in zip(one, grow())) and one[1].max() > 0
    assert all((a == b).all() for a, b in zip(one, grow(row=np.arange(500))))
    out = np.zeros((500, 3))
    forest.add_shares(out, x, np.arange(500), one, 2, 7)
    feature, cut, left, counts = one[:4]
    for k, row in enumerate(x):
        told = 0
        for node in (0, 1):
            while feature[node] >= 0:
                node = left[node] + (row[feature[node]] > cut[node])
            told = told + counts[node] / counts[node].sum()
        assert (out[k] == told).all()


def test_shap_by_sets_of_met_features(monkeypatch):
    """With many rows each set of met features is answered once; rows alone are explained one by one."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 16, (600, 7), np.uint8)
    grown = forest.subtrees(x, (x[:, 0] // 4 + x[:, 1] // 9).astype(np.int32), np.ones(600, np.uint8), np.zeros(600, np.int32), np.arange(1, dtype=np.uint64), np.array([8]), (5, 2, 16), 2, 5, 1)
    feature, cut, left, counts, rows, _ = grown
    one = forest.Forest(list("abcde"), list("stuvwxy"), [np.arange(15)] * 7, 1, np.zeros(1, int), feature, cut, left, np.where(left >= 0, left + 1, -1), counts, rows)
    paths, made, answers = forest.path_tables(one), [], forest._answers
    monkeypatch.setattr(forest, "_answers", lambda zero, points: made.append(len(zero)) or answers(zero, points))
    whole = forest.shap(paths, x, 7)
    assert sum(made) == len(paths.start) > 20
    assert np.allclose(whole[:40], np.concatenate([forest.shap(paths, x[k : k + 1], 7) for k in range(40)]), rtol=1e-12, atol=1e-14) and sum(made) == len(paths.start)


def test_workers_need_no_installed_copy(tmp_path):
    """What tasks call is pickled by value, with all that it calls."""
    for k, f in enumerate((forest.shap, forest.Held, forest.add_shares, model._runs)):
        (tmp_path / f"{k}").write_bytes(cloudpickle.dumps(f))
        subprocess.run([sys.executable, "-I", "-c", f"import pickle; pickle.load(open('{k}', 'rb'))"], cwd=tmp_path, check=True)


def test_shap_summary_counts_equal_rows(spark, monkeypatch):
    df, columns = labelled_points(spark, 60)
    many = df.unionByName(df).unionByName(df.filter("id < 20"))
    fitted = model.fit_forest(many, columns, trees=6, depth=4)
    expected = {(r["class"], r.feature): r.mean_abs for r in model.shap_summary(model.shap_values(fitted, many, "id")).collect()}
    monkeypatch.setattr(model, "shap_values", None)
    got = {(r["class"], r.feature): r.mean_abs for r in model.fitted_shap_summary(many, columns, trees=6, depth=4).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-12 for k, v in expected.items())
    runs = list(model._runs(iter([pd.DataFrame({"bins": [b"ab"] * 5, "n": [1, 2, 3, 4, 5]}), pd.DataFrame({"bins": [b"cd"], "n": [6]})]), 4))
    assert [len(x) for x, _ in runs] == [4, 2]
    assert np.concatenate([n for _, n in runs]).tolist() == [1, 2, 3, 4, 5, 6]


def test_shap_of_many_leaves_takes_seconds():
    """30 trees of 1024 leaves each and 256 rows: a run of products per point and leaf took 16 points for each of 10 entries."""
    rng = np.random.default_rng(5)
    trees, depth = 30, 10
    size = (1 << (depth + 1)) - 1
    k = np.arange(size)
    inner = k < (1 << depth) - 1
    feature = np.concatenate([np.where(inner, rng.integers(0, 40, size), -1) for _ in range(trees)])
    left = np.concatenate([np.where(inner, 2 * k + 1 + t * size, -1) for t in range(trees)])
    counts = np.zeros((trees, size, 3))
    counts[:, ~inner] = rng.integers(1, 9, (trees, int((~inner).sum()), 3))
    for i in range((1 << depth) - 2, -1, -1):
        counts[:, i] = counts[:, 2 * i + 1] + counts[:, 2 * i + 2]
    counts = counts.reshape(-1, 3)
    one = forest.Forest(list("abc"), [f"v{i}" for i in range(40)], [np.arange(63)] * 40, trees, np.arange(trees) * size, feature, rng.integers(0, 63, trees * size), left, np.where(left >= 0, left + 1, -1), counts, counts.sum(1))
    x = rng.integers(0, 64, (256, 40)).astype(np.uint8)
    began = time.process_time()
    paths = forest.path_tables(one)
    got = forest.shap(paths, x, 40)
    assert time.process_time() - began < 8
    assert np.allclose(forest.expected(one, paths) + got.sum(axis=1), one.probabilities(x))


def test_running_aggregates(spark):
    rng = np.random.default_rng(2)
    keys = [None if i % 50 == 0 else "a" if rng.random() < 0.6 else "bcdefgh"[rng.integers(7)] for i in range(3000)]
    rows = [(k, int(rng.integers(500)), i, None if rng.random() < 0.2 else int(rng.integers(-99, 99))) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, o long, id long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a key spans ranges
    got = scan.prefix_scan(df, ["k"], ["o", "id"], c=("count", F.lit(1), "before"), s=("sum", F.col("v")), m=("max", F.col("v"), "before"), x=("xor", F.col("v")), f=("first", F.col("v")), l=("last", F.col("v"), "before"))
    w = Window.partitionBy("k").orderBy("o", "id")
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.count(F.lit(1)).over(past), F.sum("v").over(upto), F.max("v").over(past), F.bit_xor("v").over(upto), F.first("v", True).over(upto), F.last("v", True).over(past))
    assert sorted(tuple(r) for r in got.select("id", *"csmxfl").collect()) == sorted(tuple(r) for r in want.collect())
    assert sorted(r.i for r in scan.numbered(df, [], ["o", "id"]).collect()) == list(range(3000))
    assert scan.numbered(df.limit(0), ["k"], ["o"]).collect() == []
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_selection_by_rank(spark):
    """Brackets are narrowed to 20 values, over ties, constants, nulls and a null key."""
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.normal(size=2000)] + [("b", float(x)) for x in rng.integers(0, 3, 1500)] + [(None, float(x)) for x in np.concatenate([np.full(900, 5.0), rng.random(900) * 10])]
    rows += [("c", 7.0), ("d", None), ("e", float("inf")), ("e", 1e300), ("e", -0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in select.exact_quantiles(df, ["k"], shares, most=20).collect()}
    for k in ("a", "b", None, "c"):
        assert np.allclose(got[k], np.quantile([v for key, v in rows if key == k], shares), atol=0, rtol=1e-15)
    assert set(got) == {"a", "b", None, "c", "e"} and got["e"][0] == 0 and got["e"][-1] == math.inf
    big = spark.range(1 << 62, (1 << 62) + 3000).withColumnRenamed("id", "v")  # doubles can't tell these apart
    assert [r.v - (1 << 62) for r in select.order_statistics(big, [], lambda n: F.array(n - 1, F.lit(7).cast("long"), n), most=20).orderBy("v").collect()] == [7, 2999]
    chosen = select.smallest(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "v", ["id"], lambda n: F.round(n * 0.2)).filter("chosen")
    assert {(r.k, r.n, r.top) for r in chosen.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).collect()} == {
        (k, round(len(x) * 0.2), x[round(len(x) * 0.2) - 1]) for k in ("a", "b", None, "e") for x in [sorted(v for key, v in rows if key == k)]
    }


def test_scaling_runs_one_job(spark):
    columns = [f"c{i}" for i in range(40)]
    df = spark.range(60).select(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(columns)])
    scaler = prep.fit_scaler(df, columns)
    spark.sparkContext.setJobGroup("scaled", "scaled")
    prep.scaled(df, scaler)
    found = spark.sparkContext.statusTracker().getJobIdsForGroup("scaled")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(found) <= 2  # one query, whose exchange adaptive execution runs as a job of its own


def test_correlation_of_constants(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("c"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"), F.lit(None).cast("double").alias("n"))
    got = {(r.a, r.b): r.r for r in evaluate.correlations(df, ["c", "x", "y", "n"]).collect()}
    assert len(got) == 16 and all(math.isnan(v) for k, v in got.items() if {"c", "n"} & {*k})
    assert got["x", "x"] == 1 and got["x", "y"] == -1
    near = spark.range(100).select((F.lit(1e9) + F.col("id") * 1e-6).alias("a"))
    near = near.withColumn("b", F.col("a"))
    assert all(-1 <= r.r <= 1 for r in evaluate.correlations(near, ["a", "b"]).collect())


def test_curves_over_ranges_of_scores(spark):
    """Running sums of classes that span many ranges, against sorting."""
    rng = np.random.default_rng(5)
    rows = [(c, float(s), bool(rng.random() < s)) for c in "uv" for s in np.round(rng.random(800), 2)] + [("w", 0.5, False)]
    df = spark.createDataFrame(rows, "class string, score double, positive boolean").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    curve = evaluate.roc(df)
    points, area = curve.collect(), {r["class"]: r.auc for r in evaluate.auc(curve).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for c in "uv":
        own = [(s, p) for k, s, p in rows if k == c]
        for r in (r for r in points if r["class"] == c):
            assert (r.tp, r.fp) == (sum(p for s, p in own if s >= r.threshold), sum(not p for s, p in own if s >= r.threshold))
        wins = sum((a > b) + (a == b) / 2 for a, p in own if p for b, q in own if not q)
        assert abs(area[c] - wins / (sum(p for _, p in own) * sum(not p for _, p in own))) < 1e-9
    assert area["w"] == 0


def test_ranks_of_one_bracket_share_its_values(spark, monkeypatch):
    """Four ranks of a group read each of its values once, not four times."""
    met, plain = [], select._meet
    monkeypatch.setattr(select, "_meet", lambda *a: met.append(plain(*a)) or met[-1])
    df = spark.createDataFrame([(k % 3 or None, float(k // 6)) for k in range(600)], "k long, v double")
    got = {r.k: r.q for r in select.exact_quantiles(df, ["k"], [0.01, 0.99]).collect()}
    assert met[-1].count() == 600
    for k in (None, 1, 2):
        assert np.allclose(got[k], np.quantile([float(j // 6) for j in range(600) if (j % 3 or None) == k], [0.01, 0.99]))
