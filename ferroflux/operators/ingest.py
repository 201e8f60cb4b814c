"""Line protocol: blank and comment filter, tokens, arity, projections, rejects, scaling, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strict_double
from ..schema import AXES, LSB_TO_UT, SENSORS
from .scan import prefix_scan


def check_sensor(sensor: int | None) -> None:
    if sensor is not None and not 0 <= sensor < SENSORS:
        raise ValueError(f"sensor must be 0 to {SENSORS - 1}, not {sensor}")


def _place(shape: int, sensor: int, axis: int) -> int:
    """Token of a sensor's axis: five tokens a sensor in the 20-token shape, four after the clock in the 17-token one."""
    return 5 * sensor + 2 + axis if shape == 20 else 4 * sensor + 2 + axis


def tokens(lines: DataFrame) -> DataFrame:
    """Add ``tok``, the whitespace-separated tokens of ``value``; blank lines and comments go.

    Columns named tok or ms in ``lines`` are replaced.
    """
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return lines.drop("tok").withColumn("tok", F.split(text, " ")).filter((text != "") & ~F.startswith(text, F.lit("#")))


def parse(lines: DataFrame, sensor: int | None = None) -> DataFrame:
    """Add ``tok``, ``ms``, ``raw`` (one struct of X, Y, Z per sensor) and ``reason`` (null if accepted).

    Without ``sensor`` all sensors' values must be numbers; with it, only the
    chosen sensor's and, in the 17-token shape, all tokens. In the 20-token shape
    temperatures and repeated stamps may be anything.
    """
    check_sensor(sensor)
    count = F.size("tok")
    # Other counts than 17 and 20 need no numbers. The generator is one that filters on
    # the outcome don't pass, so each token is read once.
    rows = tokens(lines).withColumn("_n", F.explode(F.array(F.when(count.isin(17, 20), F.transform("tok", strict_double)))))
    sensors = range(SENSORS) if sensor is None else [sensor]

    def place(s: int, a: int) -> Column:
        return F.get("_n", F.when(count == 20, _place(20, s, a)).otherwise(_place(17, s, a)))

    raw = F.array(*[F.struct(F.lit(s).alias("sensor"), *[place(s, a).alias(name) for a, name in enumerate(AXES)]) for s in sensors])
    rows = rows.withColumn("ms", F.get("_n", F.lit(0))).withColumn("raw", raw)
    bad = F.col("ms").isNull() | F.exists("raw", lambda r: r["X"].isNull() | r["Y"].isNull() | r["Z"].isNull())
    every = F.forall("_n", lambda v: v.isNotNull())
    reason = F.when(~count.isin(17, 20), F.lit("count")).when(bad | ((count == 17) & ~every), F.lit("number"))
    return rows.withColumn("reason", reason).drop("_n")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "tok")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).drop("raw", "tok", "ms")


def scaled(column: Column | str, factor: float = LSB_TO_UT) -> Column:
    """Raw counts to microtesla."""
    return (F.col(column) if isinstance(column, str) else column) * F.lit(factor)


def long_form(records: DataFrame) -> DataFrame:
    """A row per sensor and axis: sensor, axis, raw, ut, beside the record's other columns."""
    one = records.withColumn("_s", F.explode("raw")).drop("raw")
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"_s.{a}").alias("raw")) for a in AXES])
    one = one.withColumn("sensor", F.col("_s.sensor")).withColumn("_a", F.explode(axes)).drop("_s")
    return one.withColumn("axis", F.col("_a.axis")).withColumn("raw", F.col("_a.raw")).drop("_a").withColumn("ut", scaled("raw"))


def wide_form(records: DataFrame) -> DataFrame:
    """A column S{s}_{axis} of raw counts per sensor and axis."""
    columns = [F.get(F.expr(f"filter(raw, r -> r.sensor = {s})"), F.lit(0))[a].alias(f"S{s}_{a}") for s in range(SENSORS) for a in AXES]
    return records.select(*[c for c in records.columns if c != "raw"], *columns)


def elapsed(records: DataFrame, session: str = "session") -> DataFrame:
    """Add ``t_s``, seconds since the session's first clock."""
    first = records.groupBy(session).agg(F.min("ms").alias("_first"))  # summed up before the shuffle
    return records.join(first, session).withColumn("t_s", (F.col("ms") - F.col("_first")) / 1000).drop("_first")


def device_state(commands: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """Add ``streaming`` to the lines that a host sends: whether the device streams after the line, which g switches on and s off."""
    word = F.trim("value")
    told = prefix_scan(commands, [session], [seq], _switch=("last", F.when(word.isin("g", "s"), word)))
    return told.withColumn("streaming", F.coalesce(F.col("_switch") == "g", F.lit(False))).drop("_switch")
