"""Constants and schemas of the sensor pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Fixed values of the protocol and the feature definitions.
LSB_TO_UT = 0.161
SAMPLE_RATE = 100.0
WINDOW, STRIDE = 50, 25
SENSORS = 4
AXES = ("X", "Y", "Z")
RETAIN = 2000

#: Material label, file code, English name.
MATERIALS = (
    ("夜光反光布", "fanguangbu", "Luminous Reflective Fabric"),
    ("天鹅绒", "tianerong", "Velvet Fabric"),
    ("杜邦纸", "杜邦纸", "Synthetic Nonwoven"),
    ("水洗皮", "水洗皮", "Washed Faux Leather"),
    ("灯芯绒", "dengxinrong", "Corduroy Fabric"),
    ("磨砂雨衣", "muoshayuyi", "Matte-Finish Raincoat Fabric"),
    ("纱网布", "shawang", "Mesh Fabric"),
    ("针织罗纹布", "luowenbu", "Ribbed Knit Fabric"),
)

#: Decomposition low-pass filter of the Daubechies wavelet with four vanishing moments.
DB4_LOW = (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523)

WIDE_LOG = T.StructType([T.StructField("ms", T.DoubleType())] + [T.StructField(f"S{s}_{a}", T.DoubleType()) for s in range(SENSORS) for a in AXES])
NARROW_LOG = T.StructType([T.StructField(c, T.DoubleType()) for c in ("ms", *AXES)])


def materials(spark: SparkSession) -> DataFrame:
    """The material dimension (label, code, english); eight rows, so it may be broadcast."""
    return spark.createDataFrame(list(MATERIALS), "label string, code string, english string")


def feature_names() -> list[str]:
    """Names of the 126 features of a window, in their order."""
    return [f"{a}_{kind}{i}" for a in AXES for kind, n in (("t", 15), ("f", 12), ("w", 15)) for i in range(n)]
