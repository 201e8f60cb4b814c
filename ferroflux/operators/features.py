"""The 126 features of a window: time domain, spectrum and wavelet, per axis.

Windows are bounded arrays, so a batch of them is a matrix, and each group of
features is a few matrix operations over it in the task that built the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wavelet_rows, wavelet_level, welch
from ..schema import AXES, SAMPLE_RATE

COUNTS = {"t": 15, "f": 12, "w": 15}
#: Samples of a segment of the spectrum, at most; longer windows average over halfway overlapping segments.
SEGMENT = 256


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


def time_values(x: np.ndarray) -> np.ndarray:
    """The 15 time features of each row: skew and kurtosis of a constant window are NaN; a sign change counts -0.0 as 0."""
    mean = x.mean(axis=1)
    d, step = x - mean[:, None], np.diff(x, axis=1)
    v, low, high = (d * d).mean(axis=1), x.min(axis=1), x.max(axis=1)
    varies = (v > 0) & (low < high)
    shaped = lambda power, over: np.divide((d**power).mean(axis=1), over, out=np.full(len(x), np.nan), where=varies)
    ordered = np.sort(x, axis=1)

    def quantile(q: float) -> np.ndarray:
        at = (x.shape[1] - 1) * q
        a, b = ordered[:, int(at)], ordered[:, min(int(at) + 1, x.shape[1] - 1)]
        return a + (b - a) * (at - int(at))

    flips = ((x[:, 1:] < 0) != (x[:, :-1] < 0)).sum(axis=1).astype(float)
    return np.stack((mean, np.sqrt(v), low, high, high - low, shaped(3, v * np.sqrt(v)), shaped(4, v * v) - 3, (x * x).sum(axis=1), np.abs(step).sum(axis=1), (step * step).sum(axis=1), flips, quantile(0.25), quantile(0.75), quantile(0.5), np.abs(x).mean(axis=1)), axis=1)


def spectral_values(x: np.ndarray, rate: float = SAMPLE_RATE) -> np.ndarray:
    """The 12 spectral features of each row: powers by band and their shares, peak, entropy, mean, deviation, largest."""
    n = min(SEGMENT, x.shape[1])
    cos, sin, scale, bins = (np.array(v) for v in welch(n, rate))
    starts = range(0, x.shape[1] - n + 1, n - n // 2)
    p = np.zeros((len(x), len(bins)))
    for s in starts:
        part = x[:, s : s + n] - x[:, s : s + n].mean(axis=1, keepdims=True)
        p += ((part @ cos.T) ** 2 + (part @ sin.T) ** 2) * scale / len(starts)
    total = p.sum(axis=1)
    bands = [p[:, (bins >= a) & (bins < b)].sum(axis=1) for a, b in ((0, 10), (10, 50), (50, np.inf))]
    return np.stack((total, *bands, *(_ratio(b, total) for b in bands), bins[p.argmax(axis=1)], -(p * np.log2(p + 1e-10)).sum(axis=1), p.mean(axis=1), p.std(axis=1), p.max(axis=1)), axis=1)


def wavelet_values(x: np.ndarray) -> np.ndarray:
    """Mean, deviation, least, largest and energy of each coefficient array; shorter windows have fewer, and zeros for the rest."""
    parts = [x @ np.array(rows).T for rows in wavelet_rows(x.shape[1])] if wavelet_level(x.shape[1]) else [x]
    values = [f for c in parts for f in (c.mean(axis=1), c.std(axis=1), c.min(axis=1), c.max(axis=1), (c * c).sum(axis=1))]
    return np.stack(values + [np.zeros(len(x))] * (COUNTS["w"] - len(values)), axis=1)


def values(x: np.ndarray, kinds: str = "tfw", rate: float = SAMPLE_RATE) -> np.ndarray:
    """All features of rows of equal length. Of empty windows the time features are NaN, the others 0."""
    if not x.shape[1]:
        return np.concatenate([np.full((len(x), COUNTS[k]), np.nan if k == "t" else 0.0) for k in kinds], axis=1)
    steps = {"t": time_values, "f": lambda v: spectral_values(v, rate), "w": wavelet_values}
    return np.concatenate([steps[k](x) for k in kinds], axis=1)


def extract(windows: DataFrame, kinds: str = "tfw", axes: tuple[str, ...] = AXES, rate: float = SAMPLE_RATE) -> DataFrame:
    """Replace the array columns of windows by their features; windows may differ in length, a null one is empty."""
    names = [f"{a}_{k}{i}" for a in axes for k in kinds for i in range(COUNTS[k])]

    def told(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for column in columns:
                arrays = [np.zeros(0) if a is None else np.asarray(a, float) for a in column]
                sizes = np.array([len(a) for a in arrays])
                found = np.zeros((len(arrays), sum(COUNTS[k] for k in kinds)))
                for n in np.unique(sizes):
                    some = np.flatnonzero(sizes == n)
                    with np.errstate(invalid="ignore"):
                        found[some] = values(np.stack([arrays[i] for i in some]), kinds, rate)
                out.append(found)
            yield pd.DataFrame(np.concatenate(out, axis=1), columns=names)

    def alone(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from told((b,) for b in batches)

    made = F.pandas_udf(told if len(axes) > 1 else alone, ", ".join(f"{n} double" for n in names))
    keys = [c for c in windows.columns if c not in axes]
    # NaN comes back as null.
    return windows.select(*keys, made(*axes).alias("_f")).select(*keys, *[F.coalesce(f"_f.{n}", F.lit(float("nan"))).alias(n) for n in names])
