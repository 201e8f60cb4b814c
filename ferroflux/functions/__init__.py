"""Column functions (guarded arithmetic, strict numbers, clipping, names) and the tables of spectra and wavelets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DB4_LOW, LSB_TO_UT, SAMPLE_RATE

_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    """a / b, or ``fill`` where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(fill))


def strict_double(token: Column) -> Column:
    """The number that a token spells, or null; no suffixes, separators or blanks. A sign before nan is ignored."""
    number = F.coalesce(token.try_cast("double"), F.when(F.lower(token).isin("+nan", "-nan"), F.lit(float("nan"))))
    return F.when(F.rlike(token, F.lit(_NUMBER)), number)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def quantile(sorted_array: Column, q: float) -> Column:
    """Quantile of a sorted array of numbers, interpolated linearly."""
    at = (F.size(sorted_array) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a = F.get(sorted_array, low)
    b = F.get(sorted_array, F.least(low + 1, F.size(sorted_array) - 1))
    return a + (b - a) * (at - low)


def welch(n: int, rate: float = SAMPLE_RATE) -> tuple[list[list[float]], list[list[float]], list[float], list[float]]:
    """Cosine and sine rows with the periodic Hann window applied, scale and frequency of each bin of one segment."""
    w = [0.5 - 0.5 * math.cos(2 * math.pi * p / n) for p in range(n)] if n > 1 else [1.0]
    bins = range(n // 2 + 1)
    cos = [[w[p] * math.cos(2 * math.pi * k * p / n) for p in range(n)] for k in bins]
    sin = [[w[p] * math.sin(2 * math.pi * k * p / n) for p in range(n)] for k in bins]
    power = rate * sum(v * v for v in w)
    scale = [(1.0 if k == 0 or 2 * k == n else 2.0) / power for k in bins]
    return cos, sin, scale, [k * rate / n for k in bins]


def wavelet_level(n: int) -> int:
    """Levels of decomposition of ``n`` samples: two, or fewer for windows that the filter would not fit."""
    taps = len(DB4_LOW)
    return min(2, max(0, int(math.log2(n / (taps - 1))))) if n >= taps - 1 else 0


def wavelet_rows(n: int) -> list[list[list[float]]]:
    """Rows that turn n samples into the coefficients, the approximation first, then details from the last level on."""
    taps = len(DB4_LOW)
    high = [(-1) ** (j + 1) * DB4_LOW[taps - 1 - j] for j in range(taps)]

    def step(size: int, filt) -> list[list[float]]:
        rows = []
        for k in range((size + taps - 1) // 2):
            row = [0.0] * size
            for j in range(taps):
                at = (2 * k + 1 - j) % (2 * size)  # the mirrored signal repeats after twice its length
                row[at if at < size else 2 * size - 1 - at] += filt[j]
            rows.append(row)
        return rows

    def chain(outer, inner):
        return [[sum(row[k] * inner[k][p] for k in range(len(inner))) for p in range(n)] for row in outer]

    low, details = None, []
    for _ in range(wavelet_level(n)):
        size = n if low is None else len(low)
        through = (lambda rows: rows) if low is None else (lambda rows, low=low: chain(rows, low))
        details.insert(0, through(step(size, high)))
        low = through(step(size, DB4_LOW))
    return [low, *details] if low else []


def elapsed_name(ts: Column, prefix: str, suffix: str = ".csv") -> Column:
    """The name of a log that began at a timestamp."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(suffix))


def raw_counts(ut: Column) -> Column:
    """The sensor's counts of a reading in microtesla: the inverse scale."""
    return ut / F.lit(LSB_TO_UT)
