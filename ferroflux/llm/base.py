"""Shared pieces: shared-folder tables, worker caches and word hashing.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing
A-Z, so all helpers work on UTF-8 bytes and leave other letters alone.
"""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..store import clear, materialize, remove, scratch, shared_dir

__all__ = ["clear", "materialize", "scratch", "shared_dir"]

#: Text is handled in slices of about this many bytes, which bounds a worker's arrays.
CHUNK = 1 << 20


def forget(df: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        remove(spark, path)


def squeezed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unsqueezed(parts, kind) -> np.ndarray:
    """The values of all parts, one after another."""
    import zstandard

    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind) for x in parts)])


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nobody holds any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def runs(batches: Iterator, rows: int = 256) -> Iterator:
    """Batches in runs of at most ``rows`` rows. Spark bounds a batch by bytes, this the arrays made of it."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def fresh(stem: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken, name = {c.lower() for c in columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as one identifier, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def cached(key: str, build: Callable):
    """``build()`` once per worker process, also when code arrives pickled by value."""
    store = sys.modules.setdefault("_ferroflux_cache", types.ModuleType("_ferroflux_cache")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Multiplier of the polynomial hashes, odd and thus invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""

    def build():
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            a = np.full(n + 1, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        return tuple(out)

    n = max(n, 2 * CHUNK)
    up, down = cached("powers", build)
    if len(up) <= n:
        sys.modules["_ferroflux_cache"].__dict__.pop("powers")
        up, down = cached("powers", build)
    return up, down


def byte_codes() -> np.ndarray:
    return cached("codes", lambda: np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64))


#: Places in a word that have codes of their own.
PLACES = 64


def place_codes() -> np.ndarray:
    """A random number for each place, modulo PLACES, and byte."""
    return cached("places", lambda: np.random.default_rng(20240502).integers(0, 1 << 63, PLACES * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def separators() -> np.ndarray:
    """ASCII other than letters and digits separates words (for loose matching)."""
    table = np.zeros(256, dtype=bool)
    table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


def _slices(data: bytes, separates: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces near CHUNK long that end at a separator."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n:
            found = np.flatnonzero(separates[np.frombuffer(data, np.uint8, min(4096, n - end), end)])
            if len(found):
                end += int(found[0]) + 1
                break
            end = min(n, end + 4096)
        yield at, end
        at = end


def word_spans(data: bytes, separates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of ``data``, which is lower-cased already.

    A word's hash adds up a random number for each place and byte; beyond the first
    PLACES bytes the numbers are multiplied by another one for each further run of
    PLACES. No algebra links the numbers, so unlike words share a hash by chance only.
    """
    hashes, starts, ends = [], [], []
    codes = place_codes()
    for lo, hi in _slices(data, separates):
        raw = np.frombuffer(data, np.uint8, hi - lo, lo)
        gap = separates[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        s, e = edge[::2], edge[1::2]
        size = e - s
        letters = raw[~gap]
        ends_at = np.cumsum(size)
        inside = np.arange(len(letters)) - np.repeat(ends_at - size, size)
        value = codes[((inside & (PLACES - 1)) << 8) | letters]
        far = np.flatnonzero(inside >= PLACES)
        if len(far):
            value[far] *= mix64((inside[far] // PLACES).astype(np.uint64)) | np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        hashes.append(mix64(total[ends_at] - total[ends_at - size] + size.astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, joined lower-cased text, offset of each document) of runs of documents."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[i:j]])))
        yield i, j, b"\n".join(texts[i:j]).lower() + b"\n", offsets
        i = j


def doc_words(texts: list[bytes], separates: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word hashes, bounds) of runs of documents.

    Document ``first + k`` has the words ``bounds[k]:bounds[k + 1]``.
    """
    separates = space_table() if separates is None else separates
    for i, j, data, offsets in chunks(texts):
        h, s, _ = word_spans(data, separates)
        yield i, h, np.searchsorted(s, offsets)


def texts_of(column) -> list[bytes]:
    """A pandas column of binaries with nulls as empty texts."""
    return [bytes(x) if x is not None else b"" for x in column]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
    return mix64(out)
