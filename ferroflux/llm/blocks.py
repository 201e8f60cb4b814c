"""Documents packed into blocks of text, so that work on words or bytes moves arrays.

A block is a row (block, ids, sizes, data): the doc_ids and UTF-8 sizes of its
documents in scan order and their compressed texts. Blocks are made without a
shuffle. Keys of a block (hashes, sorted) are dealt to buckets, which are ranges
of the hash; each bucket answers in the order of the keys, so an answer needs
no keys, and a key occurs once per block however often its documents repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, runs

BLOCK_BYTES = 4 << 20


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, name: str = "blocks", mark: str | None = None) -> DataFrame:
    """Blocks of all rows of ``docs`` (doc_id, text); null texts count as empty. Stored in the shared folder.

    With ``mark``, the name of a boolean column, blocks also have ``marks``, 1 for
    each document of which it is true.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        ids, texts, marks, size = [], [], [], 0

        def out() -> pd.DataFrame:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pd.DataFrame({"ids": [list(ids)], "sizes": [[len(t) for t in texts]], "data": [data], "marks": [bytes(marks)]})

        for pdf in runs(batches):
            for i, text, m in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["mark"]):
                text = bytes(text) if text is not None else b""
                if texts and size + len(text) > block_bytes:
                    yield out()
                    ids, texts, marks, size = [], [], [], 0
                ids.append(None if pd.isna(i) else int(i))
                texts.append(text)
                marks.append(int(m))
                size += len(text)
        if texts:
            yield out()

    marked = F.coalesce(F.col(mark).cast("boolean"), F.lit(False)) if mark else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), marked.cast("int").alias("mark"))
    packed = rows.mapInPandas(pack, "ids array<long>, sizes array<long>, data binary, marks binary")
    return materialize(packed.select(F.monotonically_increasing_id().alias("block"), "ids", "sizes", "data", *["marks"] * bool(mark)), name)


def unpack(data: bytes, sizes) -> list[bytes]:
    import zstandard

    sizes = np.asarray(sizes, dtype=np.int64)
    if not sizes.sum():
        return [b""] * len(sizes)
    text = zstandard.ZstdDecompressor().decompress(bytes(data), max_output_size=int(sizes.sum()))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def text_bytes(blocks: DataFrame) -> int:
    return blocks.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]


def cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of sorted 64-bit keys; bucket i of n holds the i-th n-th of all values."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.diff(of)) + 1
    starts = np.concatenate(([0], edge)) if len(keys) else np.zeros(0, np.int64)
    ends = np.concatenate((edge, [len(keys)]))
    return [(int(of[a]), int(a), int(b)) for a, b in zip(starts, ends)]
