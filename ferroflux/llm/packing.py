"""Packing of tokenised documents into fixed-length sequences (first-fit decreasing).

Documents are tokenised, ended with an end id and cut at multiples of the
sequence length; whole pieces fill a sequence each, and the rest are packed by
first-fit decreasing with a tournament tree of bin capacities, independently
in randomised groups, so no task sees more than about ``group_size`` pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cached, materialize, runs

LENGTH = 1024
END_ID = 0
#: The byte-level tokenizer's own split into pre-tokens.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str, added_tokens: bool = False):
    """text -> ids as little-endian unsigned 32-bit, with the vocabulary of the tokenizers file at ``path``.

    In a byte-level BPE file ids rise in the order of merges, so its vocabulary is
    a table of ranks and tiktoken gives the same ids in a fourth of the time.
    Files of any other make go through the tokenizers library. So do, with
    ``added_tokens``, texts that hold one of the file's added tokens, which then
    gets its own id; without, it is text like any other.
    """

    def build():
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added_tokens
        slow = lambda texts: [np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not told.get("normalizer") and told["model"]["type"] == "BPE":
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
            letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
            added = {t["content"] for t in told.get("added_tokens", [])}
            ranks = {bytes(letters[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in added}
            encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            fast = lambda t: np.asarray(encoding.encode_ordinary(t), dtype="<u4").tobytes()
            return lambda texts: [slow([t])[0] if added_tokens and any(x in t for x in added) else fast(t) for t in texts]
        return slow

    return cached(f"tokenizer {path} {added_tokens}", build)


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens and, on demand, ids.

    A null text counts as empty and gives one piece holding the end id. Rows that
    repeat a doc_id are packed as documents of their own.
    """
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(tokenizer, added_tokens)
        for pdf in runs(batches):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            rows: list[tuple] = []
            for doc, ids in zip(pdf["doc_id"].tolist(), encode(texts)):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    row = (doc, at, len(part) // 4, zlib.crc32(part), n)
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if keep_ids else row)
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, given in falling order, by first fit.

    Leaves of the tree are the bins' free room, inner nodes the most below them;
    the descent that prefers left children finds the first bin with room.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node >>= 1
        while node:
            top = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == top:
                break
            tree[node] = top
            node >>= 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group_size: int = 8192, seed: int = 0) -> DataFrame:
    """Add sequence_id and offset to pieces; ``pieces`` should be a stored table.

    sequence_id is group * 2**32 + bin. Pieces are dealt to groups by a hash of
    their row number, so repeated documents spread as all others do.
    """
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        whole = int((pdf["length"] == length).sum())
        rest, offset = first_fit_decreasing(pdf["length"].to_numpy(np.int64)[whole:], length)
        bins = np.concatenate((np.arange(whole), rest + whole))
        pdf["sequence_id"] = pdf["pack_group"].to_numpy(np.int64) * (1 << 32) + bins
        pdf["offset"] = np.concatenate((np.zeros(whole, np.int64), offset))
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="pack_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(pack, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_size: int = 8192, keep_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Pack all documents; see token_pieces and pack_pieces for the columns, _encoder for ``added_tokens``."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer, length, keep_ids, added_tokens), "pieces"), length, group_size)
