"""Removal of long repeated substrings by compared hashes.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id. Sorting every suffix of a corpus would move each
byte many times, so only strings that can match are compared:

1. The ``length``-byte strings that share their minimizer (of the hashes of their
   K-byte parts, the smallest, then leftmost) form a segment, which is about 13
   bytes longer than ``length``. Equal strings have equal minimizers. Blocks of
   documents send their minimizers and learn which occur in several blocks.
2. Segments of minimizers that several documents hold meet in buckets, each
   distinct segment of a block once, with its smallest doc_id. There their strings
   are ordered by hash, and equal neighbours are verified byte by byte. Should unlike
   strings share a hash, the suffixes at their starts are sorted by mergesort; two
   are compared by the longest common extension that a binary search over prefix
   polynomial hashes finds.
3. Each segment learns, for each of its strings, the smallest doc_id that holds
   it; blocks mark the bytes by what they noted of their segments in step 2.

Copies of one passage therefore cost a row per block, not per copy or pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import byte_codes, materialize, mix64, powers, squeezed, unsqueezed
from .blocks import cuts, text_blocks, text_bytes, unpack

LENGTH = 50
#: Bytes of a minimizer: 25 of them start in each string.
K = 26
#: Text whose minimizers or segments meet in one bucket.
BUCKET_BYTES = 8 << 20
#: Buckets whose minimizers meet in one group of the first exchange, which moves hashes only.
ASKED = 4
#: Text of a block. Exchanges have a row for each block and bucket, so small blocks cost time with the square of the corpus.
BLOCK_BYTES = 8 << 20
#: Text whose segments are found at once.
SLICE = 1 << 17
#: Bits of a minimizer's hash in the first exchange, which only rules out what nobody else holds.
FILTER_BITS = 44
NO_DOC = np.iinfo(np.int64).max


class Segments:
    """Segments of a block's documents: minimizer hash, first and last string start, document, and names if they are asked for.

    They are found slice by slice, so that a slice's arrays stay in a core's cache. A text longer than a slice is cut at
    multiples of its size from the text's start, and so is a segment that lies there.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, names: bool = True):
        self.data = b"".join(texts)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        held = np.diff(self.bounds) >= length
        docs, starts, ends = np.flatnonzero(held), self.bounds[:-1][held], self.bounds[1:][held] - length + 1
        parts, lo, n = [], 0, len(self.data)
        while lo < n:
            edge = int(self.bounds[np.searchsorted(self.bounds, lo + SLICE, "right") - 1])
            hi = edge if edge > lo else min(n, lo + SLICE)
            a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
            if a < b:
                raw = np.frombuffer(self.data, np.uint8, min(n, hi + length - 1) - lo, lo)
                parts.append(_slice_segments(raw, lo, docs[a:b], np.maximum(starts[a:b], lo) - lo, np.minimum(ends[a:b], hi) - lo, length, names))
            lo = hi
        kinds = (np.uint64, np.uint64, np.int32, np.int32, np.int32, np.int32)
        self.minimizer, self.name, self.first, self.last, self.doc, self.anchor = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip(kinds, zip(*parts) if parts else [()] * 6))


def _slice_segments(raw: np.ndarray, lo: int, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, names: bool) -> tuple:
    """What Segments holds of the slice ``raw`` that begins at ``lo``: strings of ``docs`` start from ``starts`` to before ``ends`` in it."""
    width, (_, down) = length - K + 1, powers(len(raw) + 1)
    hashes = prefix_hashes(raw)
    grams = mix64((hashes[K:] - hashes[:-K]) * down[: len(raw) - K + 1])
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    size = ends - starts
    s = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    at = low[s].astype(np.uint32).astype(np.int64)
    # Adjacent documents never share a minimizer's place, as it lies within one of them.
    new = np.flatnonzero(np.diff(at, prepend=-1))
    at, first, last = at[new], s[new], s[np.append(new[1:], len(s)) - 1]
    # Minimizers are small hashes; mixed again, they spread evenly over the buckets.
    minimizer, anchor = mix64(grams[at]), at - first
    doc = np.repeat(docs, np.diff(np.searchsorted(first, np.append(starts, len(raw)))))
    name = mix64(part_hashes(hashes, first, last - first + length) + mix64(minimizer + anchor.astype(np.uint64))) if names else np.zeros(0, np.uint64)
    return (minimizer, name, *(x.astype(np.int32) for x in (first + lo, last + lo, doc, anchor)))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_codes()[raw] * up[: len(raw)], out=total[1:])
    return total


def part_hashes(total: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Polynomial hash of ``size`` bytes from ``start``, the same wherever they stand."""
    _, down = powers(len(total))
    return (total[start + size] - total[start]) * down[start]


def common_extension(total: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the longest common prefix of the suffixes at a and b, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = part_hashes(total, a, mid) == part_hashes(total, b, mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def sort_suffixes(raw: np.ndarray, total: np.ndarray, group: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of suffixes by group, then by their first ``length`` bytes: a mergesort, all groups at once.

    ``group`` rises. A run of 2**k suffixes of a group is merged with the next one:
    each suffix finds its place in the other run by binary search, and every
    comparison is a common extension and one byte.
    """
    order = np.arange(len(start))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(group)])))
    begin, count = np.repeat(first, size), np.repeat(size, size)
    inside = np.arange(len(start)) - begin

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x stands before y; equal ones as ``ties`` says."""
        ext = common_extension(total, x, y, length)
        step = np.minimum(ext, length - 1)
        return np.where(ext == length, ties, raw[x + step] < raw[y + step])

    run = 1
    while (count > run).any():
        act = np.flatnonzero(count > run)
        i = inside[act]
        left = (i // run) % 2 == 0
        other = begin[act] + np.where(left, (i // run + 1) * run, (i // run - 1) * run)
        stop = np.minimum(other + run, begin[act] + count[act])
        low, high = np.minimum(other, stop), stop.copy()
        base = low.copy()
        mine = start[order[act]]
        while len(going := np.flatnonzero(low < high)):
            mid = (low[going] + high[going]) // 2
            # Suffixes of the left run stand before equal ones of the right run.
            smaller = before(start[order[mid]], mine[going], ~left[going])
            low[going] = np.where(smaller, mid + 1, low[going])
            high[going] = np.where(smaller, high[going], mid)
        pair = begin[act] + i // (2 * run) * 2 * run
        place = pair + i % run + (low - base)
        merged = order.copy()
        merged[place] = order[act]
        order = merged
        run *= 2
    return order


def _equal_strings(raw: np.ndarray, start: np.ndarray, distance: np.ndarray, minimizer: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings at ``start`` in which equal ones are neighbours, and whether each equals the one before it."""
    total = prefix_hashes(raw)
    hashes = part_hashes(total, start, length)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    same = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    if _verified(raw, start[order], same, length):
        return order, same
    # Unlike strings share a hash, so all are sorted by their bytes. Equal ones have their minimizer at the same distance, so only such suffixes meet.
    by = np.lexsort((distance, minimizer))
    m, d = minimizer[by], distance[by]
    group = np.cumsum(np.concatenate(([True], (m[1:] != m[:-1]) | (d[1:] != d[:-1]))))
    order = by[sort_suffixes(raw, total, group, start[by], length)]
    same = np.concatenate(([False], group[1:] == group[:-1]))
    _verified(raw, start[order], same, length)
    return order, same


def _verified(raw: np.ndarray, place: np.ndarray, same: np.ndarray, length: int) -> bool:
    """Keep of ``same`` what equals its neighbour byte by byte; whether that was all."""
    at, strings = np.flatnonzero(same), np.lib.stride_tricks.sliding_window_view(raw, length)
    for lo in range(0, len(at), 1 << 14):
        x = at[lo : lo + (1 << 14)]
        same[x] = (strings[place[x]] == strings[place[x - 1]]).all(axis=1)
    return bool(same[at].all())


def smallest_docs(raw: np.ndarray, begin: np.ndarray, windows: np.ndarray, anchor: np.ndarray, minimizer: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string of each segment in turn, the smallest ``doc`` of any segment that holds it.

    A segment begins at ``begin`` in ``raw`` and holds ``windows`` strings;
    ``anchor`` is its minimizer's place in it, ``doc`` its smallest doc_id.
    """
    which = np.repeat(np.arange(len(begin)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = begin[which] + inside
    order, same = _equal_strings(raw, start, anchor[which] - inside, minimizer[which], length)
    heads = np.flatnonzero(~same)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(doc[which[order]], heads), np.diff(np.concatenate((heads, [len(order)]))))
    return out


def gathered(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... counts[0] times, then begin[1], ..."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _packed(keys: np.ndarray) -> bytes:
    """Sorted integers as steps, in 4 bytes each if they fit."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)
    narrow = len(steps) < 2 or int(steps[1:].max()) < 1 << 32
    return b"\1" + keys[:1].tobytes() + steps[1:].astype(np.uint32).tobytes() if narrow else b"\0" + keys.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data[1:], np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data[1:9], np.uint64), np.frombuffer(data[9:], np.uint32).astype(np.uint64))))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _shared(segments: Segments, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct minimizers, whether several doc_ids of this block hold each, index of each segment's)."""
    order = np.argsort(segments.minimizer, kind="stable")
    keys, doc = segments.minimizer[order], ids[segments.doc[order]]
    head = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    at, first = np.empty(len(order), np.int32), np.flatnonzero(head)
    at[order] = np.cumsum(head) - 1
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    return keys[first], several, at


def _known(segments: Segments, ids: np.ndarray, wanted: np.ndarray):
    """Distinct wanted segments in order of (minimizer, name): index of one, smallest doc_id, and each member's class."""
    x = np.flatnonzero(wanted)
    order = x[np.lexsort((segments.name[x], segments.minimizer[x]))]
    m, s = segments.minimizer[order], segments.name[order]
    head = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (s[1:] != s[:-1])))) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((head, [len(order)])))
    low = np.minimum.reduceat(ids[segments.doc[order]], head) if len(head) else np.zeros(0, np.int64)
    return order[head] if len(head) else head, low, order, np.repeat(np.arange(len(head)), count)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    ``kept``, the remaining bytes, comes with ``keep_bytes`` only. Null texts are empty. Rows that repeat a doc_id are not smaller than each
    other, so they don't remove each other's bytes. A null doc_id counts as larger
    than all others.
    """
    import zstandard

    spark = docs.sparkSession
    blocks = text_blocks(docs, BLOCK_BYTES, name="substrings")
    buckets = max(1, -(-text_bytes(blocks) // bucket_bytes))
    coarse = -(-buckets // ASKED)
    shift, kind = np.uint64(64 - FILTER_BITS), np.uint8 if length < 120 else np.uint32

    def named(ids) -> np.ndarray:
        return np.array([NO_DOC - 1 if i is None or pd.isna(i) else int(i) for i in ids], dtype=np.int64)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, ids, sizes, data in zip(pdf["block"], pdf["ids"], pdf["sizes"], pdf["data"]):
                keys = _distinct(Segments(unpack(data, sizes), length, names=False).minimizer)
                rows = [(k, block, _packed(_distinct(keys[a:b] >> shift))) for k, a, b in cuts(keys, coarse)]
                yield pd.DataFrame(rows, columns=["bucket", "block", "keys"])

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(bytes(x)) for x in pdf["keys"]]
        keys = np.sort(np.concatenate(parts))  # a block names each once
        keys = np.append(_distinct(keys[1:][keys[1:] == keys[:-1]]), np.uint64(0xFFFFFFFFFFFFFFFF))
        flags = [np.packbits(keys[np.searchsorted(keys, p)] == p).tobytes() for p in parts]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "flags": flags})

    def flagged(found: Segments, ids: np.ndarray, parts) -> np.ndarray:
        """Whether each segment's minimizer is held by several documents."""
        keys, several_here, at = _shared(found, ids)
        told = {x["bucket"]: np.unpackbits(np.frombuffer(bytes(x["flags"]), np.uint8)) for x in (parts if parts is not None else [])}
        for k, a, b in cuts(keys, coarse):
            short = keys[a:b] >> shift
            back = np.cumsum(np.concatenate(([False], short[1:] != short[:-1])))
            several_here[a:b] |= told[k][back].astype(bool)
        return several_here[at]

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, ids, sizes, data, parts in zip(pdf["block"], pdf["ids"], pdf["sizes"], pdf["data"], pdf["parts"]):
                ids = named(ids)
                found = Segments(unpack(data, sizes), length)
                one, low, order, cls = _known(found, ids, flagged(found, ids, parts))
                # What the block will mark by goes along, so that its segments aren't found again.
                spans = (found.last - found.first)[order].astype(kind)
                state = [(-1 - block, block, squeezed(found.first[order]), squeezed(spans), squeezed(np.packbits(np.diff(cls, prepend=-1) > 0)), b"", b"", b"")]
                rows = state if len(order) else []
                for k, a, b in cuts(found.minimizer[one], buckets):
                    x = one[a:b]
                    text = b"".join(found.data[i : j + length] for i, j in zip(found.first[x].tolist(), found.last[x].tolist()))
                    windows = (found.last[x] - found.first[x] + 1).astype(kind)
                    packed = zstandard.ZstdCompressor(level=3).compress(text)
                    rows.append((k, block, found.minimizer[x].tobytes(), found.name[x].tobytes(), low[a:b].tobytes(), windows.tobytes(), found.anchor[x].astype(kind).tobytes(), packed))
                yield pd.DataFrame(rows, columns=["bucket", "block", "m", "name", "low", "windows", "anchor", "text"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pdf[["block", "bucket", "m", "name", "low"]].set_axis(["block", "bucket", "runs", "starts", "docs"], axis=1)
        m, name, low, windows, anchor = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("m", np.uint64), ("name", np.uint64), ("low", np.int64), ("windows", kind), ("anchor", kind)))
        windows, anchor = windows.astype(np.int64), anchor.astype(np.int64)
        text = b"".join(zstandard.ZstdDecompressor().decompress(bytes(x)) for x in pdf["text"])
        raw, sizes = np.frombuffer(text, np.uint8), windows + length - 1
        begin = np.cumsum(sizes) - sizes
        # Copies of one segment form a class, which has a smallest doc_id.
        order = np.lexsort((name, m))
        head = np.concatenate(([True], (m[order][1:] != m[order][:-1]) | (name[order][1:] != name[order][:-1])))
        of = np.empty(len(m), np.int64)
        of[order] = np.cumsum(head) - 1
        one = order[head]
        for i, c in zip(np.flatnonzero(one[of] != np.arange(len(m))).tolist(), of[one[of] != np.arange(len(m))].tolist()):
            j = one[c]
            if text[begin[i] : begin[i] + sizes[i]] != text[begin[j] : begin[j] + sizes[j]]:
                raise ValueError("two segments share a 128-bit name")
        least = np.full(len(one), NO_DOC)
        np.minimum.at(least, of, low)
        # Where a minimizer has several classes, their strings are compared.
        alone = np.concatenate(([True], m[one][1:] != m[one][:-1]))
        multi = ~(alone & np.concatenate((alone[1:], [True])))
        runs, starts, docs_ = np.ones(len(one), np.int64), np.zeros(len(one), np.int64), least.copy()
        if multi.any():
            x = one[multi]
            # Only their text is hashed.
            part = raw[gathered(sizes[x], begin[x])]
            found = smallest_docs(part, np.cumsum(sizes[x]) - sizes[x], windows[x], anchor[x], m[x], least[multi], length)
            edge = np.cumsum(windows[x]) - windows[x]
            change = np.concatenate(([True], found[1:] != found[:-1]))
            change[edge] = True
            at = np.flatnonzero(change)
            runs[multi] = np.add.reduceat(change.astype(np.int64), edge)
            place = gathered(runs, np.cumsum(runs) - runs)
            kept = np.repeat(multi, runs)
            starts, docs_ = np.zeros(len(place), np.int64), np.repeat(least, runs)
            starts[kept] = at - np.repeat(edge, runs[multi])
            docs_[kept] = found[at]
        offset = np.cumsum(runs) - runs
        out, at = [], 0
        for block, bucket, x in zip(pdf["block"], pdf["bucket"], pdf["m"]):
            mine = of[at : at + len(x) // 8]
            r = gathered(runs[mine], offset[mine])
            out.append((block, bucket, runs[mine].astype(kind).tobytes(), starts[r].astype(kind).tobytes(), docs_[r].tobytes()))
            at += len(mine)
        return pd.DataFrame(out, columns=["block", "bucket", "runs", "starts", "docs"])

    def marks(who: np.ndarray, texts: list[bytes], told) -> tuple[np.ndarray, np.ndarray]:
        """Whether each byte of a block goes, and whether any of each document does."""
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        edges, some = np.zeros(bounds[-1] + 1, np.int8), np.zeros(len(texts), bool)
        if told is not None and len(told):
            state, *told = told  # its bucket is below all others
            first, last, heads = (unsqueezed([bytes(state[c])], t) for c, t in (("runs", np.int32), ("starts", kind), ("docs", np.uint8)))
            last, cls = first + last, np.cumsum(np.unpackbits(heads, count=len(first)), dtype=np.int64) - 1
            runs = np.concatenate([np.frombuffer(x["runs"], kind) for x in told]).astype(np.int64)
            starts = np.concatenate([np.frombuffer(x["starts"], kind) for x in told]).astype(np.int64)
            docs_ = np.concatenate([np.frombuffer(x["docs"], np.int64) for x in told])
            begin, doc = np.cumsum(runs) - runs, np.searchsorted(bounds, first, "right") - 1
            member, r = np.repeat(np.arange(len(first)), runs[cls]), gathered(runs[cls], begin[cls])
            a = first[member] + starts[r]
            ends = np.concatenate((member[1:] != member[:-1], [True]))
            b = np.where(ends, last[member], first[member] + np.append(starts[r][1:], 0) - 1)
            hit = docs_[r] < who[doc[member]]
            some[doc[member[hit]]] = True
            # Runs that overlap are one.
            by = np.argsort(a[hit], kind="stable")
            a, b = a[hit][by], np.maximum.accumulate(b[hit][by] + length)
            new = np.concatenate(([True], a[1:] > b[:-1])) if len(a) else np.zeros(0, bool)
            edges[a[new]] = 1
            edges[b[np.append(new[1:], True)] if len(a) else a] = -1
        return np.cumsum(edges[:-1], dtype=np.int8).view(bool), some

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, sizes, data, told in zip(pdf["ids"], pdf["sizes"], pdf["data"], pdf["told"]):
                texts, who = unpack(data, sizes), named(ids)
                gone, some = marks(who, texts, told)
                rows, at = [], 0
                for i, text, hit in zip(ids, texts, some.tolist()):
                    g, kept, spans = gone[at : at + len(text)], text, 0
                    if hit:
                        kept = np.frombuffer(text, np.uint8)[~g].tobytes()
                        spans = int(np.count_nonzero(np.diff(g.view(np.int8), prepend=0) == 1))
                    rows.append((i, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept] * keep_bytes))
                    at += len(text)
                out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    asked = blocks.mapInPandas(ask, "bucket long, block long, keys binary")
    flags = asked.groupBy("bucket").applyInPandas(several, "block long, bucket long, flags binary")
    flags = materialize(flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("parts")), "flags")
    known = blocks.join(flags, "block", "left")
    given = known.mapInPandas(give, "bucket long, block long, m binary, name binary, low binary, windows binary, anchor binary, text binary")
    told = given.groupBy("bucket").applyInPandas(compare, "block long, bucket long, runs binary, starts binary, docs binary")
    told = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "runs", "starts", "docs"))).alias("told"))
    return blocks.join(told, "block", "left").mapInPandas(mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
