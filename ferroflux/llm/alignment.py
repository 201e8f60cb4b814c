"""Alignment of the tokens of two tokenizers over the same bytes, by a dangling-suffix transducer.

The transducer reads both token streams of a text. Its state is the side that leads
and the bytes of that side's last token that the other side hasn't matched yet. The
next token is always the lagging side's (the first side's, if nothing dangles); the
state that follows depends on the residual and that token alone, so it is looked up
in a table that fills as texts come. Tokens whose bytes contradict the residual end
the text; an empty residual closes a group. Each step on a residual is one link:
the leader's last token and the token read overlap.

Long texts are cut where both tokenizers have a boundary, before a space after a
character that is no white space, so a text is never held as one list of tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cached, materialize, runs, squeezed, unsqueezed
from .packing import SPLIT

#: Characters of a piece of text, and bytes of text whose links are counted together.
PIECE, BLOCK = 1 << 16, 1 << 24
#: Remembered transitions; a full table starts anew.
MEMO = 1 << 20


class Diverged(ValueError):
    """The two sides' bytes differ."""


class Transducer:
    """Steps over tokens of sides A and B, given the bytes of each id.

    States are numbers: 0 with nothing dangling, odd ones where A leads, even ones where B does.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[int, int] = {}
        self.number: dict[tuple[bool, bytes], int] = {}
        self.dangling: dict[int, bytes] = {0: b""}

    def _state(self, a_leads: bool, residual: bytes) -> int:
        if not residual:
            return 0
        found = self.number.get((a_leads, residual))
        if found is None:
            found = self.number[a_leads, residual] = 2 * len(self.number) + (3 if a_leads else 2)
            self.dangling[found] = residual
        return found

    def step(self, key: int) -> int:
        """The state after (state, token), which is remembered."""
        state, token = key >> 16, key & 0xFFFF
        residual, reads_b = self.dangling[state], state & 1
        new = (self.b_bytes if reads_b else self.a_bytes)[token]
        if residual.startswith(new):
            after = self._state(bool(reads_b), residual[len(new) :])
        elif new.startswith(residual):
            after = self._state(not reads_b, new[len(residual) :])
        else:
            raise Diverged
        self.memo[key] = after
        return after

    def run(self, a: list[int], b: list[int]) -> list[int]:
        """The state after each token read; Diverged unless both sides spell the same bytes."""
        if len(self.memo) > MEMO:
            self._clear()
        memo, step = self.memo, self.step
        next_a, next_b = iter(a).__next__, iter(b).__next__
        states: list[int] = []
        add, state = states.append, 0
        try:
            while True:
                key = state << 16 | (next_b() if state & 1 else next_a())
                try:
                    state = memo[key]
                except KeyError:
                    state = step(key)
                add(state)
        except StopIteration:
            if state or len(states) != len(a) + len(b):
                raise Diverged from None
        return states


def _tails(widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with each of the four marks that may follow, as zero-padded rows of bytes: A's inner and last ids of a group, B's."""

    def build():
        rows = [f"{i}{mark}".encode().rjust(6, b"\0") for mark in ",|,;" for i in range(widest)]
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 6)

    return cached(f"decimal ids {widest}", build)


class Aligner:
    """Both tokenizers and the transducer over their ids; ``a`` is a byte-level BPE file of tokenizers, ``b`` a sentencepiece model."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a, encoding="utf-8") as f:
            told = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}
        added = {t["content"] for t in told.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in added}
        self.first = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=b)
        a_bytes = [b""] * (max(told["model"]["vocab"].values()) + 1)
        for word, i in ranks.items():
            a_bytes[i] = word
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.widest = max(len(a_bytes), len(b_bytes))
        if self.widest > 1 << 16:
            raise ValueError("ids of both sides must fit in 16 bits")
        # A piece with a space after another character could span a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.transducer = Transducer(a_bytes, b_bytes)

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters whose space before each is left out, cut where neither side's tokens can go across."""
        at = 0
        while self.cuts and len(text) - at > PIECE:
            cut = _CUT.search(text, at + PIECE)
            if not cut:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 2
        yield text[at:]

    def ids(self, piece: str) -> tuple[list[int], list[int]]:
        """The ids of a space and the piece by both sides; Diverged if their bytes aren't its own."""
        whole = " " + piece
        a = self.first.encode_ordinary(whole)
        if self.first.decode_bytes(a) != whole.encode():
            raise Diverged
        return a, self.second.encode(piece, num_threads=1)

    def groups(self, piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, B's ids, A's and B's tokens up to the end of each group, links as A's id * 65536 + B's) of a space and the piece."""
        a, b = self.ids(piece)
        states = np.array(self.transducer.run(a, b), dtype=np.int64)
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        before = np.concatenate((np.zeros(1, np.int64), states[:-1]))
        read_b = (before & 1).astype(np.int64)
        n_b = np.cumsum(read_b)
        n_a = np.arange(1, len(states) + 1) - n_b
        overlap = before != 0
        links = (a[n_a[overlap] - 1] << 16) | b[n_b[overlap] - 1]
        ended = states == 0
        return a, b, n_a[ended], n_b[ended], links.astype(np.uint32)

    def shown(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3;``: the ids of the groups in decimal, with a mark after each."""
        table, widest = _tails(self.widest), self.widest
        a_sizes, b_sizes = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        rows = np.empty(len(a) + len(b), np.int64)
        a_mark, b_mark = np.zeros(len(a), np.int64), np.full(len(b), 2, np.int64)
        a_mark[a_ends - 1], b_mark[b_ends - 1] = 1, 3
        rows[np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)] = a + widest * a_mark
        rows[np.arange(len(b)) + np.repeat(a_ends, b_sizes)] = b + widest * b_mark
        out = table[rows].ravel()
        return out[out != 0].tobytes()

    def document(self, text: str | None) -> tuple[int, int, int, np.ndarray, str]:
        """(n_a, n_b, n_groups, links, digest of the groups) of a text; zeros, no links and '' if it has no tokens."""
        nothing = (0, 0, 0, np.zeros(0, np.uint32), "")
        if not text:
            return nothing
        n_a = n_b = n_groups = 0
        links, sha, mark = [], hashlib.sha256(), b""
        try:
            for piece in self.pieces(text):
                a, b, a_ends, b_ends, found = self.groups(piece)
                sha.update(mark + self.shown(a, b, a_ends, b_ends)[:-1])
                mark = b";"
                n_a, n_b, n_groups = n_a + len(a), n_b + len(b), n_groups + len(a_ends)
                links.append(found)
        except Diverged:
            return nothing
        return n_a, n_b, n_groups, np.concatenate(links), sha.hexdigest()


#: A cut may be before a space between a character that is no white space and one that is no space.
_CUT = re.compile(r"\S (?! )(?=.)", re.DOTALL)


def aligner(a: str, b: str) -> Aligner:
    """One per worker process."""
    return cached(f"aligner {a} {b}", lambda: Aligner(a, b))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, start, end, a_ids, b_ids): the groups of each document, as byte offsets in a space and its text.

    Null and empty texts, and those that a side doesn't spell, have no rows; repeated
    rows have groups of their own. Other columns aren't read.
    """

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = aligner(a, b)
        for pdf in runs(batches, 16):
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                rows, at = [], 0
                try:
                    for piece in held.pieces(text) if text else ():
                        x, y, x_ends, y_ends, _ = held.groups(piece)
                        for i, j, p, q in zip([0, *x_ends[:-1]], x_ends, [0, *y_ends[:-1]], y_ends):
                            ids = x[i:j].tolist()
                            size = sum(len(held.transducer.a_bytes[t]) for t in ids)
                            rows.append((doc, at, at + size, ids, y[p:q].tolist()))
                            at += size
                except Diverged:
                    continue
                out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "a_ids", "b_ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(told, "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>")


_STATS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_BLOCK = "block long, pairs array<int>, counts array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, sizes array<long>, places binary, times binary"


def _blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per BLOCK bytes of text: its distinct pairs with their links, and each document's pairs as places among them."""

    def close(number: int, rows: list[tuple], codes: list[np.ndarray], times: list[np.ndarray]) -> pd.DataFrame:
        flat, often = np.concatenate(codes), np.concatenate(times)
        pairs = np.unique(flat)
        places = np.searchsorted(pairs, flat)
        counts = np.bincount(places, weights=often, minlength=len(pairs)).astype(np.int64)
        stats = dict(zip(_STATS, map(list, zip(*rows))))
        sizes = [len(c) for c in codes]
        steps = np.diff(places, prepend=0).astype("<i4")  # rising within a document, so mostly small
        planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
        one = {"block": number, "pairs": pairs.view(np.int32), "counts": counts, **stats, "sizes": sizes, "places": squeezed(planes), "times": squeezed(often.astype(np.uint32))}
        return pd.DataFrame([list(one.values())], columns=list(one))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = aligner(a, b)
        number, size = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        codes: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for pdf in runs(batches, 64):
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                n_a, n_b, n_groups, links, sha = held.document(text)
                found, often = np.unique(links, return_counts=True)
                rows.append((None if pd.isna(doc) else int(doc), n_a, n_b, n_groups, len(links), sha))
                codes.append(found)
                times.append(often)
                size += len(text or "") + 100
                if size >= BLOCK:
                    yield close(number, rows, codes, times)
                    number, size, rows, codes, times = number + 1, 0, [], [], []
        if rows:
            yield close(number, rows, codes, times)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInPandas(told, _BLOCK), "aligned")


def link_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best) of rows (pair, n): links of each id pair, and whether no other pair of its B id has more."""
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    b_id = F.col("pair").bitwiseAND(0xFFFF)
    # A B id is in at most as many pairs as A has ids.
    most = counts.groupBy(b_id.alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(most, b_id == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def alignment_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    A link's count is that of its id pair over all rows; n_best counts links whose count
    is the highest of their B id. Blocks of documents ask for the counts of their distinct pairs, so
    a pair occurs once a block however many links it has. Null and empty texts, and those
    whose tokens don't spell a space and the text, have zeros and ''. Rows with a null or repeated
    doc_id are rows of their own. Other columns aren't read; an empty table gives no rows.
    """
    blocks = _blocks(docs, a, b)
    asked = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    told = link_counts(asked.select("pair", "n"))
    answers = asked.select(F.col("block").alias("at"), "pair").join(told, "pair")

    def spread(key: tuple, answers: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        one = block.iloc[0]
        pairs = answers["pair"].to_numpy(np.int32).view(np.uint32)
        order = np.argsort(pairs)
        n, best = answers["n"].to_numpy(np.int64)[order], answers["best"].to_numpy(bool)[order]
        planes = unsqueezed([one["places"]], np.uint8)
        places = np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel().astype(np.int64))
        times = unsqueezed([one["times"]], np.uint32).astype(np.int64)
        ends = np.cumsum(np.asarray(one["sizes"], np.int64))
        sums = lambda x: np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(x)))[ends], prepend=0)
        out = pd.DataFrame({c: list(one[c]) for c in _STATS})
        out["doc_id"] = pd.array(out["doc_id"].tolist(), dtype="Int64")
        out["n_best"], out["count_sum"] = sums(times * best[places]), sums(times * n[places])
        return out

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return answers.groupBy("at").cogroup(blocks.drop("pairs", "counts").groupBy("block")).applyInPandas(spread, schema)
