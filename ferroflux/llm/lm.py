"""Language-model scores by a hierarchical Pitman-Yor model of words and their spelling.

Each word is the context of a restaurant whose customers are the tokens after it
(END comes before a text's first). All these restaurants share one parent, the
word restaurant: their tables are its customers. Its tables are in turn the
customers of a spelling model, a restaurant for each context of up to three
previous bytes, whose parent is that of the context without its most distant byte,
up to the empty context over uniform bytes. A word that training never saw has
the probability that its spelling gives it.

Seatings are sampled by Gibbs. A step takes all customers of a dish away and seats
them again one by one, each at an old table or at a new one, with the weights as
they then are; as those are the weights of the Chinese restaurant but for a factor
that depends on the tables opened so far, the new seating is taken or left by
Metropolis and Hastings, which makes the step exact given the other dishes. A
sweep does this for every dish of two customers or more, whatever their number. Only
the moments at which tables are opened have to be drawn, each by one number and a
search, so a dish of a million customers costs about as much as it has tables. The
dishes of a restaurant are seated at the same time, each given the tables that the
others had a sweep ago. After ``burn`` sweeps the predictive probabilities of
``samples`` sweeps are averaged.

Training and scoring share one exchange: blocks of texts send their distinct pairs,
counted, to buckets by context, where pairs are seated and answered. A context of
over 1 / HOT of the tokens is dealt to several buckets by the word, and its totals
are added up afterwards. The levels take turns: a sweep seats the pairs, each on the
predictive probability that the word restaurant gives its word without the pair's own
tables, then the words on the tables that this leaves them, then their spelling. Only
the first seating of the pairs, for want of a word restaurant, is on the word's share of its bucket. In this exchange words and contexts go
by the first bytes of a hash, so many that of all the corpus's words less than one
pair is expected to share them; such a pair would count as one word. Contexts of the spelling model are made of byte classes, so it
has at most 2**15 * 257 cells whatever the corpus, which bounds what is sent to all
tasks; what the pairs learn grows with the corpus and stays in its buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import doc_words, forget, materialize, mix64, release, space_table, squeezed, unsqueezed, word_spans
from .blocks import cuts, text_blocks, text_bytes, unpack

#: The token at the end of each document; no word holds a line break.
END = b"\n"
SYMBOLS = 257
STOP = 256
#: Number of contexts of each order.
CONTEXTS = (1, 64, 4096, 32768)
CELLS = CONTEXTS[-1] * SYMBOLS
STRENGTH_WORDS, STRENGTH_BYTES, STRENGTH_PAIRS = 100.0, 5.0, 5.0
BURN, SAMPLES = 1, 2
#: Distinct words that a task counts before it passes them on.
FLUSH = 400_000
WORD_BUCKET_BYTES = 64 << 20
PAIR_BUCKET_BYTES = 6 << 20
#: Words that are seated at the same time.
SEATED = 1 << 16
#: Dishes with customers left that are seated one after another instead of in rounds.
FEW = 64
HOT = 1000
END_HASH = np.uint64(0xA0761D6478BD642F)


def byte_classes() -> np.ndarray:
    """Letters have a class each, digits one, other ASCII four, bytes of other letters 32."""
    b = np.arange(256)
    out = np.where(b < 128, 28 + (b & 3), 32 + (b & 31))
    out[48:58] = 27
    out[97:123] = np.arange(1, 27)
    out[0] = 0
    return out


def cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, bounds): context * SYMBOLS + symbol of each byte of each word and of its stop."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    stops = ends - 1
    symbol = raw.copy()
    symbol[stops] = STOP
    kind = byte_classes()[raw]
    kind[stops] = 0
    inside = np.arange(len(raw)) - np.repeat(ends - sizes - 1, sizes + 1)
    context = np.zeros(len(raw), np.int64)
    for k, (shift, mask) in enumerate(((0, 63), (6, 63), (12, 7)), 1):
        previous = np.concatenate((np.zeros(k, np.int64), kind[:-k]))[: len(raw)]
        context |= (np.where(inside >= k, previous, 0) & mask) << shift
    return context * SYMBOLS + symbol, np.concatenate(([0], ends))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers: Stirling's series, six places further on."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    inverse = 1 / y
    square = inverse * inverse
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inverse * (1 / 12 - square * (1 / 360 - square / 1260)) - np.log(low)


class Seating:
    """Dishes of ``n`` customers each. A table that is not a dish's first was opened ``at`` so
    many customers; ``row`` says of which dish, and both are in order."""

    def __init__(self, n: np.ndarray, discount: float, rng: np.random.Generator, row: np.ndarray | None = None, at: np.ndarray | None = None):
        self.n, self.discount, self.rng = n.astype(np.int64), discount, rng
        self.row = np.zeros(0, np.int64) if row is None else row
        self.at = np.zeros(0, np.int64) if at is None else at

    def tables(self) -> np.ndarray:
        return (self.n > 0) + np.bincount(self.row, minlength=len(self.n))

    def sweep(self, others: np.ndarray, base: np.ndarray, strength: float, first: bool = False) -> None:
        """Seat every dish's customers anew, given the tables of the ``others`` in its restaurant and the parent's probability of it."""
        fixed, step = (strength + self.discount * others) * base, self.discount * base
        row, at = self._drawn(fixed, step)
        if not first:
            some = np.zeros(len(self.n), bool)
            some[row] = some[self.row] = True
            some = np.flatnonzero(some)  # a dish whose customers sit at one table before and after changes nothing
            taken = np.ones(len(self.n), bool)
            gain = self._norm(some, row, at, fixed, step) - self._norm(some, self.row, self.at, fixed, step)
            taken[some] = np.log(1 - self.rng.random(len(some))) < gain[some]
            row, at = np.concatenate((row[taken[row]], self.row[~taken[self.row]])), np.concatenate((at[taken[row]], self.at[~taken[self.row]]))
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[order]
        self.row, self.at = row, at

    def change(self, n: np.ndarray, others: np.ndarray, base: np.ndarray, strength: float) -> None:
        """Let dishes have ``n`` customers: the last to come leave first, and new ones come after the old."""
        old, self.n, stay = self.n, n.astype(np.int64), self.at < n[self.row]
        self.row, self.at = self.row[stay], self.at[stay]
        row, at = self._drawn((strength + self.discount * others) * base, self.discount * base, np.maximum(1, np.minimum(old, self.n)), self.tables())
        row, at = np.concatenate((self.row, row)), np.concatenate((self.at, at))
        order = np.argsort(row, kind="stable")
        self.row, self.at = row[order], at[order]

    def _drawn(self, fixed: np.ndarray, step: np.ndarray, seated: np.ndarray | None = None, tables: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Openings of a fresh seating, or of what follows the ``seated`` customers: after t tables and
        j customers the next one opens a table with weight fixed + step * t against j - discount * t."""
        rows, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        go = np.flatnonzero(self.n > (1 if seated is None else seated))
        j, t = (np.ones(len(go), np.int64),) * 2 if seated is None else (seated[go], tables[go])
        while len(go) > FEW:
            away, new, u = self.discount * t, fixed[go] + step[go] * t, 1 - self.rng.random(len(go))
            x, n = j - away, self.n[go]
            # Openings are rarer than the sum of their chances, which rules most dishes out.
            may = 1 - u < new * (1 / x + np.log((n - 1 - away) / x))
            go, j, t, n, new, x, u, away = go[may], j[may], t[may], n[may], new[may], x[may], np.log(u[may]), away[may]
            # Log of the chance that none of the customers from the j-th up to the k-th opens a table.
            level = u + lgamma(x) - lgamma(x + new)
            opens = lgamma(n - away) - lgamma(n - away + new) < level
            go, j, t, n, new, x, u, level, away = (v[opens] for v in (go, j, t, n, new, x, u, level, away))
            half = (new - 1) / 2
            guess = np.maximum(x + half, 0.01) * np.exp(np.minimum(-u / new, 60)) - half + away - 1
            guess = np.clip(guess, j, n - 1).astype(np.int64)
            before = lambda k, i: lgamma(k + 1 - away[i]) - lgamma(k + 1 - away[i] + new[i]) < level[i]
            low, high = np.maximum(guess - 2, j), np.minimum(guess + 2, n - 1)
            every = slice(None)
            low, high = np.where((low > j) & before(low - 1, every), j, low), np.where(before(high, every), high, n - 1)
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                past = before(mid, open_)
                high[open_] = np.where(past, mid, high[open_])
                low[open_] = np.where(past, low[open_], mid + 1)
            rows.append(go)
            ats.append(low)
            more = low + 1 < n
            go, j, t = go[more], low[more] + 1, t[more] + 1
        for i, first, opened in zip(go.tolist(), j.tolist(), t.tolist()):
            found = self._alone(int(self.n[i]), float(fixed[i]), float(step[i]), first, opened)
            rows.append(np.full(len(found), i))
            ats.append(np.array(found, np.int64))
        row, at = np.concatenate(rows), np.concatenate(ats)
        order = np.argsort(row, kind="stable")  # rounds are in order of opening
        return row[order], at[order]

    def _alone(self, n: int, fixed: float, step: float, j: int, t: int) -> list[int]:
        """The openings of one dish from the j-th customer on, which a plain loop finds sooner than rounds over few dishes."""
        log_gamma, out, u = math.lgamma, [], []
        while j < n:
            u = u or np.log(1 - self.rng.random(64)).tolist()
            away, new, chance = self.discount * t, fixed + step * t, u.pop()
            x, half = j - away, (new - 1) / 2
            level = chance + log_gamma(x) - log_gamma(x + new)
            past = 1 - away
            before = lambda k: log_gamma(k + past) - log_gamma(k + past + new) < level  # noqa: B023, E731
            guess = max(x + half, 0.01) * math.exp(min(-chance / new, 60)) - half + away - 1 if new else n
            guess = int(min(max(guess, j), n - 1))
            low, high = max(guess - 1, j), min(guess + 1, n - 1)
            if not before(high):
                low, high = high + 1, n - 1
                if low > high or not before(high):
                    break
            elif low > j and before(low - 1):
                low = j
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if before(mid) else (mid + 1, high)
            out.append(low)
            j, t = low + 1, t + 1
        return out

    def _norm(self, many: np.ndarray, row: np.ndarray, at: np.ndarray, fixed: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log of the product of the weights' sums along a seating of the dishes ``many``: what drawing it one by one divided by."""
        if not len(many):
            return np.zeros(len(self.n))
        dish = np.concatenate((many, row))
        begin, order = np.concatenate((np.zeros(len(many), np.int64), at)), np.argsort(dish, kind="stable")
        dish, begin = dish[order], begin[order]
        head = np.flatnonzero(np.concatenate(([True], dish[1:] != dish[:-1])))
        t = np.arange(len(dish)) - np.repeat(head, np.diff(np.concatenate((head, [len(dish)])))) + 1
        end = np.append(begin[1:], 0)
        last = np.append(head[1:], len(dish)) - 1
        end[last] = self.n[dish[last]] - 1
        shift = fixed[dish] + step[dish] * t - self.discount * t
        return np.bincount(dish, lgamma(end + 1 + shift) - lgamma(begin + 1 + shift), len(self.n))


def discount_of(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.05, 0.95))


def spelling(cell: np.ndarray, n: np.ndarray, seed: int, sweeps: int = BURN + 1) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A seating of the spelling model: from the empty context on, each order's cells, what
    these add, and each context's share of its parent; see ``log_cells``.

    ``n`` customers of each ``cell`` sit in the restaurants of the longest
    contexts; their tables are customers of the parents, and so on.
    """
    rng = np.random.default_rng(seed)
    levels = []
    for k in range(len(CONTEXTS) - 1, -1, -1):
        context, symbol = np.divmod(cell, SYMBOLS)
        discount = discount_of(int((n == 1).sum()), int((n == 2).sum()))
        # Before a parent is seated, its dishes count as used in proportion to the customers here.
        share = np.bincount(symbol, n, SYMBOLS) + 1.0
        base = (share / share.sum())[symbol]
        seats, t = Seating(n, discount, rng), np.ones(len(cell), np.int64)
        for i in range(sweeps):
            seats.sweep(np.bincount(context, t, CONTEXTS[k])[context] - t, base, STRENGTH_BYTES, first=i == 0)
            t = seats.tables()
        guests, tables = np.bincount(context, n, CONTEXTS[k]), np.bincount(context, t, CONTEXTS[k])
        gain = (n - discount * t) / (STRENGTH_BYTES + guests[context])
        share = (STRENGTH_BYTES + discount * tables) / (STRENGTH_BYTES + guests)
        levels.append((cell.astype(np.int32), gain.astype(np.float32), share.astype(np.float32)))
        if k:
            up, at = np.unique((context % CONTEXTS[k - 1]) * SYMBOLS + symbol, return_inverse=True)
            cell, n = up, np.bincount(at, t, len(up)).astype(np.int64)
    return levels[::-1]


def log_cells(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Natural log of the predictive probability of every cell of the longest contexts."""
    p = np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)
    for cell, gain, share in levels:
        p = (share.reshape(-1, len(p), 1) * p).reshape(-1, SYMBOLS)
        p.reshape(-1)[cell] += gain
    return np.log(p, out=p).ravel()


def log_some(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], some: np.ndarray) -> np.ndarray:
    """What ``log_cells`` has of some cells, without a table of all."""
    context, symbol = np.divmod(some, SYMBOLS)
    p = np.full(len(some), 1 / SYMBOLS, np.float32)
    for k, (cell, gain, share) in enumerate(levels):
        own = context % CONTEXTS[k]
        want = (own * SYMBOLS + symbol).astype(np.int32)
        at = np.searchsorted(cell, want)
        hit = np.flatnonzero(np.append(cell, np.int32(-1))[at] == want)
        p *= share[own]
        p[hit] += gain[at[hit]]
    return np.log(p, out=p)


def log_spelled(words: list[bytes], log_p: np.ndarray) -> np.ndarray:
    """Log of the probability of each word under a spelling model."""
    if not words:
        return np.zeros(0)
    cell, bounds = cells(words)
    return np.add.reduceat(log_p[cell].astype(np.float64), bounds[:-1])


def spelled_by(words: list[bytes], samples: list) -> np.ndarray:
    """Log of what spelling adds to the probability of few words, averaged over the samples."""
    cell, bounds = cells(words)
    some, at = np.unique(cell, return_inverse=True)
    each = [math.log(rest) + np.add.reduceat(log_some(levels, some).astype(np.float64)[at], bounds[:-1]) for rest, levels in samples]
    return np.logaddexp.reduce(each, axis=0) - math.log(len(samples))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.full(len(words), END_HASH)
    h[np.array([w != END for w in words], bool)] = word_spans(b"\n".join(w for w in words if w != END) + b"\n", space_table())[0]
    return h


# --- words ------------------------------------------------------------------------------------


def count_words(blocks: DataFrame) -> DataFrame:
    """(word, n) over the marked documents of blocks, with one END each; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 20_000], pa.binary()), pa.array(n[at : at + 20_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for sizes, data, marks in zip(batch["sizes"], batch["data"], batch["marks"]):
                for text, m in zip(unpack(data.as_py(), sizes.values.to_numpy()), marks.as_py()):
                    if m:
                        held.update(text.lower().split())
                        held[END] += 1
                if len(held) > FLUSH:
                    yield from out()
        yield from out()

    rows = blocks.select("sizes", "data", "marks").mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The seated word restaurant: (word, n, gain) with n training tokens and what the word's customers
    and tables give it, averaged over all samples; what the samples' spelling models and restaurants say of any word."""

    rows: DataFrame
    samples: list

    def known(self):
        """A function of a batch of rows that gives their probabilities."""
        shared, held = self.rows.sparkSession.sparkContext.broadcast(self.samples), []

        def probability(pdf: pd.DataFrame) -> np.ndarray:
            if not held:
                held.extend((rest, log_cells(levels)) for rest, levels in shared.value)
            words = list(pdf["word"])
            return pdf["gain"].to_numpy(float) + np.mean([rest * np.exp(log_spelled(words, log_p)) for rest, log_p in held], axis=0)

        return probability


def _spelled_tables(rows: DataFrame) -> np.ndarray:
    """The customers that a word table's tables ``t`` are to each cell of the spelling model; cells are bounded, see above."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(CELLS, np.int64)
        for pdf in batches:
            cell, bounds = cells(list(pdf["word"]))
            np.add.at(held, cell, np.repeat(pdf["t"].to_numpy(np.int64), np.diff(bounds)))
        some = np.flatnonzero(held)
        for at in range(0, len(some), 1 << 17):
            yield pd.DataFrame({"cell": some[at : at + (1 << 17)], "n": held[some[at : at + (1 << 17)]]})

    got = rows.select("word", "t").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _spelling_model(held: np.ndarray, seed: int) -> list:
    cell = np.flatnonzero(held)
    return spelling(cell, held[cell], seed)


@dataclass
class Served:
    """A state of the word restaurant: (word, m, t) of words with more than one training token, all customers
    and tables, and the spelling model. It gives a word its predictive probability."""

    rows: DataFrame
    guests: int
    total: int
    discount: float
    levels: list

    def told(self, buckets: int, width: int) -> DataFrame:
        """(bucket, keys, m, t, s): ``s`` is what is left to the spelling, times its probability."""
        shared, rest = self.rows.sparkSession.sparkContext.broadcast(self.levels), (STRENGTH_WORDS + self.discount * self.total) / (STRENGTH_WORDS + self.guests)

        def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            log_p = log_cells(shared.value)
            for pdf in batches:
                words = list(pdf["word"])
                keys, s = wide(narrow(word_hashes(words), width), width), rest * np.exp(log_spelled(words, log_p))
                yield from dealt(keys, buckets, {"m": pdf["m"].to_numpy(np.int64), "t": pdf["t"].to_numpy(np.int64), "s": s})

        return self.rows.select("word", "m", "t").mapInPandas(tell, "bucket long, keys binary, m binary, t binary, s binary")


def without_own(m: np.ndarray, t: np.ndarray, s: np.ndarray, own: np.ndarray, guests: int, discount: float) -> np.ndarray:
    """The predictive probabilities of words of ``m`` customers at ``t`` tables when ``own`` of these customers are taken away."""
    m = np.maximum(m - own, 0)
    return (m - discount * np.minimum(t, m)) / np.maximum(STRENGTH_WORDS, STRENGTH_WORDS + guests - own) + s


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``rows`` rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def seat_words(rows: DataFrame, burn: int, samples: int, seed: int, reseat=None) -> Words:
    """Seat the customers ``m`` of each word of ``rows`` (word, n, m, more columns). Before each sweep but the
    first, ``reseat`` may seat the pairs on a state of this restaurant and gives the rows of that
    state with the customers these leave it. A word of one token has one table in every sweep, so the sweeps pass over the others alone."""
    spark = rows.sparkSession
    guests, kinds, singles, ones, twos = rows.agg(F.sum("m"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("m") == 1), F.count_if(F.col("m") == 2)).first()
    discount, total, found, lone_gain = discount_of(ones, twos), kinds, [], 0.0
    state = rows.select("*", F.col("m").alias("seated"), F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("gain"), F.lit(None).cast("binary").alias("path"))
    once, state = state.filter("n = 1"), state.filter("n > 1")
    lone = _spelled_tables(once)
    levels = _spelling_model(lone + _spelled_tables(state), seed)
    schema = state.schema
    for sweep in range(burn + samples):
        old = state
        if sweep and reseat:
            state = reseat(Served(state, guests, total, discount, levels), sweep)
            guests = singles + state.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        shared = spark.sparkContext.broadcast(levels)

        def sit(batches: Iterator[pd.DataFrame], sweep=sweep, total=total, guests=guests, shared=shared) -> Iterator[pd.DataFrame]:
            log_p = log_cells(shared.value)
            for pdf in gathered(batches, SEATED):
                words, m, t = list(pdf["word"]), pdf["m"].to_numpy(np.int64), pdf["t"].to_numpy(np.int64)
                rng = np.random.default_rng([seed, sweep, len(words), *np.frombuffer(words[0][:8].ljust(8, b"\0"), np.uint32).tolist(), int(m.sum())])
                paths = [x or b"" for x in pdf["path"]]
                row = np.repeat(np.arange(len(words)), [len(x) // 4 for x in paths])
                seats = Seating(pdf["seated"].to_numpy(np.int64), discount, rng, row, np.frombuffer(b"".join(paths), np.int32).astype(np.int64))
                base = np.exp(np.concatenate([log_spelled(words[at : at + 8192], log_p) for at in range(0, len(words), 8192)]))
                seats.change(m, total - t, base, STRENGTH_WORDS)
                seats.sweep(total - t, base, STRENGTH_WORDS, first=sweep == 0)
                t, path = seats.tables(), np.full(len(m), None, object)
                ends = np.cumsum(t - 1)
                at = seats.at.astype(np.int32)
                for i in np.flatnonzero(t > 1).tolist():
                    path[i] = at[ends[i] - t[i] + 1 : ends[i]].tobytes()
                gain = pdf["gain"].to_numpy(float) + (sweep >= burn) * (m - discount * t) / (STRENGTH_WORDS + guests) / samples
                yield pdf.assign(seated=m, t=t, gain=gain, path=path)

        state = materialize(state.select(schema.names).mapInPandas(sit, schema), "words")
        if sweep:
            forget(old)
        total = singles + state.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
        if sweep >= burn:
            found.append(((STRENGTH_WORDS + discount * total) / (STRENGTH_WORDS + guests), levels))
            lone_gain += (1 - discount) / (STRENGTH_WORDS + guests) / samples
        if sweep < burn + samples - 1:
            levels = _spelling_model(lone + _spelled_tables(state), seed + sweep + 1)
    seated = state.unionByName(once.withColumn("gain", F.lit(lone_gain)))
    return Words(seated.select("word", "n", "gain"), found)


# --- pairs ------------------------------------------------------------------------------------


@dataclass
class Hot:
    """The frequent contexts in order of hash, the parts each is dealt to, and the totals over these."""

    keys: np.ndarray
    parts: np.ndarray
    guests: np.ndarray
    opened: np.ndarray

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are hot, the place of these)."""
        at = np.minimum(np.searchsorted(self.keys, context), max(0, len(self.keys) - 1))
        hit = self.keys[at] == context if len(self.keys) else np.zeros(len(context), bool)
        return hit, at[hit]

    def groups(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        hit, at = self.find(context)
        out = context.copy()
        out[hit] = mix64(context[hit] + np.uint64(1) + word[hit] % self.parts[at])
        return out

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """(groups of hot contexts in order, the context of each)."""
        of = np.repeat(np.arange(len(self.keys)), self.parts.astype(np.int64))
        part = np.concatenate([np.zeros(0, np.uint64), *(np.arange(m, dtype=np.uint64) for m in self.parts.tolist())])
        group = mix64(self.keys[of] + np.uint64(1) + part)
        order = np.argsort(group)
        return group[order], of[order]


def hot_contexts(words: DataFrame, tokens: int) -> Hot:
    often = words.filter(F.col("n") > tokens / HOT).select("word", "n").collect()  # fewer than HOT
    keys = word_hashes([bytes(r["word"]) for r in often])
    order = np.argsort(keys)
    parts = np.array([-(-r["n"] * HOT // tokens) for r in often], np.uint64)[order]
    return Hot(keys[order], parts, np.zeros(len(keys)), np.zeros(len(keys)))


class Tokens:
    """The tokens of a block: which document, whether it is marked, context and word as places in the
    sorted distinct hashes ``keys``, END among them."""

    def __init__(self, texts: list[bytes], marks: bytes):
        parts, first = list(doc_words(texts, space_table())), 0
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, h, bounds in parts:
            hashes.append(np.insert(h, bounds[1:], END_HASH))
            docs.append(np.repeat(np.arange(first, first + len(bounds) - 1), np.diff(bounds) + 1))
        self.doc = np.concatenate(docs).astype(np.int32)
        self.keys, word = factors(np.concatenate(hashes))
        self.word, end = word.astype(np.int32), np.int32(np.searchsorted(self.keys, END_HASH))
        self.context = np.concatenate((np.array([end]), self.word[:-1])) if len(self.word) else self.word
        self.marked = np.frombuffer(marks, np.uint8)[self.doc]

    def pairs(self, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, context, word) of the distinct pairs in order of group, the latter as places in ``keys``, and the pair of each token."""
        width = max(1, len(self.keys))
        code, at = np.unique(self.context.astype(np.int64) * width + self.word, return_inverse=True)
        context, word = np.divmod(code, width)
        group = hot.groups(self.keys[context], self.keys[word])
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return group[order], context[order], word[order], place[at]


def heads_of(group: np.ndarray) -> np.ndarray:
    """Bounds of equal neighbours."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """The first ``width`` bytes of sorted hashes, byte by byte: the leading ones of neighbours are alike and compress."""
    return squeezed(np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T))


def unplaned(data: bytes, width: int = 8) -> np.ndarray:
    return wide(np.ascontiguousarray(unsqueezed([data], np.uint8).reshape(width, -1).T).tobytes(), width)


def narrow(words: np.ndarray, width: int) -> bytes:
    """The first ``width`` bytes of each hash."""
    return words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def wide(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.concatenate((raw, np.zeros((len(raw), 8 - width), np.uint8)), axis=1).copy().view(">u8").ravel().astype(np.uint64)


def thin(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: the leading ones of small numbers are alike and compress."""
    return squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T))


def thick(data: bytes, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(unsqueezed([data], np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def all_thick(parts, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(thick(x, kind) for x in parts)])


def factors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, the place of each value): only the distinct ones are sorted."""
    at, kinds = pd.factorize(values)
    order = np.argsort(kinds)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return kinds[order], rank[at]


def dealt(keys: np.ndarray, buckets: int, values: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """A row for each bucket of the keys, with the values of these."""
    order = np.argsort(keys)
    for k, a, b in cuts(keys[order], buckets):
        x = order[a:b]
        yield pd.DataFrame({"bucket": [k], "keys": [keys[x].tobytes()]} | {name: [v[x].tobytes()] for name, v in values.items()})


def look_up(asked: DataFrame, told: DataFrame, values: dict[str, type], width: int = 8) -> DataFrame:
    """(who, answers) for ``asked`` (bucket, who, keys): per bucket, in order, what ``told`` has under each key, 0 if it has none."""

    def answer(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in told["keys"])])
        order = np.argsort(keys)
        keys, have = np.append(keys[order], np.uint64(0)), {}
        for name, kind in values.items():
            v = np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in told[name])])
            have[name] = np.append(v[order], kind(0))
        out = []
        for k, who, x in zip(asked["bucket"], asked["who"], asked["keys"]):
            want = unplaned(x, width)
            at = np.searchsorted(keys[:-1], want)
            hit = keys[at] == want
            got = [np.where(hit, v[at], 0) for v in have.values()]
            out.append((who, k, *(thin(v) if v.dtype == np.int64 else squeezed(v.astype(np.float32)) for v in got)))
        return pd.DataFrame(out, columns=["who", "bucket", *values])

    schema = "who long, bucket long, " + ", ".join(f"{name} binary" for name in values)
    answers = asked.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(answer, schema)
    return answers.groupBy("who").agg(F.array_sort(F.collect_list(F.struct("bucket", *values))).alias("answers"))


@dataclass
class Dishes:
    """The dishes of a bucket in order of context and word: ``n`` customers each, runs of one context, the place of
    a hot one or -1 for each run. ``word`` is the place of each dish of two customers or more among the bucket's words of such dishes."""

    n: np.ndarray
    lengths: np.ndarray
    place: np.ndarray
    word: np.ndarray

    def __post_init__(self):
        self.of, self.many = np.repeat(np.arange(len(self.lengths)), self.lengths), np.flatnonzero(self.n > 1)
        self.discount = discount_of(int((self.n == 1).sum()), int((self.n == 2).sum()))

    @classmethod
    def read(cls, row) -> Dishes:
        return cls(*(thick(row[c]) for c in ("n", "lengths", "place", "word")))

    def spread(self, t: np.ndarray, each: int = 1) -> np.ndarray:
        """The tables of all dishes, where those of two customers or more have ``t``."""
        out = each * (self.n > 0)
        out[self.many] = t
        return out

    def others(self, t: np.ndarray, hot: Hot) -> np.ndarray:
        """The tables of all other dishes in the restaurants of ``many``; a part of a hot context stands for all its parts."""
        number = np.ones(len(self.lengths))
        number[self.place >= 0] = hot.parts[self.place[self.place >= 0]]
        return (number * np.bincount(self.of, self.spread(t), len(self.lengths)))[self.of[self.many]] - t

    def seated(self, seats: Seating, sum_t: np.ndarray) -> dict[str, bytes]:
        t = np.bincount(self.word, seats.tables(), int(self.word.max(initial=-1)) + 1).astype(np.int64)
        return {"row": thin(seats.row), "at": thin(seats.at), "sum_t": thin(sum_t), "t": thin(t)}


#: Rows of a bucket: its dishes and their tables, and the blocks with the dishes that each asks for; or, without ``n``,
#: the words ``keys`` of dishes of one customer with as many tables ``t``. Below zero, distinct words ``keys`` of a block.
PAIRS = "bucket long, block long, keys binary, t binary, n binary, lengths binary, place binary, word binary, row binary, at binary, sum_t binary, blocks binary, ends binary, gaps binary"


def gather_pairs(blocks: DataFrame, hot: Hot, buckets: int, word_buckets: int, width: int, burn: int, seed: int) -> DataFrame:
    """The dishes of the pairs of all blocks in buckets, see PAIRS. For want of a word restaurant, whose
    customers are these dishes' tables, they are first seated on the words' shares of the bucket.

    The distinct words of a block, cut into ``word_buckets``, come along in buckets below zero, so that blocks are read once for both.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, sizes, data, marks in zip(pdf["block"], pdf["sizes"], pdf["data"], pdf["marks"]):
                tokens = Tokens(unpack(data, sizes), marks)
                group, _, word, at = tokens.pairs(hot)
                word, n = tokens.keys[word], np.bincount(at, tokens.marked, len(word)).astype(np.int32)
                rows = [(-1 - k, block, b"", b"", planes(tokens.keys[a:b]), b"") for k, a, b in cuts(tokens.keys, word_buckets)]
                for k, a, b in cuts(group, buckets):
                    at = heads_of(group[a:b])
                    rows.append((k, block, planes(group[a:b][at[:-1]], width), thin(np.diff(at).astype(np.int32)), narrow(word[a:b], width), thin(n[a:b])))
                yield pd.DataFrame(rows, columns=["bucket", "block", "groups", "lengths", "words", "n"])

    names = [c.split()[0] for c in PAIRS.split(", ")]

    def sit(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            return pd.DataFrame({"bucket": bucket, "block": pdf["block"], "keys": pdf["words"]}).reindex(columns=names).astype({c: object for c in names[3:]}).where(lambda x: x.notna(), None)
        lengths, groups = all_thick(pdf["lengths"], np.int32), [unplaned(x, width) for x in pdf["groups"]]
        ends = np.cumsum([len(x) // width for x in pdf["words"]])
        groups, of_run = factors(np.concatenate(groups))
        kinds, word = factors(np.concatenate([wide(x, width) for x in pdf["words"]]))
        # Dishes are the distinct pairs; those that no marked text holds have no customers.
        code, at = np.unique(np.repeat(of_run, lengths) * len(kinds) + word, return_inverse=True)
        of, word = np.divmod(code, len(kinds))
        n = np.bincount(at, all_thick(pdf["n"], np.int32), len(code)).astype(np.int64)
        shares = np.bincount(word, n, len(kinds))
        hot_groups, owner = hot.owners()
        hot_groups = wide(narrow(hot_groups, width), width)
        place = np.full(len(groups), -1)
        if len(hot_groups):
            found = np.minimum(np.searchsorted(hot_groups, groups), len(hot_groups) - 1)
            place = np.where(hot_groups[found] == groups, owner[found], -1)
        mine, index = np.unique(word[n > 1], return_inverse=True)
        dishes = Dishes(n, np.bincount(of, minlength=len(groups)), place, index)
        seats, t = Seating(n[dishes.many], dishes.discount, np.random.default_rng([seed, len(code), int(n.sum())])), np.ones(len(dishes.many), np.int64)
        seats.sweep(dishes.others(t, hot), (shares / max(1.0, shares.sum()))[word[dishes.many]], STRENGTH_PAIRS, first=True)
        row = {"bucket": bucket, "block": None, "keys": planes(kinds[mine], width), "n": thin(n), "lengths": thin(dishes.lengths), "place": thin(place), "word": thin(index)}
        row |= dishes.seated(seats, seats.tables() * (burn == 0))
        row |= {"blocks": thin(pdf["block"].to_numpy(np.int64)), "ends": thin(ends), "gaps": thin(np.diff(at, prepend=0).astype(np.int32))}
        single = np.bincount(word[n == 1], minlength=len(kinds))
        some = np.flatnonzero(single)
        out = pd.DataFrame([row, {"bucket": bucket, "block": None, "keys": planes(kinds[some], width), "t": thin(single[some])}], columns=names)
        out["block"] = out["block"].astype("Int64")
        return out.astype({c: object for c in names[2:]}).where(lambda x: x.notna(), None)

    asked = blocks.select("block", "sizes", "data", "marks").mapInPandas(ask, "bucket long, block long, groups binary, lengths binary, words binary, n binary")
    return materialize(asked.groupBy("bucket").applyInPandas(sit, PAIRS), "pairs")


def seat_pairs(pairs: DataFrame, served: Served, hot: Hot, word_buckets: int, width: int, sample: bool, sweep: int, seed: int) -> DataFrame:
    """Seat the pairs anew, each on the predictive probability that the word restaurant gives its word without the pair's own tables."""
    guests, discount = served.guests, served.discount

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, x in zip(pdf["bucket"], pdf["keys"]):
                keys = unplaned(x, width)
                rows = [(k, bucket, planes(keys[a:b], width)) for k, a, b in cuts(keys, word_buckets)]
                yield pd.DataFrame(rows, columns=["bucket", "who", "keys"])

    def sit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i].to_dict()
                dishes, told = Dishes.read(row), row.pop("answers")
                told = told if told is not None else []
                m, t, s = all_thick(x["m"] for x in told), all_thick(x["t"] for x in told), unsqueezed((x["s"] for x in told), np.float32).astype(np.float64)
                seats = Seating(dishes.n[dishes.many], dishes.discount, np.random.default_rng([seed, sweep, int(row["bucket"])]), thick(row["row"]), thick(row["at"]))
                own, word = seats.tables(), dishes.word
                seats.sweep(dishes.others(own, hot), without_own(m[word], t[word], s[word], own, guests, discount), STRENGTH_PAIRS)
                row |= dishes.seated(seats, thick(row["sum_t"]) + sample * seats.tables())
                out = pd.DataFrame([row])
                out["block"] = pd.array([None], dtype="Int64")
                yield out

    dishes = pairs.filter("n is not null")
    asked = dishes.select("bucket", "keys").mapInPandas(ask, "bucket long, who long, keys binary")
    answers = look_up(asked, served.told(word_buckets, width), {"m": np.int64, "t": np.int64, "s": np.float64}, width)
    again = dishes.join(answers.withColumnRenamed("who", "bucket"), "bucket", "left").mapInPandas(sit, PAIRS)
    return materialize(again.unionByName(pairs.filter("bucket < 0")), "pairs")


def add_hot(pairs: DataFrame, hot: Hot, samples: int) -> Hot:
    """The totals of hot contexts over all buckets; a bucket's are fewer than HOT."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                dishes = Dishes.read(row)
                opened = dishes.discount * np.bincount(dishes.of, dishes.spread(thick(row["sum_t"]), samples), len(dishes.lengths)) / samples
                is_hot = dishes.place >= 0
                yield pd.DataFrame({"i": dishes.place[is_hot], "guests": np.bincount(dishes.of, dishes.n, len(is_hot))[is_hot], "opened": opened[is_hot]})

    sums = pairs.filter("n is not null").select("n", "lengths", "place", "word", "sum_t").mapInPandas(total, "i long, guests double, opened double")
    for r in sums.groupBy("i").agg(F.sum("guests").alias("guests"), F.sum("opened").alias("opened")).collect():
        hot.guests[r["i"]], hot.opened[r["i"]] = r["guests"], r["opened"]
    return hot


def tables_of(pairs: DataFrame, width: int) -> DataFrame:
    """(h, single, m): the tables of the pair restaurants that serve a word, those of dishes of one customer and all."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, t, n in zip(pdf["keys"], pdf["t"], pdf["n"]):
                m = thick(t)
                yield pd.DataFrame({"h": unplaned(keys, width).view(np.int64), "single": m * (n is None), "m": m})

    told = pairs.filter("bucket >= 0").select("keys", "t", F.when(F.col("n").isNotNull(), F.lit(1)).cast("string").alias("n"))
    return told.mapInPandas(tables, "h long, single long, m long").groupBy("h").agg(F.sum("single").alias("single"), F.sum("m").alias("m"))


def with_tables(words: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(word, n, h, single, m): ``m`` are the tables of the pair restaurants that serve the word."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = wide(narrow(word_hashes(list(pdf["word"])), width), width)
            yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "h": h.view(np.int64)})

    rows = words.mapInPandas(hashed, "word binary, n long, h long").join(tables_of(pairs, width), "h")
    return materialize(rows.select("word", "n", "h", "single", "m"), "words")


def learn(blocks: DataFrame, counts: DataFrame, hot: Hot, buckets: int, word_buckets: int, width: int, burn: int, samples: int, seed: int) -> tuple[DataFrame, Words]:
    """The pairs and the words after all sweeps, each of which seats both: pairs on the words' probabilities, words on the pairs' tables."""
    pairs = gather_pairs(blocks, hot, buckets, word_buckets, width, burn, seed)
    release(blocks.sparkSession)
    if not counts.head(1):
        uniform = spelling(np.zeros(0, np.int64), np.zeros(0, np.int64), seed)
        return pairs, Words(counts.select("word", "n", F.lit(0.0).alias("gain")), [(1.0, uniform)])
    rows = with_tables(counts, pairs, width)
    forget(counts)
    release(blocks.sparkSession)

    def reseat(served: Served, sweep: int) -> DataFrame:
        nonlocal pairs
        release(blocks.sparkSession)  # a query that has only just ended may still be held when it is called
        old, pairs = pairs, seat_pairs(pairs, served, hot, word_buckets, width, sweep >= burn, sweep, seed)
        forget(old)
        release(blocks.sparkSession)
        now = tables_of(pairs, width).select("h", F.col("m").alias("now"))
        return served.rows.join(now, "h", "left").withColumn("m", F.col("single") + F.coalesce("now", F.lit(0)))

    words = seat_words(rows, burn, samples, seed, reseat)
    return pairs, words


# --- scores -----------------------------------------------------------------------------------


def word_answers(pairs: DataFrame, words: Words, buckets: int) -> DataFrame:
    """(block, answers): per bucket the training count and the probability of each of the block's distinct words, 0 if not known."""
    probability = words.known()

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from dealt(word_hashes(list(pdf["word"])), buckets, {"n": pdf["n"].to_numpy(np.int64), "p": probability(pdf)})

    asked = pairs.filter("bucket < 0").select((-1 - F.col("bucket")).alias("bucket"), F.col("block").alias("who"), "keys")
    told = words.rows.mapInPandas(known, "bucket long, keys binary, n binary, p binary")
    return look_up(asked, told, {"n": np.int64, "p": np.float64}).withColumnRenamed("who", "block")


def pair_answers(pairs: DataFrame, samples: int) -> DataFrame:
    """(block, pairs): per bucket the discount, the customers and tables of each of the block's pairs in order,
    and those of each run of a context. Tables are of all samples."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                dishes, at = Dishes.read(row), np.cumsum(thick(row["gaps"], np.int32), dtype=np.int64)
                t = dishes.spread(thick(row["sum_t"]), samples).astype(np.int64)
                guests, opened = (np.bincount(dishes.of, x, len(dishes.lengths)).astype(np.int64) for x in (dishes.n, t))
                ends, out = np.append(0, thick(row["ends"])), []
                for i, block in enumerate(thick(row["blocks"]).tolist()):
                    mine = at[ends[i] : ends[i + 1]]
                    run = dishes.of[mine]
                    run = run[heads_of(run)[:-1]]
                    out.append((block, row["bucket"], dishes.discount, thin(dishes.n[mine]), thin(t[mine]), thin(guests[run]), thin(opened[run])))
                yield pd.DataFrame(out, columns=["block", "bucket", "discount", "n", "t", "guests", "opened"])

    rows = pairs.filter("n is not null").select("bucket", "n", "lengths", "place", "word", "sum_t", "blocks", "ends", "gaps")
    told = rows.mapInPandas(tell, "block long, bucket long, discount double, n binary, t binary, guests binary, opened binary")
    return told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "discount", "n", "t", "guests", "opened"))).alias("pairs"))


def learn_and_score(docs: DataFrame, train: str, text_col: str = "text", burn: int = BURN, samples: int = SAMPLES, seed: int = 0, pair_bucket_bytes: int = PAIR_BUCKET_BYTES, word_bucket_bytes: int = WORD_BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``, by a
    model of those rows of which the boolean column ``train`` is true (null is false).

    base_score is the add-one unigram log10 probability, score the model's. A null
    or empty text has the END token only. Rows that repeat a doc_id are documents
    of their own, null ids included. Without training rows every word has the
    probability that a uniform spelling gives it. No row of ``docs`` gives no rows.
    """
    blocks = text_blocks(docs.select("doc_id", F.col(text_col).alias("text"), F.col(train).alias("train")), name="lm", mark="train")
    size = text_bytes(blocks)
    pair_buckets, word_buckets = max(1, -(-size // pair_bucket_bytes)), max(1, -(-size // word_bucket_bytes))
    counts = materialize(count_words(blocks), "counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    width = min(8, max(4, math.ceil((2 * math.log2(max(2, kinds)) - 1) / 8)))
    hot = hot_contexts(counts, tokens)
    release(docs.sparkSession)
    pairs, words = learn(blocks, counts, hot, pair_buckets, word_buckets, width, burn, samples, seed)
    hot = add_hot(pairs, hot, samples)
    shared = docs.sparkSession.sparkContext.broadcast(words.samples)
    release(docs.sparkSession)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, sizes, data, marks, told, more in zip(pdf["ids"], pdf["sizes"], pdf["data"], pdf["marks"], pdf["answers"], pdf["pairs"]):
                texts = unpack(data, sizes)
                block = Tokens(texts, marks)
                n, p = all_thick(x["n"] for x in told), unsqueezed((x["p"] for x in told), np.float32).astype(np.float64)
                new, log_p = n == 0, np.log10(np.where(n > 0, p, 1.0))
                if new.any():  # a long word's probability is too small for a number
                    few = [texts[i] for i in np.unique(block.doc[new[block.word]]).tolist()]
                    log_p[new] = spelled_by(_spelling_of(few, block.keys[new]), shared.value) / math.log(10)
                base = np.log10((n + 1) / (tokens + kinds + 1))
                group, context, word, at = block.pairs(hot)
                runs = wide(narrow(group, width), width)  # as the buckets know them
                runs = np.cumsum(np.concatenate(([False], runs[1:] != runs[:-1]))) if len(runs) else np.zeros(0, np.int64)
                parts = [thick(x["n"]) for x in more]
                discount = np.repeat([x["discount"] for x in more], [len(x) for x in parts]) / samples
                gain = np.concatenate([np.zeros(0), *parts]) - discount * all_thick(x["t"] for x in more)
                guests, opened = all_thick(x["guests"] for x in more)[runs].astype(np.float64), all_thick(x["opened"] for x in more)[runs] * discount
                hit, where = hot.find(block.keys)
                often, place = hit[context], np.zeros(len(hit), np.int64)
                place[hit] = where
                where = place[context[often]]
                guests[often], opened[often] = hot.guests[where], hot.opened[where]
                gain, share = gain / (STRENGTH_PAIRS + guests), (STRENGTH_PAIRS + opened) / (STRENGTH_PAIRS + guests)
                # A pair without gain has the parent's share alone; so have all pairs of an unseen word.
                score = log_p[word] + np.log10(share)
                seen = np.flatnonzero(gain > 0)
                score[seen] = np.log10(gain[seen] + share[seen] * p[word[seen]])
                sums = [np.bincount(block.doc, x, len(texts)) for x in (np.ones(len(at)), n[block.word] > 0, base[block.word], score[at])]
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "train_tokens": int(tokens), "base_score": sums[2], "score": sums[3]})

    rows = blocks.join(word_answers(pairs, words, word_buckets), "block").join(pair_answers(pairs, samples), "block").select("ids", "sizes", "data", "marks", "answers", "pairs")
    return rows.mapInPandas(tell, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _spelling_of(texts: list[bytes], hashes: np.ndarray) -> list[bytes]:
    """The words of ``texts`` that have these hashes, in order."""
    out, data = {}, b"\n".join(texts).lower() + b"\n"
    h, start, end = word_spans(data, space_table())
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    found = np.flatnonzero(hashes[at] == h)
    for i in found[np.unique(at[found], return_index=True)[1]].tolist():
        out[int(at[i])] = data[start[i] : end[i]]
    return [out.get(k, END) for k in range(len(hashes))]
