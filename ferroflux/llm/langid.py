"""Language identification with language-bitmask n-gram filters.

Letter n-grams are counted per language over all training documents. An n-gram
belongs to each language in which it is at least ``belongs`` times as frequent
as in its most typical language. All languages share one bit-sliced Bloom
filter: position i holds a bitmask of the languages whose filter has bit i, so
the AND of an n-gram's k positions gives every language containing it. The
popcounts of a document per language, corrected for each language's
false-positive rate, decide.

No n-gram is left out. A filter holds up to ``SLICE`` n-grams; of more, slices by
hash are made, and as many passes over the documents add up their popcounts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cached, fresh, materialize, mix64, quoted

ORDERS = (3, 4)
HASHES = 3
#: N-grams of one slice of the filter, at most on average; bounds what is sent to all tasks.
SLICE = 1 << 21
BELONGS = 0.5
#: Distinct n-grams that a task holds before it passes its counts on.
FLUSH = 1 << 21


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for what is no letter."""

    def build():
        table = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                table[i] = ord(chr(i).lower()[0])
        return table

    return cached("fold", build)


def _grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, n-gram hashes, document of each) of runs of documents."""
    fold, i = _fold_table(), 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < 1 << 19):
            size += len(texts[j])
            j += 1
        raw = np.frombuffer(("\n" + "\n".join(texts[i:j]) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        owner = np.repeat(np.arange(i, j), [len(t) + 1 for t in texts[i:j]])
        owner = np.concatenate((owner[:1], owner))
        a = fold[raw]
        gap = a == 32
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep[0] = True  # the first document of a run begins after a gap as the others do
        a, owner = a[keep].astype(np.uint64), owner[keep]
        gap = a == 32
        hashes, owners = [], []
        for n in ORDERS:
            m = len(a) - n + 1
            if m <= 0:
                continue
            inner = np.ones(m, dtype=bool)
            for k in range(1, n - 1):
                inner &= ~gap[k : k + m]
            at = np.flatnonzero(inner)
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x1F3D5B79A6E2C48B) + a[at + k]
            hashes.append(h)
            owners.append(owner[at + 1])
        if hashes:
            yield i, j, np.concatenate(hashes), np.concatenate(owners)
        i = j


@dataclass
class Filter:
    languages: list[str]
    prior: np.ndarray
    #: (gram, word, mask, slice): the languages of every n-gram, 63 to a word.
    masks: DataFrame | None
    slices: int


def _positions(grams: np.ndarray, k: int, size: int) -> np.ndarray:
    h = mix64(grams)
    step = mix64(h) | np.uint64(1)
    return ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all given documents; tasks add up before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def out() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                keys, n = merged(parts)
                for at in range(0, len(keys), 1 << 16):
                    yield pd.DataFrame({"lang": lang, "gram": keys[at : at + (1 << 16)].view(np.int64), "n": n[at : at + (1 << 16)]})
            held.clear()

        for pdf in batches:
            for lang, part in pdf.groupby("lang", sort=False):
                for _, _, grams, _ in _grams([t or "" for t in part["text"]]):
                    keys, n = np.unique(grams, return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((keys, n))
                    if len(parts) > 16:
                        held[lang] = [merged(parts)]
            if sum(len(p[0]) for parts in held.values() for p in parts) > FLUSH:
                yield from out()
        yield from out()

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", belongs: float = BELONGS, slice_grams: int = SLICE) -> Filter:
    """The filter of all languages in ``docs`` (rows with null text or language don't count)."""
    counts = materialize(gram_counts(docs, lang_col, text_col), "grams")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filter([], np.zeros(0), None, 0)
    total = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(totals[lang]))])
    index = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    shares = counts.withColumn("share", F.col("n") / F.element_at(total, F.col("lang"))).withColumn("i", F.element_at(index, F.col("lang")))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    member = shares.join(best, "gram").filter(F.col("share") >= belongs * F.col("best"))
    masks = materialize(member.groupBy("gram", F.floor(F.col("i") / 63).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(i % 63)))").alias("mask")), "masks")
    slices = max(1, -(-masks.count() // slice_grams))
    prior = np.array([totals[x] for x in languages], dtype=float)
    return Filter(languages, prior / prior.sum(), masks.withColumn("slice", F.pmod("gram", F.lit(slices))), slices)


def _slice(model: Filter, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, false-positive rate of each language) of a slice: a bitmask of the languages per position and word."""
    got = model.masks.filter(F.col("slice") == at).toPandas()
    size = 1 << max(12, (8 * max(1, len(got)) - 1).bit_length())
    table = np.zeros((size, -(-len(model.languages) // 63)), dtype=np.uint64)
    grams, word, mask = got["gram"].to_numpy(np.int64).view(np.uint64), got["word"].to_numpy(np.int64), got["mask"].to_numpy(np.int64).view(np.uint64)
    for k in range(HASHES):
        np.bitwise_or.at(table, (_positions(grams, k, size), word), mask)
    fill = np.array([((table[:, i // 63] >> np.uint64(i % 63)) & np.uint64(1)).mean() for i in range(len(model.languages))])
    return table, fill**HASHES


def predict(docs: DataFrame, model: Filter, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """Add lang_pred and lang_score, or what ``names`` calls them, to ``docs``.

    lang_pred is ``und`` (score 0) if the text is null or holds no letter, or if
    no language was learned. lang_score is the false-positive-corrected share of
    the text's n-grams that the language contains; ties go to the language with
    more training text, then to the first by name. Each row counts for itself,
    whatever its doc_id. Own columns of these names are replaced, others stay; an
    empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    held = fresh("hits", columns)
    rows = docs.select(*map(quoted, columns), F.lit(None).cast("array<double>").alias(held))
    for at in range(model.slices - 1):
        # One slice is sent out at a time, so each pass is stored before the next.
        rows = materialize(_pass(rows, model, at, text_col, held), "hits")
    told = fresh("told", columns)
    done = _pass(rows, model, max(0, model.slices - 1), text_col, held, told)
    return done.select(*map(quoted, columns), F.col(f"{told}.lang_pred").alias(names[0]), F.col(f"{told}.lang_score").alias(names[1]))


def _pass(rows: DataFrame, model: Filter, number: int, text_col: str, held: str, told_as: str | None = None) -> DataFrame:
    """Add a slice's corrected popcounts to ``held`` (each language's, then what each could reach); the last pass decides, as ``told_as``."""
    last = told_as is not None
    n_lang, slices, names_of, prior = len(model.languages), model.slices, model.languages, model.prior
    shared = rows.sparkSession.sparkContext.broadcast(_slice(model, number) if n_lang else None)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table, fp = shared.value if n_lang else (np.zeros((1, 1), np.uint64), np.zeros(0))
        size = len(table)
        narrow = table[:, 0].astype(np.uint8) if n_lang <= 8 else None
        for column, before in batches:
            texts = [t if isinstance(t, str) else "" for t in column]
            hits, n = np.zeros((len(texts), n_lang)), np.zeros(len(texts))
            for i, j, grams, owner in _grams(texts):
                if slices > 1:
                    mine = grams.view(np.int64) % slices == number
                    grams, owner = grams[mine], owner[mine]
                n[i:j] += np.bincount(owner - i, minlength=j - i)
                at = [_positions(grams, k, size) for k in range(HASHES)]
                if narrow is not None:
                    mask = narrow[at[0]] & narrow[at[1]] & narrow[at[2]]
                    cells = np.bincount((owner - i) * 256 + mask, minlength=(j - i) * 256).reshape(j - i, 256)
                    bits = (np.arange(256)[:, None] >> np.arange(n_lang)) & 1
                    hits[i:j] += cells @ bits
                else:
                    mask = table[at[0]] & table[at[1]] & table[at[2]]
                    for lang in range(n_lang):
                        bit = (mask[:, lang // 63] >> np.uint64(lang % 63)) & np.uint64(1)
                        hits[i:j, lang] += np.bincount(owner - i, bit, j - i)
            sums = np.concatenate((hits - fp * n[:, None], n[:, None] * (1 - np.minimum(fp, 0.99))), axis=1)
            if number:
                sums += np.stack([np.asarray(x, float) for x in before])
            if not last:
                yield pd.Series(list(sums))
                continue
            letters = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
            if n_lang:
                share = np.clip(sums[:, :n_lang] / np.maximum(1e-9, sums[:, n_lang:]), 0, 1)
                best = np.argmax(np.round(share, 12) + 1e-9 * prior, axis=1)
                top = share[np.arange(len(texts)), best]
                names = np.array(names_of, dtype=object)[best]
            else:
                top, names = np.zeros(len(texts)), np.full(len(texts), "und", dtype=object)
            yield pd.DataFrame({"lang_pred": np.where(letters, names, "und"), "lang_score": np.where(letters, top, 0.0)})

    told = F.pandas_udf(score, "lang_pred string, lang_score double" if last else "array<double>")
    kept = [quoted(c) for c in rows.columns if c != held]
    return rows.select(*kept, told(F.col(quoted(text_col)), F.col(held)).alias(told_as or held))
