"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon entries (words and word beginnings found in the labelled
rows, and a fixed list of insults), patterns of writing, and the labels
themselves, a voter like the others, which may be wrong. The label model is one likelihood:
a document is toxic or clean, a voter votes or abstains by a law of its own for each, and a voter
that leans on another one repeats its vote with some probability. EM estimates the share of toxic
documents, all laws, and so the accuracies, and all these correlations together. A logistic regression over
words and word beginnings is trained on the posterior labels. Only the training
rows are sampled, up to ``sample`` of them; every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

#: Labelled rows that the models are fitted on, at most; those with the smallest hash of their id.
SAMPLE = 12_000
FEATURES = 1024
VOTERS = 48
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: Insults that vote for toxic.
INSULTS = frozenset("bastard creep cretin dimwit disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash ugly vermin worthless".split())
_WORD = re.compile(r"\w+")
_ADDRESS = re.compile(r"\b(?:you|your|u r|du bist|eres|tu es)\b")


def features(text: str | None) -> set[str]:
    """Words of a lower-cased text, and beginnings of longer words: with a star, with two if several words have it."""
    words = set(_WORD.findall(text.lower())) if text else set()
    begins = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
    return words | {f"{b}*" for b in begins} | {f"{b}**" for b, n in begins.items() if n > 1}


def _shouts(text: str, width: int = 2000) -> bool:
    """Whether over half of the letters of the text, or of any run of ``width`` characters in it, are capitals."""
    upper, letters = (np.concatenate(([0], np.cumsum(np.fromiter(map(f, text), bool, len(text))))) for f in (str.isupper, str.isalpha))
    return any(bool((u[k:] - u[:-k] > 0.5 * np.maximum(20, n[k:] - n[:-k])).any()) for u, n in ((upper, letters),) for k in {len(text), min(width, len(text))} if k)


def pattern_votes(text: str | None) -> list[int]:
    """Votes of the fixed voters: 1 toxic, -1 clean, 0 none."""
    text = text or ""
    low = text.lower()
    words = set(_WORD.findall(low))
    insults = len(words & INSULTS)
    return [1 if insults else 0, 1 if insults > 1 else 0, 1 if insults and _ADDRESS.search(low) else 0, 1 if _shouts(text) else 0, 1 if "!!" in text else 0, -1 if not words else 0]


@dataclass
class LabelModel:
    """Share of toxic, each voter's law P(vote | class) over -1, 0, 1, the voter it leans on (-1: none) and how often it repeats what that one does, abstaining too."""

    prior: float
    law: np.ndarray  # (voter, class, vote + 1)
    parents: np.ndarray
    correlation: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """Of the votes that each voter casts by itself, the share that is right."""
        cast = self.law[:, :, [0, 2]] * np.array([1 - self.prior, self.prior])[None, :, None]
        return (cast[:, 0, 0] + cast[:, 1, 1]) / cast.sum(axis=(1, 2))

    def terms(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, voter, class): the likelihood of each vote, and how likely it is a repeated one."""
        own = self.law[np.arange(votes.shape[1])[None, :, None], np.arange(2)[None, None, :], votes[:, :, None] + 1]
        repeats = self.correlation * (votes == votes[:, self.parents])  # 0 for voters that lean on none
        whole = repeats[:, :, None] + (1 - self.correlation)[None, :, None] * own
        return whole, repeats[:, :, None] / whole

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        z = np.log(self.terms(votes)[0]).sum(axis=1) @ np.array([-1.0, 1.0]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cover(x: np.ndarray, toxic: np.ndarray, most: int) -> list[int]:
    """Features that vote for toxic: each time the one that finds most toxic rows not found yet, clean rows counting tenfold against it."""
    wrong, open_, out = 10 * x[~toxic].sum(axis=0), x[toxic].copy(), []
    while len(out) < most:
        gain = open_.sum(axis=0) - wrong
        best = int(np.argmax(gain))
        if gain[best] < 2:
            # All that can be found is found: the next entries find rows a second time.
            if not out or len(open_) == toxic.sum():
                return out
            open_ = x[toxic].copy()
            open_[:, out] = 0
            continue
        out.append(best)
        open_ = open_[open_[:, best] == 0]
        wrong[best] = np.inf
    return out


#: Votes -1, 0, 1 that every voter is taken to have given in each class before any is seen: more right than wrong ones.
_BEFORE = np.array([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5]])


def fit_labels(votes: np.ndarray, rounds: int = 30) -> LabelModel:
    """EM over ``votes`` (rows, voters) in -1, 0, 1, from the majority of each row's votes.

    First without correlations; then each voter may lean on the one before it whose votes it repeats
    beyond what the classes explain, if that gains more likelihood than a further parameter
    costs (Schwarz), and all parameters are estimated anew together.
    """
    n, voters = votes.shape
    each = [votes == v for v in (-1, 0, 1)]
    p = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.tile(_BEFORE / _BEFORE.sum(axis=1, keepdims=True), (voters, 1, 1)), np.full(voters, -1), np.zeros(voters))
    for phase in range(2):
        for _ in range(rounds):
            both = np.stack((1 - p, p), axis=1)
            repeated = model.terms(votes)[1]
            alone = both[:, None, :] * (1 - repeated)
            law = np.stack([(alone * x[:, :, None]).sum(axis=0) for x in each], axis=2) + _BEFORE[None]
            correlation = ((both[:, None, :] * repeated).sum(axis=(0, 2)) + 0.1) / (n + 1.0)
            model = LabelModel(float((p.sum() + 1) / (n + 2)), law / law.sum(axis=2, keepdims=True), model.parents, np.where(model.parents >= 0, np.clip(correlation, 0.0, 0.98), 0.0))
            p = model.posterior(votes)
        if phase == 0:
            share, law = np.array([(1 - p).sum(), p.sum()]), model.law
            parents, start = np.full(voters, -1), np.zeros(voters)
            for j in range(1, voters):
                # Of the rows in which either voter casts a vote, the part in which both cast the same one, and what the classes let expect.
                size = ((votes[:, :j] != 0) | (votes[:, [j]] != 0)).sum(axis=0)
                same = ((votes[:, :j] != 0) & (votes[:, :j] == votes[:, [j]])).sum(axis=0) / np.maximum(size, 1)
                alike = ((law[:j] * law[j])[:, :, [0, 2]].sum(axis=2) * share).sum(axis=1)
                expected = alike / ((1 - law[:j, :, 1] * law[j, :, 1]) * share).sum(axis=1)
                same, expected = np.clip(same, 1e-6, 1 - 1e-6), np.clip(expected, 1e-6, 1 - 1e-6)
                gain = np.where(same > expected, size * (same * np.log(same / expected) + (1 - same) * np.log((1 - same) / (1 - expected))), 0.0)
                best = int(np.argmax(gain))
                if gain[best] > np.log(max(2, n)):
                    parents[j], start[j] = best, min(0.9, (same[best] - expected[best]) / (1 - expected[best]))
            model = LabelModel(model.prior, model.law, parents, start)
    return model


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by accelerated gradients."""
    n = len(x)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature bounds the step
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-9)
    rate = 4 * n / (1.2 * top + n + 4 * ridge)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for i in range(rounds):
        gap = 1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30))) - target
        step = v - rate * np.append(x.T @ gap + ridge * v[:-1], gap.sum()).astype(np.float32) / n
        w, v = step, step + i / (i + 3) * (step - w)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    voters: list[str]
    accuracies: list[float]
    parents: list[int]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES, n_voters: int = VOTERS) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Labels that are null or neither 0 nor 1 don't count; of several labels of a
    document the largest does. Rows that repeat a doc_id are each learned from, with its
    label; those of a null one have none. Null and empty texts vote clean. Equal
    hashes and strengths go by doc_id and feature. Without labels of both classes, an empty table
    among them, all documents get the share of toxic labels, or 0, as their score.
    Other columns, whatever their names, are not read. ``n_features`` and ``n_voters`` set the
    size of the model, not what is read: every feature of the sample is counted.
    """
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, thus broadcast
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "labelled")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        share = toxic / total if total else 0.0
        return Model({}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), [], [], [])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                held[toxic].update(features(text))
            if len(held[0]) + len(held[1]) > 400_000:
                yield from out(held)
        yield from out(held)

    def out(held: tuple[Counter, Counter]) -> Iterator[pd.DataFrame]:
        keys = list(held[0].keys() | held[1].keys())
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pd.DataFrame({"feature": part, "clean": [held[0][k] for k in part], "toxic": [held[1][k] for k in part]})
        for h in held:
            h.clear()

    counts = rows.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, a, b = F.col("clean") + F.col("toxic"), F.col("toxic").cast("double"), F.col("clean").cast("double")
    gap = a * (total - toxic) - b * toxic
    strength = gap * F.abs(gap) / (n * (total - n + 1))
    best = counts.filter(n >= min(4, max(2, toxic // 10))).select("feature", "clean", "toxic", strength.alias("strength"))
    best = best.orderBy(F.abs("strength").desc(), "feature").limit(n_features).collect()
    names = [r["feature"] for r in best]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {f: i for i, f in enumerate(names)}
        for pdf in batches:
            held = [sorted(index[f] for f in features(t) if f in index) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "held": held, "votes": [pattern_votes(t) for t in pdf["text"]]})

    got = rows.mapInPandas(place, "toxic int, held array<int>, votes array<int>").toPandas()
    x = np.zeros((len(got), len(names)), np.float32)
    for i, held in enumerate(got["held"]):
        x[i, np.asarray(held, np.int64)] = 1
    lexicon = cover(x, got["toxic"].to_numpy() == 1, n_voters)
    found = x[:, lexicon].astype(np.int64)
    fixed = np.array(got["votes"].tolist(), np.int64)
    label = np.where(got["toxic"] == 1, 1, -1)[:, None]
    votes = np.concatenate((label, fixed, found), axis=1)
    model = fit_labels(votes)
    weights, bias = logistic(x, model.posterior(votes).astype(np.float32))
    voters = ["label", "insult", "insults", "insult and address", "shouting", "exclamation", "no words"] + [names[i] for i in lexicon]
    return Model({f: float(w) for f, w in zip(names, weights)}, bias, voters, model.accuracy.tolist(), model.parents.tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score``, the probability of toxic, to every row; null and empty texts get the bias alone.

    Every row is scored by its own whole text, whatever its doc_id; a column named score is
    replaced, others stay. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        whole = {f: w for f, w in weights.items() if not f.endswith("*")}
        once = {f[:-1]: w for f, w in weights.items() if f.endswith("*") and not f.endswith("**")}
        twice = {f[:-2]: w for f, w in weights.items() if f.endswith("**")}
        begins = {k: {b for b in once.keys() | twice.keys() if len(b) == k} for k in PREFIXES}
        for column in batches:
            out = []
            for text in column:
                words = set(_WORD.findall(text.lower())) if isinstance(text, str) else set()
                z = bias + sum(whole[w] for w in words & whole.keys())
                for k, known in begins.items():
                    held = Counter(b for w in words if (b := w[:k]) in known and len(w) > k)
                    z += sum(once.get(b, 0.0) + (twice.get(b, 0.0) if n > 1 else 0.0) for b, n in held.items())
                out.append(z)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -30, 30))))

    return docs.withColumn("score", F.pandas_udf(tell, "double")(F.col(text_col)))
