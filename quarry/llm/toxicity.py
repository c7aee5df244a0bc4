"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of 4 to 7 letters, hashed into 2^20 places; the places that tell the
classes apart best in the training sample are the machine's inputs, each present or absent. The machine adds to the
linear weights a product of two short vectors for every pair of inputs that are present, learned by stochastic
gradients, so that two terms together may count more or less than each by itself.

Training takes at most `train_rows` labelled documents, chosen by a hash of their ids: a bound on the driver's work,
whatever the table's size. Scoring reads every whole text.

Defined results: a null or empty text has no terms and gets the score of the bias alone. Without any labels the score
is 0.5 throughout; with one class only, it is that class's smoothed share. Repeated label rows count once, as toxic if
any says so; null labels are left out. A null doc_id counts as held out. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import map_rows, small_batches, whole_text

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s")
PLACES = 1 << 20
SLAB = 1 << 20
#: Words whose places a task remembers, none longer than this; and the least gain of information of an input.
KNOWN, LONGEST = 200_000, 64
LEAST_GAIN = 4.0


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def words(text: str) -> set[str]:
    """The distinct lower-cased words; long texts are cut at white space."""
    if len(text) <= SLAB:
        return set(_WORD.findall(text.lower()))
    out, at = set(), 0
    while at < len(text):
        m = _GAP.search(text, at + SLAB)
        end = m.start() if m else len(text)
        out.update(_WORD.findall(text[at:end].lower()))
        at = end
    return out


def places(word: str) -> tuple[int, ...]:
    """Hashed places of a word: itself and its beginnings."""
    own = [f"w:{word}", *(f"p:{word[:k]}" for k in range(4, min(7, len(word)) + 1))]
    return tuple({crc32(x.encode()) % PLACES for x in own})


class Machine:
    """A factorization machine over chosen places: bias, linear weights, pair vectors."""

    def __init__(self, chosen: np.ndarray, factors: int, bias: float, seed: int):
        self.chosen = chosen
        self.bias = bias
        self.linear = np.zeros(len(chosen))
        self.pairs = np.random.default_rng(seed).normal(0, 0.05, (len(chosen), factors))

    def raw(self, inputs: np.ndarray) -> float:
        v = self.pairs[inputs]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[inputs].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, inputs: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(inputs), -30, 30))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, decay: float, seed: int, batch: int = 64) -> None:
        """Adagrad on the logistic loss."""
        rng = np.random.default_rng(seed)
        g_lin, g_pair, g_bias = np.full(len(self.chosen), 1e-2), np.full(self.pairs.shape, 1e-2), 1e-2
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                size = np.array([len(rows[i]) for i in at])
                inputs = np.concatenate([rows[i] for i in at]).astype(np.int64)
                owner = np.repeat(np.arange(len(at)), size)
                v = self.pairs[inputs]
                total = np.zeros((len(at), v.shape[1]))
                np.add.at(total, owner, v)
                square = np.bincount(owner, (v * v).sum(axis=1), len(at))
                raw = self.bias + np.bincount(owner, self.linear[inputs], len(at)) + 0.5 * ((total * total).sum(axis=1) - square)
                slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[at]) / len(at)
                used, back = np.unique(inputs, return_inverse=True)
                d_lin = np.bincount(back, slope[owner], len(used)) + decay * self.linear[used] / len(at)
                d_pair = np.zeros((len(used), v.shape[1]))
                np.add.at(d_pair, back, slope[owner, None] * (total[owner] - v))
                d_pair += decay * self.pairs[used] / len(at)
                g_lin[used] += d_lin**2
                g_pair[used] += d_pair**2
                g_bias += slope.sum() ** 2
                self.linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
                self.pairs[used] -= rate * d_pair / np.sqrt(g_pair[used])
                self.bias -= rate * slope.sum() / np.sqrt(g_bias)


def choose(rows: list[np.ndarray], labels: np.ndarray, inputs: int) -> np.ndarray:
    """The places with the largest gain of information on the class, of those in two rows at least and with `LEAST_GAIN`."""
    n, pos = len(rows), labels.sum()
    both, hit = np.zeros(PLACES), np.zeros(PLACES)
    for k in range(0, n, 500):  # the driver holds the rows already; what is made of them is bounded
        own = rows[k : k + 500]
        every = np.concatenate(own)
        both += np.bincount(every, minlength=PLACES)
        hit += np.bincount(every, np.repeat(labels[k : k + 500], list(map(len, own))), PLACES)
    seen = np.nonzero(both >= 2)[0]
    a, b = hit[seen], both[seen] - hit[seen]
    c, d = pos - a, n - pos - b

    def part(x: np.ndarray, row: np.ndarray, col: float) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) * n / np.maximum(row * col, 1e-12)), 0)

    gain = part(a, a + b, pos) + part(b, a + b, n - pos) + part(c, c + d, pos) + part(d, c + d, n - pos)
    best = np.lexsort((seen, -gain))[:inputs]
    strong = best[gain[best] > LEAST_GAIN]
    return np.sort(seen[strong])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 12000, inputs: int = 2048, factors: int = 8, epochs: int = 12, rate: float = 0.2, decay: float = 0.02, seed: int = 7) -> Machine:
    """Learn from labelled documents outside the held-out fold.

    The bound on what reaches the driver: the term places of documents of `train_rows` ids, chosen by hash, and should
    ids repeat in docs, of 2 * train_rows rows, by id and content.
    """
    marked = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", whole_text("text").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")  # train_rows at most

    def featured() -> object:
        known: dict[str, tuple[int, ...]] = {}

        def f(row: tuple) -> Iterator[tuple]:
            found: set[int] = set()
            for w in words(row[2]):
                if (own := known.get(w)) is None:
                    own = places(w)
                    if len(known) < KNOWN and len(w) <= LONGEST:
                        known[w] = own
                found.update(own)
            yield row[0], row[1], np.sort(np.fromiter(found, np.int32, len(found))).tobytes()

        return f

    rows = map_rows(texts, "doc_id long, toxic int, places binary", featured, weigh=2).orderBy("doc_id", "places").limit(2 * train_rows).collect()
    marks = np.array([r[1] for r in rows], float)
    inputs_of = [np.frombuffer(r[2], np.int32) for r in rows]
    pos = marks.sum()
    share = (pos + 0.5) / (len(rows) + 1)
    chosen = choose(inputs_of, marks, inputs) if 0 < pos < len(rows) else np.zeros(0, np.int64)
    machine = Machine(chosen, factors, float(np.log(share / (1 - share))), seed)
    if len(chosen):
        kept = [np.searchsorted(chosen, r[np.isin(r, chosen)]) for r in inputs_of]
        machine.fit(kept, marks, epochs, rate, decay, seed)
    return machine


class Scorer:
    """Scores texts; what a word adds is worked out once for as long as memory allows."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.at = {int(p): i for i, p in enumerate(machine.chosen)}
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        found: set[int] = set()
        for w in words(text):
            own = self.known.get(w)
            if own is None:
                own = tuple(self.at[p] for p in places(w) if p in self.at)
                if len(self.known) < KNOWN and len(w) <= LONGEST:
                    self.known[w] = own
            if own:
                found.update(own)
        return self.machine.score(np.sort(np.fromiter(found, np.int64, len(found))))


def score_column(text: Column, machine: Machine) -> Column:
    """The score as a column, so that a filter keeps all other columns where they are."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(machine)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return F.pandas_udf(scores, "double")(text)


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs."""

    def make() -> object:
        scorer = Scorer(machine)
        return lambda row: ((row[0], scorer.score(row[1])),)

    out = map_rows(docs.select("doc_id", whole_text("text")), "doc_id long, score double", make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **how: object) -> DataFrame:
    """The rows of docs whose score is below one half, all columns as they are."""
    small_batches(docs.sparkSession)
    return docs.where(score_column(whole_text("text"), train(docs, labels, **how)) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame, **how: object) -> DataFrame:
    return score_documents(docs, train(docs, labels, **how))
