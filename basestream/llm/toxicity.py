"""Toxicity: a linear classifier over character n-grams with naive Bayes scaling.

A text's A-Z are lower-cased and everything but digits, letters and non-ASCII
becomes a space; its features are the distinct byte n-grams (``orders``) of that
stream, hashed to ``2**bits``. Each feature's value is its naive Bayes log-count
ratio, learnt from labelled texts, and a logistic regression is fitted on those
values. Scoring gathers the product of weight and ratio for each distinct n-gram.

Fitting sees at most ``max_toxic`` and ``max_clean`` labelled texts, chosen by a
hash of the id; this bound is a parameter. Scoring reads every text whole.

Defined cases: null is the empty text, whose score is the prior; texts of any length
are read whole, in pieces of bounded size; without labels of both classes every score is
the share of toxic labels (0 without labels); repeated rows and rows without an id are
scored one by one (none of the latter is learnt from or held out); columns named like an
output are replaced; no rows give no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basestream.llm.common import with_columns_arrow
from basestream.llm.decontaminate import FOLD
from basestream.llm.labelled import fit_in_one_task, held_out, sample

ORDERS = (3, 4, 5, 6, 7, 8)
BITS = 21
MIX = np.uint64(0x9E3779B97F4A7C15)


class Featurizer:
    """Distinct hashed n-grams of a text, in time linear in its length."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS, block: int = 1 << 20):
        self.orders, self.bits, self.block = orders, bits, block
        self.stamp = np.zeros(1 << bits, np.int64)
        self.clock = 0

    def __call__(self, text: str | None) -> np.ndarray:
        raw = b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "
        if len(raw) < 3:
            return np.zeros(0, np.int32)
        found = []
        self.clock += 1
        start = self.clock
        most = max(self.orders)
        for at in range(0, len(raw), self.block):  # bounded memory on very long texts
            b = np.frombuffer(raw[at : at + self.block + most - 1], np.uint8).astype(np.uint64)
            key = np.zeros(len(b), np.uint64)
            for n in range(1, most + 1):
                if n > len(b):
                    break
                key = (key[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
                if n not in self.orders:
                    continue
                # n-grams that begin in this block only
                k = key[: self.block]
                h = (((k << np.uint64(3)) ^ np.uint64(n)) * MIX >> np.uint64(64 - self.bits)).astype(np.int32)
                h = h[self.stamp[h] < start]
                order = np.arange(self.clock, self.clock + len(h))
                self.stamp[h] = order
                found.append(h[self.stamp[h] == order])
                self.clock += len(h)
        return np.concatenate(found) if found else np.zeros(0, np.int32)


def fit(rows: list[tuple], counts: dict[int, int], epochs: int = 6, rate: float = 0.1, least_docs: int = 3, per_toxic: int = 8, most_features: int = 1 << 16) -> bytes:
    """rows: (id, text, label). Returns the pickled (indices, values, intercept). The
    strongest features are fitted, ``per_toxic`` of them for each toxic text of the sample
    (1,024 at least, ``most_features`` at most): with more, rare n-grams of few texts
    drown the others."""
    y = np.array([r[2] for r in rows], np.int64)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    total = sum(counts.values())
    if not n1 or not n0:
        prior = min(1 - 1e-9, max(1e-9, counts.get(1, 0) / total)) if total else 1e-9
        return pickle.dumps((np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(prior / (1 - prior)))))
    make = Featurizer()
    df = np.zeros((2, 1 << BITS), np.int32)
    for _, text, label in rows:
        df[label][make(text)] += 1
    ratio = np.log((df[1] + 1.0) / (n1 + 2.0)) - np.log((df[0] + 1.0) / (n0 + 2.0))
    strength = np.abs(ratio) * np.sqrt(df.sum(0))
    strength[df.sum(0) < least_docs] = 0
    chosen = np.flatnonzero(strength > 0)
    most = min(most_features, max(1024, per_toxic * n1))
    if len(chosen) > most:
        chosen = chosen[np.argsort(-strength[chosen], kind="stable")[:most]]
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    r = ratio[chosen]
    x = []
    for _, text, _ in rows:
        f = place[make(text)]
        x.append(f[f >= 0])
    w = np.zeros(len(chosen))
    seen = np.full(len(chosen), 1e-6)
    bias, rng = float(np.log(n1 / n0)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f = x[i]
            z = float(w[f] @ r[f]) + bias
            g = 0.5 * (1 + np.tanh(0.5 * z)) - y[i]
            gv = g * r[f]
            seen[f] += gv * gv
            w[f] -= rate * gv / np.sqrt(seen[f]) / np.sqrt(max(1, len(f)))
            bias -= 0.02 * g
    # The sample holds the classes in other shares than the corpus.
    bias += float(np.log(counts[1] / counts[0]) - np.log(n1 / n0))
    return pickle.dumps((chosen.astype(np.int32), (w * r).astype(np.float32), bias))


def score_texts(docs: DataFrame, model: bytes, threshold: float = 0.3) -> DataFrame:
    """``docs`` plus score and predicted. The model has a fixed greatest size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        if not state:
            at, values, bias = pickle.loads(shared.value)
            table = np.zeros(1 << BITS, np.float32)
            table[at] = values
            state.update(table=table, bias=bias, make=Featurizer())
        table, bias, make = state["table"], state["bias"], state["make"]
        z = np.array([float(table[make(t)].sum(dtype=np.float64)) + bias for t in b.column(b.schema.get_field_index("text")).to_pylist()])
        s = 0.5 * (1 + np.tanh(0.5 * z))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())}

    return with_columns_arrow(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def train(docs: DataFrame, labels: DataFrame, keep=None, max_toxic: int = 4000, max_clean: int = 8000) -> bytes:
    rows, counts = sample(docs, labels, "toxic", F.lit(True) if keep is None else keep, {1: max_toxic, 0: max_clean})
    return fit_in_one_task(rows, lambda got: fit(got, counts))


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, **bounds) -> DataFrame:
    """Scores of all ``docs``; labels of the held-out fold are never read."""
    model = train(docs, labels, ~held_out(mod, rest), **bounds)
    return score_texts(docs, model).withColumn("held_out", held_out(mod, rest))
