"""Quality: a linear-chain conditional random field over the lines of a document.

Every line gets surface features of its own, of the line before and of the line
after; the chain labels each line good (1) or bad (0). Forward-backward gives each
line's probability of being good, and their mean weighted by line length is the
document's score.

Labels mark whole documents, the lines' labels are latent. Lines of good documents are
good. Lines of bad documents begin as bad, without transitions; then, by turns, the chain's
own marginals tell which of them are, held to at least ``bad_share`` of the document's length
(the least common shift towards bad that reaches it), and chain and transitions are fitted
to what they tell. So good lines of bad documents, and what follows them, are learnt as such.

Fitting sees at most ``max_good`` and ``max_bad`` labelled texts, chosen by a hash
of the id; this bound is a parameter. Scoring reads every text whole.

Defined cases: null and empty texts are one empty line and get its marginal; texts of any
length and number of lines are scored whole; without labels of both classes every score is
1 (nothing is called bad unless bad was shown); repeated rows and rows without an id are
scored one by one (none of the latter is learnt from or held out); columns named like an
output are replaced; no rows give no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basestream.llm.common import with_columns_arrow
from basestream.llm.labelled import fit_in_one_task, held_out, sample

#: Byte classes: U upper, L lower or non-ASCII, D digit, S space, E sentence mark, P other mark.
KIND = bytes(
    ord("U") if 65 <= b <= 90 else ord("L") if 97 <= b <= 122 or b >= 128 else ord("D") if 48 <= b <= 57
    else ord("S") if b in b" \t\r\x0b\x0c" else ord("E") if b in b".,;:'\"?-" else ord("P")
    for b in range(256)
)
OWN = 13
WIDTH = 1 + 3 * OWN + 2


def line_features(line: bytes) -> list[float]:
    n = len(line)
    if not n:
        return [0.0] * OWN
    kinds = line.translate(KIND)
    words = line.split()
    m = len(words) or 1
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1])) if distinct < m else 0
    marks = kinds.count(b"P")
    return [
        1.0,
        math.log1p(n) / 8,
        math.log1p(m) / 6,
        kinds.count(b"U") / n,
        kinds.count(b"D") / n,
        marks / n,
        kinds.count(b"E") / n,
        min(1.0, marks / m),
        kinds.count(b"PP") * 2 / n,
        (m - distinct) / m,
        repeats / m,
        min(3.0, n / m / 8),
        float(kinds[-1:] == b"E"),
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, WIDTH) and the weight of each line."""
    lines = [x.encode("utf-8", "surrogatepass") for x in (text or "").split("\n")]
    own = np.array([line_features(x) for x in lines], np.float64)
    n = len(lines)
    x = np.zeros((n, WIDTH))
    x[:, 0] = 1
    x[:, 1 : 1 + OWN] = own
    x[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    x[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = own[1:]
    x[0, -2] = x[-1, -1] = 1
    return x, np.array([len(v) + 1.0 for v in lines])


def marginals(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(line is good) of one chain. unary: (lines,) log odds of good; trans: 2x2 log
    potentials. Scaled messages as ratios of good to bad, so long chains don't underflow."""
    n = len(unary)
    t = np.exp(trans - trans.max())
    (t00, t01), (t10, t11) = t.tolist()
    u = [math.exp(min(30.0, max(-30.0, v))) for v in unary.tolist()]
    fwd, bwd = [1.0] * n, [1.0] * n
    fwd[0] = u[0]
    for i in range(1, n):
        a = fwd[i - 1]
        fwd[i] = u[i] * (t01 + a * t11) / (t00 + a * t10)
    for i in range(n - 2, -1, -1):
        b = bwd[i + 1] * u[i + 1]
        bwd[i] = (t10 + b * t11) / (t00 + b * t01)
    odds = np.array(fwd) * np.array(bwd)
    return odds / (1 + odds)


class Chains:
    """Chains of one length, padded; forward-backward over all of them at once."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray):
        self.x, self.lengths = x, lengths
        self.live = np.arange(x.shape[1]) < lengths[:, None]

    def __call__(self, w: np.ndarray, trans: np.ndarray, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(line is good), and the expected number of each pair of neighbouring labels.
        shift: of each chain, added to the log potential of bad."""
        x, live, lengths = self.x, self.live, self.lengths
        n, most = live.shape
        u = np.zeros((n, most, 2))
        u[:, :, 1] = x @ w
        if shift is not None:
            u[:, :, 0] = shift[:, None]
        f, b = np.zeros_like(u), np.zeros_like(u)
        f[:, 0] = u[:, 0]
        for i in range(1, most):
            f[:, i] = u[:, i] + np.logaddexp(f[:, i - 1, :1] + trans[0], f[:, i - 1, 1:] + trans[1])
        for i in range(most - 2, -1, -1):
            nxt = u[:, i + 1] + b[:, i + 1]
            back = np.logaddexp(trans[:, 0][None] + nxt[:, :1], trans[:, 1][None] + nxt[:, 1:])
            b[:, i] = np.where(live[:, i + 1, None], back, 0)
        last = f[np.arange(n), lengths - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        good = np.exp(np.minimum(f[:, :, 1] + b[:, :, 1] - z[:, None], 0)) * live
        pair = f[:, :-1, :, None] + trans[None, None] + (u + b)[:, 1:, None, :] - z[:, None, None, None]
        return good, (np.exp(np.minimum(pair, 0)) * live[:, 1:, None, None]).sum(1)

    def latent(self, w: np.ndarray, trans: np.ndarray, sizes: np.ndarray, bad_share: float) -> tuple[np.ndarray, np.ndarray]:
        """The same under the least shift by which ``bad_share`` of ``sizes`` is bad."""
        low, high = np.zeros(len(sizes)), np.full(len(sizes), 24.0)
        share = lambda good: ((1 - good) * sizes).sum(1)
        high[share(self(w, trans, low)[0]) >= bad_share] = 0
        for _ in range(10):
            mid = (low + high) / 2
            enough = share(self(w, trans, mid)[0]) >= bad_share
            low, high = np.where(enough, low, mid), np.where(enough, mid, high)
        return self(w, trans, high)


def fit(rows: list[tuple], counts: dict[int, int], steps: int = 250, rate: float = 0.08, decay: float = 1e-3, span: int = 48, turns: tuple[int, ...] = (80, 110, 140, 170, 200), bad_share: float = 0.5) -> bytes:
    """rows: (id, text, label). Maximum likelihood of the chains by Adam, with latent line
    labels told anew after the steps ``turns``; chains longer than ``span`` lines are cut
    into several for fitting only."""
    n1, n0 = sum(r[2] == 1 for r in rows), sum(r[2] == 0 for r in rows)
    if not n1 or not n0:
        return pickle.dumps(None)
    chains, labels, shares, sizes = [], [], [], []
    for _, text, label in rows:
        x, size = document_features(text)
        for at in range(0, len(x), span):
            chains.append(x[at : at + span].astype(np.float32))
            sizes.append(size[at : at + span])
            labels.append(label)
            shares.append(min(span, len(x) - at) / len(x))
    lengths = np.array([len(c) for c in chains])
    y = np.array(labels)
    # Each document counts once, whatever its length; classes as in the corpus, bad ones at least a third.
    bad = max(counts[0] / (counts[0] + counts[1]), 1 / 3)
    weight = np.array(shares) * np.where(y == 1, (1 - bad) / n1, bad / n0)
    mean = np.mean([c[0] for c in chains], 0, np.float64)
    dev = np.concatenate(chains).std(0, np.float64) + 1e-3
    mean[0], dev[0] = 0, 1
    # Groups of chains of about one length, so that padding stays below their size.
    groups = []
    for low, high in ((1, 1), (2, 3), (4, 6), (7, 12), (13, 24), (25, span)):
        at = np.flatnonzero((lengths >= low) & (lengths <= high))
        if len(at):
            most = int(lengths[at].max())
            x, size = np.zeros((len(at), most, WIDTH), np.float32), np.zeros((len(at), most))
            for k, i in enumerate(at):
                x[k, : lengths[i]] = (chains[i] - mean) / dev
                size[k, : lengths[i]] = sizes[i] / sizes[i].sum()
            own = Chains(x, lengths[at])
            pairs = np.zeros((len(at), 2, 2))
            pairs[np.arange(len(at)), y[at], y[at]] = lengths[at] - 1
            groups.append([own, weight[at], y[at], size, y[at][:, None] * own.live.astype(float), pairs])
    del chains
    p = np.zeros(WIDTH + 4)
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, trans = p[:WIDTH], p[WIDTH:].reshape(2, 2)
        if step in turns:
            for g in groups:
                at = np.flatnonzero(g[2] == 0)
                if len(at):
                    own = Chains(g[0].x[at], g[0].lengths[at])
                    g[4][at], g[5][at] = own.latent(w, trans, g[3][at], bad_share)
        grad = decay * p
        for own, weight_, _, _, told, pairs in groups:
            good, expected = own(w, trans)
            grad[:WIDTH] += np.einsum("nl,nlf->f", (good - told) * weight_[:, None], own.x)
            grad[WIDTH:] += np.einsum("nab,n->ab", expected - pairs, weight_).ravel()
        if turns and step < turns[0]:
            grad[WIDTH:] = 0  # until then lines are told by themselves and their neighbours' features
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        p = p - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return pickle.dumps((p[:WIDTH] / dev, float(-(p[:WIDTH] / dev) @ mean), p[WIDTH:].reshape(2, 2)))


def score_texts(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """``docs`` plus score and predicted; the model is a few hundred bytes."""
    found = pickle.loads(model)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        s = []
        for text in b.column(b.schema.get_field_index("text")).to_pylist():
            if found is None:
                s.append(1.0)
                continue
            w, bias, trans = found
            x, weight = document_features(text)
            s.append(float(np.clip(marginals(x @ w + bias, trans) @ weight / weight.sum(), 0, 1)))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array([int(v >= threshold) for v in s], pa.int32())}

    return with_columns_arrow(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def train(docs: DataFrame, labels: DataFrame, keep=None, max_good: int = 2500, max_bad: int = 2500) -> bytes:
    rows, counts = sample(docs, labels, "quality", F.lit(True) if keep is None else keep, {1: max_good, 0: max_bad})
    return fit_in_one_task(rows, lambda got: fit(got, counts))


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, **bounds) -> DataFrame:
    """Scores of all ``docs``; labels of the held-out fold are never read."""
    model = train(docs, labels, ~held_out(mod, rest), **bounds)
    return score_texts(docs, model).withColumn("held_out", held_out(mod, rest))
