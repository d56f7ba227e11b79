import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from basestream.llm import jaccard_join as J

from tests.llm.helpers import documents, empty, frame, text


def brute(docs, n, t):
    import re

    sets = []
    for _, x, *_ in docs:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        k = min(n, len(w))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set())
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and t.denominator * len(a & sets[j]) >= t.numerator * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d[0]), d[0])
    return {d[0]: (len(s), least[find(i)]) for i, (d, s) in enumerate(zip(docs, sets))}


def near(seed=5, copies=50):
    rng = random.Random(seed)
    docs = documents(seed, 30)
    base = text(rng, 90).split(" ")
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        docs.append((1000 + k, " ".join(w), "en", "src0", 0))
    for k in range(12):
        w = text(random.Random(k), rng.randrange(2, 20))
        docs += [(2000 + 3 * k, w, "en", "s", 0), (2001 + 3 * k, w + " tail", "en", "s", 0), (2002 + 3 * k, w.upper(), "en", "s", 0)]
    return docs


@pytest.mark.parametrize(("n", "t", "limit"), [(3, "0.9", 4_000_000), (5, "0.8", 4_000_000), (3, "0.9", 600)])
def test_groups_against_brute_force(spark, n, t, limit):
    docs = near()
    want = brute(docs, n, Fraction(t))
    assert len({v[1] for v in want.values()}) < len(docs) - 10
    got = J.jaccard_groups(frame(spark, docs).repartition(3), n, t, block_shingles=limit).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_signatures_collide_for_every_link():
    rng = np.random.default_rng(4)
    for t in (Fraction("0.9"), Fraction("0.8")):
        sign = J.Signer(t)
        for _ in range(1500):
            size = int(rng.integers(1, 130))
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            drop, add = int(rng.integers(0, size // 4 + 1)), int(rng.integers(0, size // 4 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
            c = len(np.intersect1d(a, b))
            if len(b) and J.linked(c, len(a), len(b), t.numerator, t.denominator):
                assert len(np.intersect1d(sign(a), sign(b)))


def test_voronoi_recursion_is_exact():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
        for _ in range(25):
            k = int(rng.integers(0, 14))
            sets.append(np.unique(np.concatenate([rng.permutation(base)[k:], rng.integers(0, 2**63, k, dtype=np.uint64)])))
    t = Fraction("0.9")
    a, b = J.Block(sets, t), J.Block(sets, t)
    a.join(np.arange(len(sets)), leaf=8, pivots=4)
    b._exact(np.arange(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if J.linked(c, len(sets[i]), len(sets[j]), 9, 10):
                a_, b_ = a.find(i) == a.find(j), b.find(i) == b.find(j)
                assert a_ and b_
    assert [a.find(i) for i in range(len(sets))] == [b.find(i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in J.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up}


def test_keep_one_and_awkward_rows(spark):
    docs = near()
    kept = {r["doc_id"] for r in J.keep_one(frame(spark, docs)).collect()}
    assert kept == {d for d, v in brute(docs, 5, Fraction("0.8")).items() if v[1] == d}
    assert J.jaccard_groups(empty(spark)).count() == 0
    same = frame(spark, [(1, "a b c d", "", "", 1), (1, "a b c d", "", "", 1), (None, "a b c d", "", "", 1), (3, "a b c d", "", "", 1)])
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.jaccard_groups(same).collect()), key=str)
    assert got == [(1, 1), (1, 1), (3, 1), (None, None)]
    assert J.keep_one(same).where(F.col("doc_id") == 3).count() == 0


def test_keep_one_decides_by_row(spark):
    copy, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, copy, "", "a", 1), (2, copy, "", "b", 1), (2, other, "", "c", 1), (None, copy, "", "d", 1), (None, "x y z u v w t", "", "e", 1), (4, other, "", "f", 1), (4, other, "", "g", 1)]
    kept = J.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", copy), ("2", other), ("None", "x y z u v w t")]


@pytest.mark.parametrize("limit", [1_000_000, 600])
def test_number_of_links(spark, limit):
    docs = near() + [(5000 + k, "the very same text in many rows", "en", "s", 0) for k in range(30)]
    sets = {}
    for d, x, *_ in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").split()
        sets[d] = {tuple(w[a : a + min(3, len(w))]) for a in range(len(w) - min(3, len(w)) + 1)} if w else set()
    want = {a: sum(a != b and bool(s) and bool(r) and 10 * len(s & r) >= 9 * len(s | r) for b, r in sets.items()) for a, s in sets.items()}
    got = J.jaccard_groups(frame(spark, docs), 3, "0.9", block_shingles=limit, count_links=True)
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == want and max(want.values()) >= 29
