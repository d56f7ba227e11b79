import itertools
import pickle
import random
import zlib

import numpy as np

from basestream.llm import quality as Q
from basestream.llm import toxicity as X

from tests.llm.helpers import documents, empty, frame, text


def labelled(n=300):
    rng = random.Random(12)
    docs, labels = [], []
    for k in range(n):
        toxic, bad = int(rng.random() < 0.25), int(rng.random() < 0.3)
        w = text(rng, rng.randrange(20, 90)).split(" ")
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewretch", "vilescum", "vilerat"]))
        if bad:
            w = [x + rng.choice(["***", "$$$", "&&&"]) for x in w]
        docs.append((k, " ".join(w), "en", "src0", 0))
        labels.append((k, 1 - bad, toxic))
    return docs, labels


def agreement(rows, want, held):
    got = [(r["predicted"], want[r["doc_id"]]) for r in rows if r["held_out"] == held]
    return sum(a == b for a, b in got) / len(got)


def test_both_classifiers_on_held_out_rows(spark):
    docs, labels = labelled()
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tox = X.score_toxicity(df, lab).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in tox)
    assert agreement(tox, {d: t for d, _, t in labels}, True) > 0.95
    good = Q.score_quality(df, lab).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in good)
    assert agreement(good, {d: q for d, q, _ in labels}, True) > 0.95
    # Labels of the held-out fold have no influence.
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, t) for d, q, t in labels]
    again = Q.score_quality(df, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in good}


def test_without_labels_and_awkward_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (X.score_toxicity, Q.score_quality):
        assert score(empty(spark), none).count() == 0
        rows = score(frame(spark), none).collect()
        assert len(rows) == len(documents()) and all(0 <= r["score"] <= 1 for r in rows)
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert X.score_toxicity(frame(spark), nulls).count() == len(documents())


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    u, t = rng.normal(size=6), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(6)
    for path in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(u[i] for i in range(6) if path[i]) + sum(t[path[i], path[i + 1]] for i in range(5)))
        total += w
        good += w * np.array(path)
    assert np.allclose(Q.marginals(u, t), good / total)


def test_features_do_not_depend_on_blocks():
    t = " ".join(f"w{i % 37}é{i}" for i in range(500))
    a, b = X.Featurizer(), X.Featurizer(block=64)
    assert sorted(a(t).tolist()) == sorted(b(t).tolist())
    assert len(set(a(t).tolist())) == len(a(t)) and X.Featurizer()(None).size == 0


def test_line_model_is_small():
    docs, labels = labelled(80)
    rows = [(d[0], d[1], q) for d, (_, q, _) in zip(docs, labels)]
    assert len(Q.fit(rows, {0: 20, 1: 60}, steps=20)) < 4000
    assert pickle.loads(Q.fit([], {})) is None


def test_lines_of_half_bad_documents(spark):
    """Bad documents of the training part are half good; the chain tells their lines apart."""
    import pickle
    import random

    from basestream.llm import quality as Q

    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["The", "harbour", "village", "keeps", "its", "old", "lights", "near", "water"]) for _ in range(9)) + "."
    junk = lambda: " ".join(rng.choice(["$$$", "@@", "##1", "BUY", "99", "!!!", "%%"]) for _ in range(9))
    rows = []
    for k in range(200):
        n = rng.randrange(3, 9)
        lines = [good() for _ in range(2 * n)] if k % 2 else [good() for _ in range(n)] + [junk() for _ in range(n)]
        rows.append((k, "\n".join(lines), k % 2))
    w, bias, trans = pickle.loads(Q.fit(rows, {1: 100, 0: 100}))
    x, _ = Q.document_features("\n".join([good() for _ in range(6)] + [junk() for _ in range(6)]))
    p = Q.marginals(x @ w + bias, trans)
    assert (p[:5] > 0.5).all() and (p[7:] < 0.5).all()
