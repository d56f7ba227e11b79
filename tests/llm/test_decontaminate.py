import random
import re

from basestream.llm import decontaminate as D

from tests.llm.helpers import documents, empty, frame, text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = {}
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit.update(range(a, a + k))
                    found |= wins[tuple(w[a : a + k])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def cases():
    rng = random.Random(8)
    docs = documents(2)
    items = [(k, text(rng, rng.randrange(9, 40))) for k in range(12)]
    items += [(50, None), (51, "!!"), (52, "zeta omega"), (53, items[0][1]), (54, "alpha alpha alpha"), (55, items[1][1].split(" ", 3)[3])]
    for k in range(0, 30, 4):
        w = items[k % 12][1].split(" ")
        docs[k] = (k, docs[k][1] + " " + ", ".join(w[k % 5 :]) + " end", *docs[k][2:])
    docs[2] = (2, "alpha " * 50, *docs[2][2:])
    return docs, items


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sum(v[1] > 0 for v in want.values()) > 5
    for block in (10**6, 30):
        got = D.scan_documents(frame(spark, docs), bench, block_words=block).collect()
        assert {r["doc_id"]: (r["n_words"], sum(b - a for a, b in r["hit_spans"]), list(r["hit_items"])) for r in got} == want


def test_digest_and_removal(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    rows = {r["doc_id"]: r for r in D.digest(D.scan_documents(frame(spark, docs), bench)).collect()}
    assert all(rows[d]["items_sha256"] == D.items_digest(v[2]) and rows[d]["contaminated"] == (v[1] > 0) for d, v in want.items())
    out = {r["doc_id"]: r for r in D.remove_spans(frame(spark, docs), bench).collect()}
    assert set(out) == {d for d, v in want.items() if v[1] <= v[0] * 0.5}
    for d, t, *_ in docs:
        if d in out and not want[d][1]:
            assert out[d]["text"] == t
        elif d in out:
            assert len(words(out[d]["text"])) == want[d][0] - want[d][1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.digest(D.scan_documents(empty(spark), none)).count() == 0
    assert D.digest(D.scan_documents(frame(spark), none)).where("contaminated").count() == 0
