import hashlib

from pyspark.sql import functions as F

from basestream.llm import fingerprints as P
from basestream.llm import licenses, secrets

from tests.llm.helpers import documents, empty, frame


def shingles(t, n=5):
    w = t.lower().split()
    k = min(n, len(w))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()


def test_fingerprints(spark):
    docs = {d: t or "" for d, t, *_ in documents()}
    rows = {r["doc_id"]: r for r in P.report(P.fingerprint_documents(frame(spark))).collect()}
    ids = sorted(docs, reverse=True)
    after = {d: docs[ids[(k + 1) % len(ids)]] for k, d in enumerate(ids)}
    for d, t in docs.items():
        r, m = rows[d], len(t) // 3
        edited = t[: len(t) - m] + after[d][:m]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r["near_edited"], edited), (r["near_next"], after[d])):
            a, b = shingles(t), shingles(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - want) < (1e-9 if len(a | b) <= P.K else 0.2)
    copies = [d for d, t in docs.items() if t == docs[3]]
    assert len(copies) == 3 and len({rows[d]["fingerprint"] for d in copies}) == 1


def test_next_document_across_ranges(spark, monkeypatch):
    df = frame(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = {r["doc_id"]: r["next_text"] for r in P.with_next(df, bucket_rows=10**6).collect()}
    many = {r["doc_id"]: r["next_text"] for r in P.with_next(df, bucket_rows=5).collect()}
    monkeypatch.setattr(P, "MOST_CUTS", 3)
    finer = {r["doc_id"]: r["next_text"] for r in P.with_next(df, bucket_rows=5).collect()}
    assert one == many == finer and len(one) == len(documents())
    assert P.report(P.fingerprint_documents(empty(spark))).count() == 0
    single = frame(spark, [(7, "a b c d e f", "", "", 1)])
    assert P.report(P.fingerprint_documents(single)).first()["near_next"] == 1.0
    odd = frame(spark, [(None, "x y", "", "", 1), (1, "a b c", "", "", 1), (1, "a b c", "", "", 1)])
    assert P.report(P.fingerprint_documents(odd)).count() == 3


def test_merge_is_the_sketch_of_the_union(spark):
    a, b = " ".join(f"a{i}" for i in range(600)), " ".join(f"b{i}" for i in range(400))
    df = spark.createDataFrame([("k", a), ("k", b), ("k", a)], "key string, text string").withColumn("s", P.sketch(F.col("text")))
    merged = P.merge_groups(df, "key", "s").first()["s"]
    two = spark.createDataFrame([(a, b)], "a string, b string").select(P.merge(P.sketch(F.col("a")), P.sketch(F.col("b")))).first()[0]
    assert merged == two and len(merged) == P.K
    n = df.select(P.distinct_count(F.col("s"))).first()[0]
    assert 420 < n < 800


def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    docs = [
        (1, f'set token = "{key}" and go', "", "", 0), (2, "my card 4929348385146306 is here", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0),
        (5, "see commit " + key, "", "", 0), (6, "mail first.99@mail9.example.com now", "", "", 0), (7, f'api_key = "{key[:36]}"', "", "", 0),
    ]
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, docs)).collect()}
    assert {d for d, r in rows.items() if r["is_secret"]} == {1, 7}
    assert set(rows) == {1, 2, 5, 6, 7} and rows[1]["value_sha256"] == hashlib.sha256(key.encode()).hexdigest()
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_forest_on_unseen_findings(spark):
    every = secrets.labelled_findings(spark, 1600).withColumn("odd", F.monotonically_increasing_id() % 5 == 0).cache()
    forest = secrets.fit(every.where("not odd").drop("odd"))
    judged = secrets.features(every.where("odd")).withColumn("p", secrets.forest_column(forest)).select("label", "p").collect()
    assert sum((r["p"] >= 0.5) == (r["label"] == 1) for r in judged) / len(judged) > 0.95


def contained(t, template, least=0.8):
    import re

    words = lambda x: [w for w in re.split(r"[\x00-/:-`{-\x7f]+", x.lower()) if w]
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want, w = grams(words(template)), words(t or "")
    size = max(len(words(template)), 3)
    return max((len(grams(w[a : a + size]) & want) / len(want) for a in range(max(1, len(w) - size + 1))), default=0) >= least


def test_licenses(spark):
    docs = list(documents())[:20]
    names = list(licenses.TEMPLATES)
    for k, name in enumerate(names):
        w = licenses.TEMPLATES[name].split(" ")
        docs[k] = (k, docs[k][1] + "\n" + " ".join(w) + "\n" + docs[k + 1][1], "", "", 0)
    docs.append((100, " ".join(licenses.TEMPLATES["GPL-notice"].split(" ")[:-2]) + " entirely otherwise", "", "", 0))
    docs.append((101, "licensed under nothing at all", "", "", 0))
    found = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(frame(spark, docs)).collect()}
    want = {(d, n) for d, t, *_ in docs for n, x in licenses.TEMPLATES.items() if contained(t, x)}
    assert want and found == want
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_secrets_glued_and_several_in_a_word(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hexa, aws, other = h("a")[:40], "AKIA" + h("k")[:16].upper(), h("b")[:40]
    texts = [
        f'client_secret="{hexa}"', f'{{"access_token":"{hexa}"}}', f'[{{"a":"{hexa}","b":"{aws}"}}]', f"id,{hexa},{aws},{other}", f"client_secret={hexa}",
        f'{{\\"access_token\\":\\"{hexa}\\"}}', f"{aws}:{other}", "password=abc123", f"token={hexa}==", "no_digit_in_this_word", f'x = "{hexa}"',
        "https://example.com/page12345", ",".join(h(str(k))[:40] for k in range(300)), ":".join(h(str(k))[:40] for k in range(300)),
    ]
    want = [
        [hexa], [hexa], [hexa, aws], [hexa, aws, other], [hexa], [hexa], [aws, other], ["password=abc123"], [hexa + "=="], [], [hexa],
        ["//example.com/page12345"], [h(str(k))[:40] for k in range(300)], [h(str(k))[:40] for k in range(300)],
    ]
    docs = frame(spark, [(k, t, "", "", 0) for k, t in enumerate(texts)])
    got, verdict = {k: [] for k in range(len(texts))}, {}
    for r in secrets.scan_secrets(docs).collect():
        got[r["doc_id"]].append(r["value_sha256"])
        verdict[r["doc_id"], r["value_sha256"]] = r["is_secret"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(map(h, v)) for k, v in enumerate(want)}
    assert all(verdict[k, h(hexa)] for k in (0, 1, 4, 5)) and verdict[2, h(aws)] and verdict[3, h(aws)]
    assert not verdict[11, h("//example.com/page12345")]
    assert max(len(r["word"]) for r in secrets.candidates(docs).collect()) <= secrets.FIELD_BYTES + 64


def test_secrets_of_whole_documents(spark):
    """Planted findings of the table: quoted digests behind "token =" against its
    card numbers, addresses and mail names."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted, benign = set(), set()
    for d, t in docs.select("doc_id", "text").toLocalIterator():
        planted |= {(d, hashlib.sha256(x.encode()).hexdigest()) for x in re.findall('(?i:token) = "([0-9a-fA-F]{40})"', t or "")}
        benign |= {(d, hashlib.sha256(x.encode()).hexdigest()) for x in re.findall(r"\b[0-9]{16}\b|\b\w+\.[0-9]+@mail[0-9]\.example\.com\b", t or "")}
    found = {(r["doc_id"], r["value_sha256"]) for r in secrets.scan_secrets(docs).where("is_secret").collect()}
    assert len(planted) > 10 and len(found & planted) / len(planted) >= 0.95
    assert len(found & benign) == 0 and len(found & planted) / len(found) >= 0.9


def test_license_bands_retrieve_and_long_templates(spark):
    for shingles, window in ((3, 16), (7, 16), (60, 128), (500, 1024)):
        bins = licenses.bins_needed(shingles, window, 0.8, 1e-3)
        load = (window - 2 + shingles) / bins
        assert (1 - (1 - 2.718281828 ** -load) / load) ** (0.8 * shingles) <= 2e-3
    import random

    rng = random.Random(3)
    w = licenses.TEMPLATES["MIT-text"].split(" ")
    noisy = [x if rng.random() > 0.02 else "otherwise" for x in w]
    filler = [f"w{rng.randrange(500)}" for _ in range(3000)]
    docs = frame(spark, [(1, " ".join(filler[:1234] + noisy + filler[1234:]), "", "", 0), (2, " ".join(filler), "", "", 0), (None, " ".join(w), "", "", 0)])
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(docs).collect()}
    assert (1, "MIT-text") in got and (None, "MIT-text") in got and not any(d == 2 for d, _ in got)
    assert 1200 < got[1, "MIT-text"]["first_word"] <= 1260
    own = spark.createDataFrame([("mine", " ".join(filler[100:160])), ("short", "one two")], "name string, text string")
    assert {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs, own).collect()} == {(1, "mine"), (2, "mine")}
