import hashlib

from basestream.llm import line_dedup as L

from tests.llm.helpers import documents, empty, frame


def brute(docs, least=20, most=3):
    strip = "\t\n\x0b\x0c\r "
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    holders = {}
    for d, t, *_ in docs:
        for x in (t or "").split("\n"):
            k = lower(x.strip(strip))
            if len(k) >= least:
                holders.setdefault(k, set()).add(d)
    out = {}
    for d, t, *_ in docs:
        lines = (t or "").split("\n")
        gone = lambda x: len(h := holders.get(lower(x.strip(strip)), ())) >= most and max(h) != d  # noqa: E731, B023
        kept = [x for x in lines if not gone(x)]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    docs = documents()
    for bound in (64 << 20, 0):  # broadcast filters, and the way beyond the bound
        got = L.dedup_lines(frame(spark, docs), max_broadcast_bytes=bound).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got} == brute(docs)
    assert sum(v[1] for v in brute(docs).values()) > 10


def test_many_shards(spark):
    docs = documents(4, 90)
    got = L.dedup_lines(frame(spark, docs), shard_keys=1).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {d: v[1] for d, v in brute(docs).items()}


def test_filters_beyond_the_broadcast_bound(spark):
    docs = documents(4, 90)
    store = L.LineStore.of(frame(spark, docs), shard_keys=1, max_broadcast_bytes=0)
    assert store.probe() is None and store.filters()[0] > 1
    got = L.dedup_lines(frame(spark, docs), store=store).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {d: v[1] for d, v in brute(docs).items()}
    thinned = store._by_shard(L.line_pairs(frame(spark, docs), 20))
    assert {bytes(r["key"]) for r in thinned.collect()} >= {bytes(r["key"]) for r in store.repeated.collect()}
    assert thinned.count() < store.pairs.count()


def test_deletion_of_the_keeper(spark):
    docs = documents(4, 90)
    rows = lambda s: sorted((bytes(r["key"]), r["n_docs"], r["keep_doc"]) for r in s.counts.collect())
    gone = [d for d in docs if d[0] is not None and d[0] % 4 == 1] + [d for d in docs if d[0] > 80]
    left = [d for d in docs if d not in gone]
    assert rows(L.LineStore.of(frame(spark, docs)).delete(frame(spark, gone))) == rows(L.LineStore.of(frame(spark, left)))
    assert rows(L.LineStore.of(frame(spark, left)).insert(frame(spark, docs[:50]))) == rows(L.LineStore.of(frame(spark, left + [d for d in docs[:50] if d not in left])))


def test_insert_then_delete_is_the_state_before(spark):
    docs = documents()
    old, new = frame(spark, docs[:40]), frame(spark, docs[40:])
    rows = lambda s: sorted((bytes(r["key"]), r["n_docs"], r["keep_doc"]) for r in s.counts.collect())
    before = L.LineStore.of(old)
    grown = before.insert(new)
    assert rows(grown) == rows(L.LineStore.of(frame(spark, docs)))
    assert rows(grown.delete(new)) == rows(before)
    got = L.dedup_lines(old, store=grown.delete(new)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {d: v[1] for d, v in brute(docs[:40]).items()}


def test_filters_follow_insertions_and_deletions(spark):
    docs = documents(4, 90)
    old, new = frame(spark, docs[:30]), frame(spark, docs[30:])
    store = L.LineStore.of(old, shard_keys=1)
    n, _ = store.filters()
    grown = store.insert(new)
    assert grown._filters is not None and grown.filters()[0] == n

    def hits(s):
        p = L.Probe([(r["shard"], bytes(r["filter"])) for r in s.filters()[1].collect()], s.filters()[0])
        return {k for k in (bytes(r["key"]) for r in s.counts.collect()) if p.hits([k])}

    want = lambda s: {bytes(r["key"]) for r in s.repeated.collect()}
    assert want(grown) and hits(grown) == want(grown)
    back = grown.delete(new)
    assert want(back) <= hits(back) and len(hits(back)) == len(want(store))
    got = L.dedup_lines(frame(spark, docs), store=grown).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {d: v[1] for d, v in brute(docs).items()}


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    f = L.CuckooFilter.load(L.CuckooFilter.build(keys).dump())
    assert f.contains(keys).all()
    others = [hashlib.md5(f"x{i}".encode()).digest() for i in range(5000)]
    assert f.contains(others).mean() < 0.01
    for k in keys[::2]:
        assert f.remove(k)
    assert f.contains(keys[1::2]).all() and f.contains(keys[::2]).mean() < 0.01


def test_empty_and_clashing_columns(spark):
    assert L.dedup_lines(empty(spark)).count() == 0
    df = frame(spark).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "drop_id").withColumnRenamed("n_chars", "drop_keys")
    got = L.dedup_lines(df)
    assert dict(got.dtypes)["n_lines"] == "bigint" and got.count() == df.count()
    twice = frame(spark, [(1, "x" * 30, "", "", 1)] * 5 + [(None, "x" * 30, "", "", 1)])
    assert L.dedup_lines(twice).agg({"n_dropped": "sum"}).first()[0] == 0
