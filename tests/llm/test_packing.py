import numpy as np

from basestream.llm import packing as P
from basestream.llm import token_pack as T

from tests.llm.helpers import documents, empty, frame


def reference_best_fit(pieces, capacity, most):
    """The same rule by looking at every bin: tightest compatible, then the oldest."""
    bins = []
    for size, source, cluster in pieces:
        fits = [(capacity - b["used"], k) for k, b in enumerate(bins) if capacity - b["used"] >= size and b["s"].count(source) < most and (cluster is None or cluster not in b["c"]) and (capacity > b["used"] or size == 0)]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append({"used": 0, "s": [], "c": set()})
        bins[k]["used"] += size
        bins[k]["s"].append(source)
        bins[k]["c"].add(cluster)
        yield k


def test_best_fit_is_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    pieces = sorted(((int(s), int(k), int(c)) for s, k, c in zip(rng.integers(1, 60, 300), rng.integers(0, 4, 300), rng.integers(0, 40, 300))), reverse=True)
    bins = P.BestFit(64, 2)
    assert [bins.place(s, k, c)[0] for s, k, c in pieces] == list(reference_best_fit(pieces, 64, 2))


def check(rows, docs, capacity, most):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r["bin_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for rs in by_bin.values():
        assert sum(r["n_tokens"] for r in rs) == rs[0]["bin_tokens"] <= capacity
        at = 0
        for r in sorted(rs, key=lambda r: (r["bin_offset"], r["n_tokens"])):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert max(sum(x["source"] == r["source"] for x in rs) for r in rs) <= most
        assert len({r["cluster"] for r in rs}) == len(rs)
    assert {d: sum(r["n_tokens"] for r in rs) for d, rs in by_doc.items()} == {d: len((t or "").split()) for d, t, *_ in docs}
    for rs in by_doc.values():
        rs.sort(key=lambda r: r["piece"])
        assert [r["first_token"] for r in rs] == [k * capacity for k in range(len(rs))]


def test_pack_documents(spark):
    docs = documents()
    rows = P.pack_documents(frame(spark, docs), capacity=200, max_per_source=2, shard_tokens=2500).collect()
    check(rows, docs, 200, 2)
    assert P.pack_documents(empty(spark)).count() == 0


def test_token_rows_round_trip(spark):
    docs = documents()
    rows = T.token_rows(frame(spark, docs), capacity=128, shard_chars=8000).collect()
    encode = T.Encoder(open(T.VOCABULARY, "rb").read())
    got = T.unpack([(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], bytes(r["input_ids"])) for r in rows])
    assert {d: v.tolist() for d, v in got.items()} == {d: encode(t).tolist() for d, t, *_ in docs}
    for r in rows:
        assert r["cu_seqlens"][-1] == r["n_tokens"] <= 128 and r["position_resets"] == r["cu_seqlens"][:-1] and len(r["input_ids"]) == 256
        assert (np.frombuffer(bytes(r["input_ids"]), np.uint16)[r["n_tokens"] :] == T.END_OF_TEXT).all()
    assert T.token_rows(empty(spark)).count() == 0


def test_capacity_tree_is_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 150, 400).tolist()
    rows = T.pack(sizes, 100)
    assert all(sum(n for _, _, n in r) <= 100 for r in rows)
    assert sorted((d, f, n) for r in rows for d, f, n in r) == sorted((d, f, min(100, s - f)) for d, s in enumerate(sizes) for f in range(0, max(s, 1), 100))
    free: list[int] = []
    for n in sorted((p[2] for r in rows for p in r), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(100 - n)
    assert sorted(free) == sorted(100 - sum(n for _, _, n in r) for r in rows)


def test_one_source_and_large_clusters_stay_fast():
    import time

    began = time.time()
    rows = P.pack(((k, 10, "only", f"c{k % 3 if k % 2 else k}") for k in range(20_000)), 2048, 4)
    assert len(rows) == 20_000 and time.time() - began < 20
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r[0], []).append(r[9])
    assert all(len(c) <= 4 and len(set(c)) == len(c) for c in by_bin.values())


def test_search_with_large_clusters_is_the_tightest():
    rng = np.random.default_rng(5)
    pieces = sorted(((int(s), int(k), int(c)) for s, k, c in zip(rng.integers(0, 60, 400), rng.integers(0, 3, 400), rng.integers(0, 5, 400))), reverse=True)
    bins = P.BestFit(64, 3, 400)

    def plain():
        made = []
        for size, source, cluster in pieces:
            fits = [(64 - b["used"], k) for k, b in enumerate(made) if 64 - b["used"] >= size and b["s"].count(source) < 3 and cluster not in b["c"]]
            k = min(fits)[1] if fits else len(made)
            if k == len(made):
                made.append({"used": 0, "s": [], "c": set()})
            made[k]["used"] += size
            made[k]["s"].append(source)
            made[k]["c"].add(cluster)
            yield k

    assert [bins.place(s, k, c, c < 3)[0] for s, k, c in pieces] == list(plain())


def test_wide_vocabulary_and_matrix_files(spark, tmp_path):
    import base64
    import glob

    ranks = [bytes([b]) for b in range(256)] + [b"the", b"an"]
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(k if k < 256 else k + 70_000).encode() for k, t in enumerate(ranks)))
    docs = [(1, "an ant the theme", "", "", 0), (None, "the", "", "", 0), (3, None, "", "", 0)]
    df = T.token_rows(frame(spark, docs), vocabulary=str(path), capacity=16, pad=0)
    encode = T.Encoder(path.read_bytes())
    got = T.unpack([(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], bytes(r["input_ids"])) for r in df.collect()], np.uint32)
    assert {d: v.tolist() for d, v in got.items()} == {d: encode(t).tolist() for d, t, *_ in docs} and max(got[1]) > 70_000
    T.write_matrices(df, str(tmp_path / "out"))
    matrices = [T.read_matrix(p, np.uint32) for p in glob.glob(str(tmp_path / "out/ids/*.parquet"))]
    assert sum(e[-1] for _, ends, _ in matrices for e in ends) == sum(len(v) for v in got.values())
    assert all(m.shape[1] == 16 for m, ends, _ in matrices if ends)
