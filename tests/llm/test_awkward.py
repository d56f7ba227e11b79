"""Every operator and stage on awkward input: clashing columns, null and repeated ids, null,
empty and very long texts, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from basestream.llm import decontaminate, fingerprints, jaccard_join, licenses, line_dedup, packing, quality, secrets, token_pack, toxicity

CLASHES = ["drop_id", "drop_keys", "gone_id", "row_key", "hit_spans", "hit_items", "n_words", "score", "predicted", "n_lines", "n_dropped", "kept_sha256", "shard", "b", "sketch", "w", "s", "cls"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_text():
    """About 10 MB, a quarter of it one line."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(50_000)}" for _ in range(400_000)]
    return " ".join(words) + "\n" + "\n".join(" ".join(words[k : k + 12]) for k in range(0, 400_000, 12)) + "\n" + "x" * 5_000_000


@pytest.fixture(scope="module")
def odd(spark, long_text):
    near = " ".join(f"v{k}" for k in range(80))
    rows = [
        (None, near, "en", None, None), (None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, near, "en", "s", 5), (2, near, "en", "s", 5),
        (3, near + " tail", "en", "s", 5), (4, long_text, "en", "t", 5), (5, "  \t \n \n", "en", "t", 5), (6, "one", "en", "t", 5), (7, "A line of more than twenty characters\n" * 3, "en", "t", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(None, 1, 1), (1, None, 0), (2, 1, 0), (2, 0, 1), (3, 0, 1), (4, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "v3 v4 v5 v6 v7 v8 v9 v10 v11 v12 v13"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_operators_keep_all_rows(spark, odd, tables):
    n = odd.count()
    labels, bench = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    deduped = line_dedup.dedup_lines(odd)
    assert deduped.count() == n and deduped.where("drop_id = 'own drop_id' and drop_keys = 'own drop_keys'").count() == n
    assert fingerprints.report(fingerprints.fingerprint_documents(odd)).count() == n
    scanned = decontaminate.scan_documents(odd, bench)
    assert scanned.count() == n and scanned.where(F.size("hit_spans") > 0).count() == 4
    assert toxicity.score_toxicity(odd, labels).where("score between 0 and 1").count() == n
    assert quality.score_quality(odd, labels).where("score between 0 and 1").count() == n
    groups = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(odd, 3, "0.9").collect()}
    assert {(2, 78, 2), (3, 79, 2), (None, 78, None), (1, 0, 1), (6, 1, 6)} <= groups and jaccard_join.jaccard_groups(odd).count() == n
    assert secrets.scan_secrets(odd).where("doc_id is not null and doc_id <> 4").count() == 0 and licenses.scan_licenses(odd).count() == 0
    packed = packing.pack_documents(odd, capacity=500)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packed.agg(F.sum("n_tokens")).first()[0] == odd.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")))).first()[0]


def test_long_text_round_trip(spark, odd, long_text):
    rows = token_pack.token_rows(odd.where("doc_id = 4"), capacity=4096).collect()
    with open(token_pack.VOCABULARY, "rb") as f:
        encode = token_pack.Encoder(f.read())
    got = token_pack.unpack([(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], bytes(r["input_ids"])) for r in rows])
    assert encode.library.decode(got[4].tolist()) == long_text


def test_stages_pass_all_columns(spark, odd, tables):
    kept = C.keep_good(spark, odd, tables)
    assert kept.columns == odd.columns and kept.where("score = 'own score' and predicted = 'own predicted'").count() == kept.count()
    lines = C.drop_repeated_lines(spark, odd, tables)
    assert lines.columns == odd.columns and lines.count() == odd.count() and lines.where("n_lines = 'own n_lines' and kept_sha256 = 'own kept_sha256'").count() == odd.count()
    one = C.keep_one_copy(spark, odd, tables)
    assert one.columns == odd.columns and one.where(F.col("text").startswith("v0 v1")).count() == 1 and one.where("gone_id = 'own gone_id' and row_key = 'own row_key'").count() == one.count()
    clean = C.remove_benchmark(spark, odd, tables)
    assert clean.columns == odd.columns and clean.count() == odd.count() and clean.where(F.col("text").contains("v5 v6")).count() == 0
    assert clean.where("hit_spans = 'own hit_spans' and n_words = 'own n_words'").count() == odd.count()
    assert C.pack(spark, odd, tables).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_empty_tables(spark, odd, tables, tmp_path):
    none = odd.limit(0)
    labels, bench = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    for name, stage in C.STAGES:
        assert stage(spark, none, tables).count() == 0, name
    for df in (
        line_dedup.dedup_lines(none), fingerprints.report(fingerprints.fingerprint_documents(none)), decontaminate.scan_documents(none, bench), toxicity.score_toxicity(none, labels),
        quality.score_quality(none, labels), jaccard_join.jaccard_groups(none), secrets.scan_secrets(none), licenses.scan_licenses(none), packing.pack_documents(none), token_pack.token_rows(none),
    ):
        assert df.count() == 0
    few = odd.where("doc_id <> 4")
    few.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    bench.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 5
    assert decontaminate.scan_documents(few, bench.limit(0)).where(F.size("hit_spans") > 0).count() == 0


def test_similar_but_unlinked_texts(spark):
    """Many texts that share long passages below the threshold: no links, and no block too large."""
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"q{rng.randrange(10**7)}" for _ in range(25)]), "en", "s", 0) for k in range(3000)]
    rows += [(10_000 + k, rows[k][1] + " more", "en", "s", 0) for k in range(0, 3000, 100)]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, SCHEMA), 5, "0.8", block_shingles=5000)
    moved = {r["doc_id"]: r["component_id"] for r in got.where("doc_id <> component_id").collect()}
    assert moved == {10_000 + k: k for k in range(0, 3000, 100)}
