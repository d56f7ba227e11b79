import inspect

import corpus_pipeline as C

from basestream.llm import packing

from tests.llm.helpers import frame
from tests.llm.test_classifiers import labelled
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_decontaminate import words
from tests.llm.test_line_dedup import brute as dropped


def test_stages_one_by_one(spark, tmp_path):
    docs, labels = labelled(150)
    line = "This very line stands in a great many documents."
    docs = [(d, t + ("\n" + line if d % 4 == 0 else ""), *r) for d, t, *r in docs]
    docs.append((500, docs[0][1] + " more", "en", "src1", 0))
    item = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh"
    docs.append((501, " ".join(["alpha", "beta"] * 30) + ". " + item + " and on", "en", "src1", 0))
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = frame(spark, docs)
    for k, (name, stage) in enumerate(C.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        if name != "packing":
            assert out.columns == now.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            bad = {d for d, q, _ in labels if q == 0}
            assert len(set(after) & bad) < 0.1 * len(bad) and len(set(after) - bad) > 0.9 * (len(docs) - len(bad))
            assert all(after[d] == before[d] for d in after)
        elif name == "line_dedup":
            want = dropped(list(before.items()))
            assert {d: len(before[d].split("\n")) - len(after[d].split("\n")) for d in after} == {d: min(v[1], v[0] - 1) for d, v in want.items()}
        elif name == "near_copies":
            assert set(before) - set(after) <= {0, 500} and len(set(before) - set(after)) <= 1
        elif name == "decontaminate":
            want = hits(list(before.items()), [(1, item)])
            assert all(len(words(after[d])) == want[d][0] - want[d][1] for d in after) and 501 in after and item not in after[501]
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
        now = out
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "line_dedup", "near_copies", "decontaminate", "packing"]
    assert sorted(r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()) == sorted(r["doc_id"] for r in now.collect())
    assert packing.SCHEMA.split()[0] == "bin_id"
