from pyspark.sql import functions as F

from basestream.functions import cigar, sequence, tags
from basestream.operators import alignments, reference, signal
from basestream.operators.ordering import number_rows


def test_cigar_round_trip_and_spans(spark):
    df = spark.createDataFrame([("10M2I3D4N5S6H7P8=9X",), ("*",), ("5Q",)], "c string")
    rows = df.select(
        cigar.render(cigar.parse(F.col("c"))).alias("back"), cigar.reference_span(cigar.parse(F.col("c"))).alias("r"), cigar.query_span(cigar.parse(F.col("c"))).alias("q")
    ).collect()
    assert rows[0]["back"] == "10M2I3D4N5S6H7P8=9X" and (rows[0]["r"], rows[0]["q"]) == (34, 34)
    assert rows[1]["back"] == "*" and (rows[1]["r"], rows[1]["q"]) == (0, 0)
    assert rows[2]["back"] is None


def test_reg2bin(spark):
    cases = [(0, 1, 4681), (16383, 16385, 585), (0, 1 << 29, 0), (1 << 26, (1 << 26) + 5, 4681 + (1 << 12))]
    df = spark.createDataFrame([c[:2] for c in cases], "s long, e long")
    assert [r[0] for r in df.select(cigar.reg2bin(F.col("s"), F.col("e"))).collect()] == [c[2] for c in cases]


def test_quality_bins_and_reverse_complement(spark):
    got = [r[0] for r in spark.range(0, 45).orderBy("id").select(sequence.bin_quality(F.col("id"))).collect()]
    assert [got[i] for i in (0, 1, 2, 9, 10, 20, 25, 30, 35, 39, 40, 44)] == [0, 1, 6, 6, 15, 22, 27, 33, 37, 37, 40, 40]
    assert spark.range(1).select(sequence.reverse_complement(F.lit("ACGTNacgt"))).first()[0] == "acgtNACGT"


def test_tags(spark):
    df = spark.createDataFrame([(["NM:i:5", "XA:Z:a:b", "X1:A:c"],)], "t array<string>")
    t = tags.parse(F.col("t"))
    assert df.select(tags.render(tags.keep(t, ["X[A-Z]"]))).first()[0] == ["XA:Z:a:b"]
    assert df.select(tags.render(tags.drop(t, ["X."]))).first()[0] == ["NM:i:5"]


def test_number_rows_is_dense_and_ordered(spark):
    df = number_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7), [F.col("v")], "n")
    assert sorted((r["v"], r["n"]) for r in df.collect()) == [(i, i + 1) for i in range(1000)]
    assert number_rows(spark.range(0), [F.col("id")], "n").count() == 0


def test_array_deltas_undo(spark):
    a = spark.range(1).select(signal.array_deltas(F.array(*[F.lit(x) for x in (5, 9, 2)]), 1).alias("d")).first()[0]
    assert a == [5, 4, 65529]


def test_attack_decay_fold(spark):
    values = [0.0, 500.0, 2000.0, 100.0, 50.0]
    m, want = 100.0, []
    for v in values:
        m = max(100.0, m + (v - m) / 20 if v > m else m - (m - v) / 10)
        want.append(int(min(32767.0, v * 2000.0 / m)))
    assert spark.range(1).select(signal.attack_decay(F.array(*[F.lit(v) for v in values]))).first()[0] == want


def test_md_nm_of_fixture(spark):
    """Reads whose stored MD and NM are the expected values."""
    ref = spark.createDataFrame([("xx", "AAAAAAAAAATTTTTYTTTTCCCCCCCCCC")], "name string, bases string")
    cases = [
        ("10M", "AAAAATTTTT", "10", 0), ("11M", "AAAAGRTTTTT", "4A0T4Y0", 3), ("10M", "GAAAATTTTG", "0A8T0", 2), ("5M1I5M", "AAAAAGTTTTT", "10", 1),
        ("10M2P2I", "AAAAATTTTTCC", "10", 2), ("5M10D5M", "AAAAACCCCC", "5^TTTTTYTTTT5", 10), ("5M10N5M", "AAAAACCCCC", "10", 0),
        ("1S4M10D5I4M1S", "AAAAAGGGGGCCCCC", "4^ATTTTTYTTT0T3", 16),
    ]
    aln = spark.createDataFrame([(k, "xx", 5, c, s) for k, (c, s, _, _) in enumerate(cases)], "file_ord long, rname string, pos long, cigar string, seq string")
    for size in (1 << 16, 7):
        got = {r["file_ord"]: (r["md"], r["nm"]) for r in reference.with_md_nm(aln, ref, size).collect()}
        assert got == {k: (md, nm) for k, (_, _, md, nm) in enumerate(cases)}


def test_trace_functions(spark):
    from basestream.functions import trace

    one = spark.range(1)
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one.select(trace.separate_dyes([arr(1, 2), arr(3, 4)], [[1.0, -1.0], [0.5, 0.5]])[1]).first()[0] == [2, 3]
    assert one.select(trace.max_called(arr(5, 9, 2, 30), arr(0, 2))).first()[0] == 5
    assert one.select(trace.comments(F.lit("NAME=a=b\nxx\nMACH=m"))).first()[0] == {"NAME": "a=b", "MACH": "m"}
    assert one.select(trace.unique_id(F.lit("x"), arr("x", "x.1", "y")), trace.unique_id(F.lit("z"), arr("x"))).first()[:] == ("x.2", "z")
    assert one.select(trace.pair_means(arr(4)), trace.background_level(arr(0, 0))).first()[:] == ([], 0)


def test_locate(spark, tmp_path):
    import io
    import tarfile

    from basestream.sources import search

    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.gz").write_bytes(b"abc")
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for name in ("one", "two"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"xy"))
    names = spark.createDataFrame([("one",), ("two",), ("three",)], "name string")
    find = lambda p: {r["name"]: r["found"] for r in search.locate(spark, names, p).collect()}
    assert find(f"{tmp_path}/d:TAR={tmp_path}/t.tar") == {"one": "one.gz", "two": "two", "three": None}
    assert find(f"|{tmp_path}/d:TAR={tmp_path}/t.tar") == {"one": "one", "two": "two", "three": None}
    (tmp_path / "list.txt").write_text("a\n\n b \n")
    assert search.file_list(spark, str(tmp_path / "list.txt")) == ["a", "b"]


def test_pileup_walks_the_cigar(spark):
    text = lambda *q: "".join(chr(x + 33) for x in q)
    reads = spark.createDataFrame([
        (0, 10, 1, 0, 20, "2S3M2I2M", "TTACGGGAC", text(2, 2, 30, 31, 32, 33, 34, 35, 36)),
        (0, 11, 2, 16, 0, "2M2D1M3H", "CGT", text(40, 30, 11)),
        (0, 12, 3, 0, 93, "1M2N1M", "ga", text(21, 41)),
        (1, 5, 4, 16, 7, "2M", "*", "*"),
        (1, 5, 5, 0, 7, "*", "AC", "II"),
        (2, 5, 6, 0, 7, "3I2M2I1P1I2M4S", "TTTACGGTCATTTT", text(*range(20, 34))),
    ], "ref_id int, pos long, file_ord long, flag int, mapq int, cigar string, seq string, qual string")
    bases = alignments.read_bases(reads)
    rows = {(r["ref_id"], r["pos"]): (r["depth"], r["bases"], r["quals"]) for r in alignments.pileup(bases).collect()}
    assert rows == {
        (0, 10): (1, "^5A", text(30)), (0, 11): (2, "C^!c", text(31, 40)), (0, 12): (3, "G+2GGg^~G$", text(34, 15, 36)),
        (0, 13): (3, "A*.$", text(35, 13, 0)), (0, 14): (3, "C$*.$", text(36, 12, 0)), (0, 15): (2, "t$^~A$", text(11, 41)),
        (1, 5): (1, "^(n", "~"), (1, 6): (1, "n$", "~"),
        (2, 5): (1, "^(A", text(23)), (2, 6): (1, "C+3GGT", text(27)), (2, 7): (1, "C", text(28)), (2, 8): (1, "A$", text(29)),
    }
    alone = {r["pos"]: (r["bases"], r["quals"]) for r in alignments.pileup(bases, F.col("file_ord") == 2).collect()}
    assert alone == {11: ("^!c", text(40)), 12: ("g", text(30)), 13: ("*", text(20)), 14: ("*", text(15)), 15: ("t$", text(11))}
    cols = {(r["ref_id"], r["pos"], r["nth"]): (r["depth"], r["bases"], r["quals"]) for r in alignments.pileup_columns(bases).collect()}
    assert [cols[0, 12, n] for n in range(3)] == [(3, "GGG", text(32, 30, 21)), (3, "G**", text(33, 20, 31)), (3, "G**", text(34, 15, 36))]
    assert cols[0, 13, 0] == (3, "A*.", text(35, 13, 0)) and (0, 13, 1) not in cols
    assert [cols[2, 6, n][1:] for n in range(5) if (2, 6, n) in cols] == [("C", text(24)), ("G", text(25)), ("G", text(26)), ("*", text(26)), ("T", text(27))]


def test_tag_patterns_are_no_free_expressions(spark):
    import pytest
    from pyspark.sql import functions as F

    from basestream.functions import tags

    df = spark.createDataFrame([({"XA": 1, "NM": 2},)], "t map<string,int>")
    assert df.select(tags.keep(F.col("t"), ["X[A-C]"])).first()[0] == {"XA": 1} and df.select(tags.drop(F.col("t"), ["[^X]."])).first()[0] == {"XA": 1}
    for bad in ("X", "X.*", "(X|N)A", "XAB"):
        with pytest.raises(ValueError):
            tags.keep(F.col("t"), [bad])
