"""Functions and sources without a table of their own."""

import bz2
import gzip
import lzma
import random

import pytest
from pyspark.sql import functions as F

from basestream.functions import codecs, names
from basestream.functions import records as rec
from basestream.functions import trace
from basestream.operators import alignments as al
from basestream.operators import lookups, reference
from basestream.sources import archives, bam, detect, fasta
from tests.test_sources import HEADER, rows


def test_template_names_round_trip():
    assert names.template_name("run_%2.4x:%d%%", bytes([0x12, 0x3A])) == "run_0a:291%"
    assert names.template_name("%.8c%s", b"efA") == "Afe"
    for form, name, n in (("r:%4.16d:%3.12X", "r:0451:0AF", 4), ("%.6j-%.10o", "1f-1777", 2)):
        assert names.template_name(form, names.template_suffix(form, name, n)) == name
    with pytest.raises(ValueError):
        names.template_suffix("a%d", "b1", 2)


def test_paths_formats_profiles():
    assert names.cache_path("/c/%2s/%2s/%s", "abcdef") == "/c/ab/cd/ef" and names.cache_path("/c", "ab") == "/c/ab"
    assert names.cache_path("/c/%2s", "abcd") == "/c/ab/cd" and names.cache_path("/c%%", "a") == "/c%%/a"
    assert names.command_line(["a", "b\tc"]) == "a b c"
    env = {"REF_CACHE": "/cache/%2s/%s", "REF_PATH": "/one:http://host/get/%s"}
    assert names.reference_places("abcd", {"UR": "x.fa"}, env) == ["/cache/ab/cd", "/one/abcd", "http://host/get/abcd", "x.fa"]
    assert [names.format_by_name(x) for x in ("a.sam", "a.BAM", "a.cram", "a.Bam", "bam")] == ["sam", "bam", "cram", None, None]
    assert names.profile("small")["records"] == 25_000 and names.profile("archive")["bases"] == 50_000_000
    with pytest.raises(ValueError):
        names.profile("x")
    assert names.series_of(["mapq"]) == {"MQ", "BF"} and {"FC", "FP", "FN", "RL", "RI", "BF"} <= names.series_of(["seq"]) and "CF" in names.series_of(["qname"], names_stored=False)


def test_codecs():
    class Writer(list):
        def put(self, value, n):
            self += [value >> k & 1 for k in range(n - 1, -1, -1)]

        def data(self):
            bits = self + [0] * (-len(self) % 8)
            return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))

    values = [1, 2, 3, 9, 30, 255]
    b, g, s = Writer(), Writer(), Writer()
    for v in values:
        b.put(v + 5, 9)
        n = (v + 1).bit_length()
        g.put(0, n - 1), g.put(v + 1, n)
        if v < 8:
            s.put(0, 1), s.put(v, 3)
        else:
            n = v.bit_length() - 1
            s.put((1 << (n - 2)) - 1, n - 2), s.put(0, 1), s.put(v - (1 << n), n)
    for w, read in ((b, codecs.beta(5, 9)), (g, codecs.gamma(1)), (s, codecs.subexponential(0, 3))):
        bits = codecs.BitReader(w.data())
        assert [read(bits) for _ in values] == values
    h = codecs.huffman([65, 66, 67], [1, 2, 2])
    bits = codecs.BitReader(bytes([0b01011000]))
    assert [h(bits) for _ in range(3)] == [65, 66, 67] and codecs.huffman([7], [0])(codecs.BitReader(b"")) == 7
    for v in (0, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**32 - 1):
        assert codecs.varint(codecs.varint_bytes(v) + b"x") == (v, len(codecs.varint_bytes(v)))
    assert codecs.undelta([2, 1, 4], True) == [1, 0, 2] and codecs.undelta([1, 1], False) == [1, 2] and codecs.constant(3, 2) == [3, 3]
    assert codecs.unpack_bits(bytes([0b00011011]), 4, [9, 8, 7, 6]) == [6, 7, 8, 9] and codecs.unpack_bits(b"", 3, [5]) == [5, 5, 5]
    assert codecs.unrun([1, 2, 1], [2, 0], {1}) == [1, 1, 1, 2, 1]
    assert codecs.byte_array_stop(b"ab\0c", 0, 0) == (b"ab", 3) and codecs.byte_array_len(b"abc", 1, 2) == (b"bc", 3)
    raw = bytes(random.Random(1).randrange(4) for _ in range(999))
    for method, packed in ((0, raw), (1, gzip.compress(raw)), (2, bz2.compress(raw)), (3, lzma.compress(raw))):
        assert codecs.inflate(method, packed, 999) == raw == codecs.open_bytes(packed)
    with pytest.raises(ValueError):
        codecs.inflate(1, gzip.compress(raw), 998)
    with pytest.raises(ValueError):
        codecs.inflate(9, raw, 999)


def test_edited_positions():
    assert trace.edited_positions([10, 20, 30], [1, 0, 2, 3, 0, 0], 60) == [10, 15, 20, 30, 40, 50]
    assert trace.edited_positions([10, 20], [0, 1, 2], 30) == [5, 10, 20]


def test_ranges_and_runs(spark):
    assert al.parse_range("r:5") == ("r", 5, 5) and al.parse_range("r") == ("r", None, None) and al.parse_range("*") == (None, None, None)
    for bad in ("r:x", "r:1-", "r:"):
        with pytest.raises(ValueError):
            al.parse_range(bad)
    df = spark.createDataFrame([(1, 5), (2, 5), (200, 5), (500, 6)], "file_ord long, ref_id int")
    assert [r["run_start"] for r in al.ref_runs(df, 64).orderBy("file_ord").collect()] == [1, 1, 1, 500]


def test_reads_without_reference_stay(spark):
    ref = spark.createDataFrame([("r0", "ACGTACGT")], "name string, bases string")
    aln = spark.createDataFrame([(1, "r0", 1, "4M", "CGTT"), (2, None, -1, "*", "AC"), (3, "no", 3, "2M", "AC"), (4, "r0", 0, "2M", "*")], "file_ord long, rname string, pos long, cigar string, seq string")
    got = {r["file_ord"]: (r["nm"], r["md"]) for r in reference.with_md_nm(aln, ref).collect()}
    assert got == {1: (1, "3A0"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_bam_overwrite_folders_and_cut_files(spark, tmp_path):
    bam.register(spark)
    folder = str(tmp_path / "out")
    df = spark.createDataFrame(rows(3000), bam.ALIGNMENTS)
    df.repartition(5).write.format("bam").mode("append").option("header", HEADER).save(folder)
    df.coalesce(2).write.format("bam").mode("overwrite").option("header", HEADER).save(folder)
    got = spark.read.format("bam").option("runBytes", 15_000).load(folder)
    assert got.count() == 3000 == got.select("qname").distinct().count() == got.select("file_ord").distinct().count() and got.rdd.getNumPartitions() > 4
    df.limit(10).coalesce(1).write.format("bam").mode("append").option("header", HEADER).save(folder)
    assert spark.read.format("bam").load(folder).count() == 3010
    assert detect.detect(spark, sorted(bam.files_of(folder))[0]) == "bam" and detect.open_alignments(spark, sorted(bam.files_of(folder))[0]).count() > 0
    quick = spark.read.format("bam").option("runBytes", 15_000).option("columns", "flag,ref_id,pos,mapq,mate_ref_id,pnext,tlen,file_ord").load(folder)
    fields = ["file_ord", "flag", "ref_id", "pos", "mapq", "mate_ref_id", "pnext", "tlen"]
    full = spark.read.format("bam").option("runBytes", 15_000).load(folder)
    assert sorted(quick.select(*fields).collect()) == sorted(full.select(*fields).collect()) and quick.where("seq is not null or qname is not null").count() == 0
    assert quick.where("ref_id = 1 and pos >= 6000").count() == full.where("ref_id = 1 and pos >= 6000").count() > 0
    whole = max((open(x, "rb").read() for x in bam.files_of(folder)), key=len)
    (tmp_path / "cut.bam").write_bytes(whole[:-40])
    assert 0 < spark.read.format("bam").load(str(tmp_path / "cut.bam")).count() < 3000
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("bam").option("failOnTruncated", "true").load(str(tmp_path / "cut.bam")).count()


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">one first\nACGT\nAC\n>two\nGGGGG\nTTTTT\nA\n")
    got = fasta.read_fasta(spark, str(p))
    assert {(r["name"], r["description"], r["bases"]) for r in got.collect()} == {("one", "first", "ACGTAC"), ("two", "", "GGGGGTTTTTA")}
    index = [tuple(r) for r in fasta.build_index(spark, str(p)).collect()]
    assert index == [("one", 6, 11, 4, 5), ("two", 11, 24, 5, 6)]
    (tmp_path / "x.fai").write_text("\n".join("\t".join(map(str, r)) for r in index))
    assert [tuple(r) for r in fasta.read_index(spark, str(tmp_path / "x.fai")).collect()] == index
    assert fasta.portion(got, "two", 5, 7).first()["bases"] == "GTT" and fasta.portion(got, "one", 2).first()["bases"] == "CGTAC"
    digests = fasta.with_digests(got).where("name = 'one'").select("md5")
    md5 = digests.first()["md5"]
    (tmp_path / md5[:2]).mkdir()
    (tmp_path / md5[:2] / md5[2:]).write_text("ACGTAC")
    assert fasta.by_digest(spark, digests, [str(tmp_path / "none"), str(tmp_path) + "/%2s/%s"]).first()["bases"] == "ACGTAC"


def test_archive_index_and_header(spark):
    chunk = "array<struct<type:string,metadata:map<string,string>,size:bigint,data:binary>>"
    reads = spark.range(50).select(F.lit("a").alias("archive"), F.col("id").alias("ord"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit(0).alias("flags"), F.array().cast(chunk).alias("chunks"))
    index = archives.name_index(reads)
    assert tuple(archives.check_index(index, reads).first()) == (0, 0) and tuple(archives.check_index(index.where("ord > 3"), reads).first()) == (4, 0)
    asked = spark.createDataFrame([("n7",), ("n9",), ("zz",)], "name string")
    assert sorted(r["name"] for r in archives.extract_named(reads, index, asked).collect()) == ["n7", "n9"]
    assert archives.archive_names(reads).count() == 50 and archives.archive_names(reads, True).first()["bytes"] == 0
    lines = spark.createDataFrame([(0, "RG", {"ID": "x"}), (1, "SQ", {"SN": "r"}), (2, "RG", {"ID": "y"})], "line_no long, type string, tags map<string,string>")
    assert {(r["id"], r["name"]) for r in detect.read_groups_of(lines).collect()} == {(0, "x"), (1, "y")}
    assert lookups.find_header(lines, "RG", "ID", "y").first()["line_no"] == 2 and lookups.find_header(lines, "RG").count() == 2
    got = spark.createDataFrame([({"B1": ("B", "s,1,-2"), "C1": ("A", "q")},)], "t map<string,struct<type:string,value:string>>").select(rec.tag_array(F.col("t"), "B1").alias("b"), rec.tag_char(F.col("t"), "C1").alias("c")).first()
    assert (got["b"], got["c"]) == ([1.0, -2.0], "q")
