"""Archives of short reads, tar archives, and block metadata of columnar alignment files.

A read archive is a sequence of blocks; a read's trace is the header block's bytes
followed by its own. ``read_archive`` gives one row per read with its chunks, so the
filters and counts over chunks are DataFrame operations.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.sources.traces import ztr_chunks

CHUNK = pa.struct([("type", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("size", pa.int64()), ("data", pa.binary())])
READS = "archive string, ord long, header_no long, name string, flags int, chunks array<struct<type:string,metadata:map<string,string>,size:bigint,data:binary>>"


def _text(data: bytes, at: int) -> tuple[bytes, int]:
    return data[at + 1 : at + 1 + data[at]], at + 1 + data[at]


def archive_reads(data: bytes, ended: list[int] | None = None) -> Iterator[tuple[int, int, str, int, list]]:
    """(order, header number, name, flags, chunks). Concatenated archives are read on; a
    block that is cut off or unknown ends the archive, at the place that ``ended`` is given."""
    at, header, prefix, head_no, order = 0, b"", b"", -1, 0
    ended = [0] if ended is None else ended
    while at < len(data):
        ended[:] = [at]
        kind = data[at : at + 1]
        if kind == b"\0":  # the eight bytes of an absent index
            at += 8
            continue
        if kind == b"S":
            size = struct.unpack_from(">I", data, at + 4)[0]
        elif kind in (b"X", b"H", b"R"):
            size = struct.unpack_from(">I", data, at + 1)[0]
        elif kind == b"I":
            size = struct.unpack_from(">Q", data, at + 8)[0]
        else:
            return
        block = data[at : at + size]
        if size < 5 or len(block) < size:
            return
        at += size
        if kind == b"H":
            prefix, k = _text(block, 6)
            header, head_no = block[k:], head_no + 1
        elif kind == b"R":
            suffix, k = _text(block, 6)
            whole = header + block[k:]
            chunks = [(t, _metadata(m), len(d), d) for t, m, d in ztr_chunks(whole)]
            yield order, head_no, (prefix + suffix).decode("latin-1"), block[5], chunks
            order += 1
    ended[:] = [min(at, len(data))]


def _metadata(m: bytes) -> list[tuple[str, str]]:
    parts = m.decode("latin-1").split("\0")
    return list(zip(parts[::2], parts[1::2]))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Reads of archives: (archive, ord, header_no, name, flags, chunks)."""
    names = [c.split()[0] for c in READS.replace("array<struct<type:string,metadata:map<string,string>,size:bigint,data:binary>>", "x").split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(CHUNK)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)]
        chunks = [[dict(zip(("type", "metadata", "size", "data"), c)) for c in r[5]] for r in rows]
        return pa.RecordBatch.from_arrays([*cols, pa.array(chunks, kinds[5])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for r in archive_reads(data):
                    rows.append((name, *r))
                    if len(rows) == 2000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READS)


def good_reads(reads: DataFrame, mask: int = 3) -> DataFrame:
    return reads.where(F.col("flags").bitwiseAND(mask) == 0)


def keep_chunks(chunks: Column, types: list[str], processes: list[str] | None = None) -> Column:
    """Chunks of the given types; of samples only those of the given processes, where no
    TYPE counts as PROC."""

    def good(c: Column) -> Column:
        hit = c["type"].isin(*types)
        if processes is not None:
            hit = hit & (~c["type"].isin("SAMP", "SMP4") | F.coalesce(F.element_at(c["metadata"], "TYPE"), F.lit("PROC")).isin(*processes))
        return hit

    return F.filter(chunks, good)


def chunk_counts(reads: DataFrame) -> DataFrame:
    each = reads.select(F.explode("chunks").alias("c"))
    return each.groupBy(F.col("c.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum("c.size").alias("bytes"))


def metadata_counts(reads: DataFrame) -> DataFrame:
    each = reads.select(F.explode("chunks").alias("c")).select(F.col("c.type").alias("type"), F.explode("c.metadata"))
    return each.groupBy("type", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, position, size) of the members of tar files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    rows += [(name, m.name, m.offset_data, m.size) for m in t if m.isfile()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["archive", "name", "position", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, position long, size long")


def extract(spark: SparkSession, index: DataFrame, path: str) -> DataFrame:
    """(name, data) of indexed entries: an equi-join of index and archives."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
    data = F.substring("content", (F.col("position") + 1).cast("int"), F.col("size").cast("int"))
    return index.join(files, "archive").select("name", data.alias("data"))


#: Names of block methods, in the order of their codes.
METHODS = ("raw", "gzip", "bzip2", "lzma", "rans", "ranspr", "arith", "fqz", "tok3")


def itf8(d: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer and the place after it."""
    b = d[at]
    n = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1 if b >= 0x80 else 0
    if n == 4:
        v = (b & 15) << 28 | d[at + 1] << 20 | d[at + 2] << 12 | d[at + 3] << 4 | d[at + 4] & 15
    else:
        v = b & (0xFF >> (n + 1) if n else 0x7F)
        for k in range(n):
            v = v << 8 | d[at + 1 + k]
    return (v - (1 << 32) if v >> 31 else v), at + 1 + n


def ltf8(d: bytes, at: int) -> tuple[int, int]:
    b, n = d[at], 0
    while n < 8 and b & 0x80 >> n:
        n += 1
    v = b & (0x7F >> n) if n < 7 else 0
    for k in range(n):
        v = v << 8 | d[at + 1 + k]
    return v, at + 1 + n


def container_blocks(d: bytes) -> Iterator[tuple]:
    """(container, ref_id, start, span, records, block, method, content_type, content_id,
    comp_size, size) of a version 2 or 3 file, from headers alone."""
    if d[:4] != b"CRAM" or d[4] not in (2, 3):
        raise ValueError("not a columnar alignment file of version 2 or 3")
    three, at, no = d[4] == 3, 26, 0
    while at + 4 <= len(d):
        length = struct.unpack_from("<i", d, at)[0]
        k = at + 4
        ref, k = itf8(d, k)
        start, k = itf8(d, k)
        span, k = itf8(d, k)
        records, k = itf8(d, k)
        _, k = ltf8(d, k) if three else itf8(d, k)
        _, k = ltf8(d, k)
        count, k = itf8(d, k)
        marks, k = itf8(d, k)
        for _ in range(marks):
            _, k = itf8(d, k)
        if three:
            if zlib.crc32(d[at:k]) != struct.unpack_from("<I", d, k)[0]:
                raise ValueError(f"container {no}: checksum")
            k += 4
        end, block = k + length, 0
        while k < end and block < count:
            method, kind = d[k], d[k + 1]
            cid, j = itf8(d, k + 2)
            comp, j = itf8(d, j)
            size, j = itf8(d, j)
            yield no, ref, start, span, records, block, METHODS[method] if method < len(METHODS) else str(method), kind, -1 if kind == 5 else cid, comp, size
            k, block = j + comp + (4 if three else 0), block + 1
        at, no = end, no + 1


BLOCKS = "container long, ref_id long, start long, span long, records long, block long, method string, content_type long, content_id long, comp_size long, size long"


def read_block_table(spark: SparkSession, path: str) -> DataFrame:
    """The ``blocks`` table of ``operators.statistics``: no block is inflated."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = list(container_blocks(data))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if n == "method" else pa.int64()) for k, n in enumerate(names)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, BLOCKS)


def read_range_index(spark: SparkSession, path: str) -> DataFrame:
    """Compressed six-column range index."""
    schema = "ref_id int, start long, span long, container_offset long, slice_offset long, slice_bytes long"
    return spark.read.csv(path, sep="\t", schema=schema).withColumn("end", F.col("start") + F.col("span") - 1)


def write_range_index(slices: DataFrame, path: str) -> None:
    cols = ["ref_id", "start", "span", "container_offset", "slice_offset", "slice_bytes"]
    slices.select(*cols).orderBy("container_offset", "slice_offset").write.option("compression", "gzip").csv(path, sep="\t")


def archive_names(reads: DataFrame, long_form: bool = False) -> DataFrame:
    """Names of archived reads in their order; in long form with flags, chunks and bytes."""
    if not long_form:
        return reads.select("archive", "ord", "name")
    size = F.aggregate(F.transform("chunks", lambda c: c["size"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return reads.select("archive", "ord", "name", "flags", F.size("chunks").alias("n_chunks"), size.alias("bytes"))


def name_index(reads: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """An index by name: (bucket, check, archive, ord, name), the bucket from a 64-bit hash of
    the name and the check from seven more of its bits."""
    h = F.xxhash64("name")
    return reads.select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), F.shiftrightunsigned(h, 57).cast("int").alias("check"), "archive", "ord", "name")


def check_index(index: DataFrame, reads: DataFrame) -> DataFrame:
    """Rows that index and archive don't share, in one row of counts: all 0 if it holds."""
    key = ["archive", "ord", "name"]
    lost = reads.select(*key).exceptAll(index.select(*key)).agg(F.count(F.lit(1)).alias("not_indexed"))
    return lost.crossJoin(index.select(*key).exceptAll(reads.select(*key)).agg(F.count(F.lit(1)).alias("not_there")))


def extract_named(reads: DataFrame, index: DataFrame, names: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """Archived reads of the given names by the index: bucket, check, then the name itself."""
    h = F.xxhash64("name")
    asked = names.select("name").distinct().select("name", F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), F.shiftrightunsigned(h, 57).cast("int").alias("check"))
    hits = index.join(asked, ["bucket", "check", "name"], "left_semi").select("archive", "ord")
    return reads.join(hits, ["archive", "ord"], "left_semi")


def archive_ends(spark: SparkSession, path: str) -> DataFrame:
    """(archive, size, read_to, reads): where reading of each archive ends; an archive that
    is cut off, or has a block of no known kind, ends before its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ended = [0]
                n = sum(1 for _ in archive_reads(data, ended))
                rows.append((name, len(data), ended[0], n))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["archive", "size", "read_to", "reads"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, size long, read_to long, reads long")
