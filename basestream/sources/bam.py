"""Binary alignment files as a Spark data source.

``spark.read.format("bam")`` splits a file into runs of compressed blocks: a task
inflates its own run only, finds the first record in it, and reads past its end just
far enough to finish its last record. Equality and range filters on ref_id and pos are
pushed down and applied before a record's bases and tags are unpacked; the option
``columns`` names the columns to decode. ``read_blocks`` reads files through Spark's
own binary reader where only that can reach them.
"""

from __future__ import annotations

import operator
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from basestream.model import ALIGNMENTS

#: Base codes, CIGAR operations, the empty block that ends a file.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZE = struct.Struct("<i").unpack_from
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PAIRS = [a + b for a in BASES for b in BASES]
SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def blocks(f, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated data) of the blocks from an offset on. A file that ends inside
    a block ends there."""
    f.seek(start)
    while True:
        at = f.tell()
        head = f.read(18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = head[12:] + f.read(extra - 6)
        k, size = 0, None
        while k + 4 <= extra:
            tag, n = fields[k : k + 2], struct.unpack_from("<H", fields, k + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", fields, k + 4)[0] + 1
            k += 4 + n
        if size is None:
            return
        body = f.read(size - 12 - extra)
        if len(body) < size - 12 - extra:
            return
        yield at, zlib.decompress(body[:-8], -15)


def ends_whole(f) -> bool:
    """Whether the file ends with the empty block that marks its end."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(max(0, size - len(EOF_BLOCK)))
    return f.read() == EOF_BLOCK


def next_block(f, start: int) -> int | None:
    """Offset of the first block from ``start`` on: a block's header whose size leads to
    another header or to the end of the file."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(start)
    # A block has at most 64 KB, so one of them begins and ends in what is read.
    data, at = f.read(3 << 16), -1
    while (at := data.find(b"\x1f\x8b\x08\x04", at + 1)) >= 0:
        if data[at + 12 : at + 16] != b"BC\x02\0" or len(data) < at + 18:
            continue
        then = at + struct.unpack_from("<H", data, at + 16)[0] + 1
        if start + then == end or data[then : then + 4] == b"\x1f\x8b\x08\x04":
            return start + at
    return None


class Header:
    def __init__(self, text: str, refs: list[tuple[str, int]], block: int, inside: int):
        self.text, self.refs, self.block, self.inside = text, refs, block, inside

    @classmethod
    def read(cls, f) -> Header:
        data, marks = b"", []
        need = 12

        def whole() -> tuple[str, list, int] | None:
            nonlocal need
            if len(data) < 12:
                return None
            if data[:4] != b"BAM\1":
                raise ValueError("not a binary alignment file")
            n = struct.unpack_from("<i", data, 4)[0]
            at = 8 + n
            if len(data) < at + 4:
                return None
            refs, count = [], struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(count):
                if len(data) < at + 4 or len(data) < at + 8 + struct.unpack_from("<i", data, at)[0]:
                    return None
                k = struct.unpack_from("<i", data, at)[0]
                refs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<I", data, at + 4 + k)[0]))
                at += 8 + k
            return data[8 : 8 + n].rstrip(b"\0").decode(), refs, at

        for at, d in blocks(f):
            marks.append((at, len(data)))
            data += d
            if (got := whole()) is not None:
                text, refs, end = got
                block, base = [(a, b) for a, b in marks if b <= end][-1]
                return cls(text, refs, block, end - base)
        raise ValueError("the header is cut off")


def plausible(data: bytes, at: int, refs: int) -> int | None:
    """The next record's place if a record may begin here."""
    if len(data) < at + 36:
        return None
    size, ref, pos, name, mapq, _, cigar, flag, bases, mate, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mpos >= -1 and name > 1 and bases >= 0):
        return None
    if size < 32 + name + 4 * cigar + (bases + 1) // 2 + bases or size > 1 << 26:
        return None
    text = data[at + 36 : at + 35 + name]
    if len(text) == name - 1 and (data[at + 35 + name : at + 36 + name] != b"\0" or not all(33 <= c <= 126 for c in text)):
        return None
    return at + 4 + size


def first_record(data: bytes, refs: int) -> int | None:
    """Place of the first record: the first from which records chain on to the end."""
    for at in range(len(data)):
        k, n = at, 0
        while k is not None and len(data) >= k + 36 and n < 8:
            k, n = plausible(data, k, refs), n + 1
        if k is not None and n:
            return at
    return None


def tag_texts(data: bytes) -> list[str]:
    out, k = [], 0
    while k + 3 <= len(data):
        tag, t = data[k : k + 2].decode(), chr(data[k + 2])
        k += 3
        if t == "A":
            out.append(f"{tag}:A:{chr(data[k])}")
            k += 1
        elif t in "ZH":
            end = data.index(0, k)
            out.append(f"{tag}:{t}:{data[k:end].decode()}")
            k = end + 1
        elif t == "B":
            sub, n = chr(data[k]), struct.unpack_from("<i", data, k + 1)[0]
            vals = struct.unpack_from(f"<{n}{SIZES[sub]}", data, k + 5)
            out.append(f"{tag}:B:{sub}" + "".join("," + (f"{v:g}" if sub == "f" else str(v)) for v in vals))
            k += 5 + n * struct.calcsize(SIZES[sub])
        elif t == "d":
            out.append(f"{tag}:d:{struct.unpack_from('<d', data, k)[0]:g}")
            k += 8
        else:
            v = struct.unpack_from("<" + SIZES[t], data, k)[0]
            out.append(f"{tag}:f:{v:g}" if t == "f" else f"{tag}:i:{v}")
            k += struct.calcsize(SIZES[t])
    return out


def decode(d: bytes, refs: list[tuple[str, int]], columns: set[str], order: int) -> tuple:
    """A record without its leading size, as a row of ALIGNMENTS; columns not asked for are null."""
    ref, pos, name, mapq, _, ncig, flag, n, mate, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", d)
    at = 32 + name
    cig = struct.unpack_from(f"<{ncig}I", d, at)
    at += 4 * ncig
    seq = d[at : at + (n + 1) // 2]
    qual = d[at + len(seq) : at + len(seq) + n]
    rest = d[at + len(seq) + n :]
    name_of = lambda i: refs[i][0] if i >= 0 else None
    tags = tag_texts(rest) if "tags" in columns or ncig == 2 else []
    text = "".join(f"{c >> 4}{OPS[c & 15]}" for c in cig) or "*"
    long = next((t for t in tags if t.startswith("CG:B:I")), None)
    if long and ncig == 2 and cig[0] & 15 == 4 and cig[0] >> 4 == n:
        text = "".join(f"{c >> 4}{OPS[c & 15]}" for c in map(int, long.split(",")[1:]))
        tags.remove(long)
    row = {
        "qname": d[32 : 31 + name].decode(), "flag": flag, "ref_id": ref, "rname": name_of(ref), "pos": pos, "mapq": mapq, "cigar": text,
        "mate_ref_id": mate, "rnext": name_of(mate), "pnext": mpos, "tlen": tlen,
        "seq": "".join([PAIRS[b] for b in seq])[:n] if n and "seq" in columns else None,
        "qual": bytes(q + 33 for q in qual).decode() if n and "qual" in columns and qual[0] != 255 else None,
        "tags": tags if "tags" in columns else None, "file_ord": order,
    }
    return tuple(row[f.name] if f.name in columns else None for f in ALIGNMENTS.fields)


#: Columns that the fixed part of a record holds, and that part after its size.
FIXED = {"flag": "flag", "ref_id": "ref", "pos": "pos", "mapq": "mapq", "mate_ref_id": "mate", "pnext": "mate_pos", "tlen": "tlen", "file_ord": ""}
LAYOUT = np.dtype([
    ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4"),
])


def fixed_parts(data: bytes, places: list[int]) -> np.ndarray:
    at = np.array(places)[:, None] + np.arange(4, 4 + LAYOUT.itemsize)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8)[at]).view(LAYOUT).ravel()


class Run(InputPartition):
    """Blocks that begin in [start, end) of a file; inside: where its first record begins in
    its first block, if the header ends there. base: bytes of the files before."""

    def __init__(self, path: str, start: int, end: int, inside: int, base: int):
        self.path, self.start, self.end, self.inside, self.base = path, start, end, inside, base


def files_of(path: str) -> list[str]:
    """The files of a path, folder or pattern, in the order of their names."""
    import glob
    import os

    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(glob.glob(f"{glob.escape(path)}/[!._]*.bam"))
    return [path] if os.path.exists(path) else sorted(glob.glob(path))


class BamReader(DataSourceReader):
    def __init__(self, path: str, run_bytes: int, columns: set[str], whole: bool = False):
        self.path, self.run_bytes, self.columns, self.whole = path, run_bytes, columns, whole
        self.tests: list[tuple[str, str, int]] = []

    def pushFilters(self, filters):
        ops = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and f.attribute[0] in ("ref_id", "pos") and isinstance(f.value, int):
                self.tests.append((f.attribute[0], ops[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        """Ranges of bytes; the task that reads one finds its first block and record, so
        the driver reads no more of a file than its header."""
        import os

        runs, base = [], 0
        for path in files_of(self.path):
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                head = Header.read(f)
                if self.whole and not ends_whole(f):
                    raise ValueError(f"{path} is cut off: its end mark is missing")
            starts = [head.block, *range(head.block + self.run_bytes, size, self.run_bytes)]
            runs += [Run(path, a, z, head.inside if k == 0 else -1, base) for k, (a, z) in enumerate(zip(starts, [*starts[1:], 1 << 62]))]
            base += size
        return runs

    def read(self, part: Run) -> Iterator:
        """Rows; or, where all wanted columns stand in the fixed part of a record, Arrow batches."""
        compare = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
        fixed = self.columns <= set(FIXED)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        with open(part.path, "rb") as f:
            refs = Header.read(f).refs
            start = part.start if part.inside >= 0 else next_block(f, part.start)
            if start is None or start >= part.end:
                return
            data, at, own, synced = b"", max(part.inside, 0), 0, part.inside >= 0
            dropped = 0
            for offset, d in blocks(f, start):
                if offset >= part.end:
                    # Only the rest of the last own record is still needed.
                    if at >= own or not synced:
                        break
                else:
                    own = len(data) + len(d)
                data += d
                if not synced:
                    found = first_record(data, len(refs))
                    if found is None:
                        continue
                    at, synced = found, True
                places = []
                while at < own and len(data) >= at + 4:
                    end = at + 4 + SIZE(data, at)[0]
                    if len(data) < end:
                        break
                    places.append(at)
                    at = end
                base = (part.base + start << 16) + dropped
                if places:
                    told = fixed_parts(data, places)
                    order = np.array(places, np.int64) + base
                    good = np.ones(len(places), bool)
                    for c, op, v in self.tests:
                        good &= compare[op](told[FIXED[c]], v)
                    if fixed:
                        held.append((told[good], order[good]))
                        waiting += len(held[-1][1])
                        if waiting >= 20_000:
                            yield self._batch(held)
                            held, waiting = [], 0
                    else:
                        for k in np.flatnonzero(good).tolist():
                            here, end = places[k], places[k + 1] if k + 1 < len(places) else at
                            yield decode(data[here + 4 : end], refs, self.columns, int(order[k]))
                cut = min(at, own)
                data, at, own, dropped = data[cut:], at - cut, own - cut, dropped + cut
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        told, order = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        cols = []
        for f in to_arrow_schema(ALIGNMENTS):
            if f.name == "file_ord" and f.name in self.columns:
                cols.append(pa.array(order))
            elif f.name in self.columns:
                cols.append(pa.array(told[FIXED[f.name]].astype(f.type.to_pandas_dtype())))
            else:
                cols.append(pa.nulls(len(order), f.type))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in ALIGNMENTS.fields])


def encode(row, refs: dict[str, int]) -> bytes:
    """A row of ALIGNMENTS as a record with its leading size."""
    cig = row["cigar"] or "*"
    ops, num = [], ""
    for c in "" if cig == "*" else cig:
        if c.isdigit():
            num += c
        else:
            ops.append((int(num) << 4) | OPS.index(c))
            num = ""
    seq, name = row["seq"] or "", (row["qname"] or "*").encode() + b"\0"
    if len(name) > 255:
        raise ValueError("a name has more than 254 bytes")
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes(c - 33 for c in row["qual"].encode()) if row["qual"] else b"\xff" * len(seq)
    pos, span = row["pos"], sum(o >> 4 for o in ops if OPS[o & 15] in "MDN=X")
    start, last = max(pos, 0), max(pos, 0) + max(span, 1) - 1
    bin_ = next((((1 << 3 * k) - 1) // 7 + (start >> 29 - 3 * k) for k in range(5, 0, -1) if start >> 29 - 3 * k == last >> 29 - 3 * k), 0)
    extra = b"".join(map(encode_tag, row["tags"] or []))
    if len(ops) > 65535:
        extra += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, span << 4 | 3]
    body = struct.pack(
        "<iiBBHHHiiii", refs.get(row["rname"], -1), pos, len(name), row["mapq"] or 0, bin_ & 0xFFFF, len(ops), row["flag"], len(seq),
        refs.get(row["rnext"], -1), row["pnext"] if row["pnext"] is not None else -1, row["tlen"] or 0,
    )
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + extra
    return struct.pack("<i", len(body)) + body


def encode_tag(text: str) -> bytes:
    tag, t, v = text.split(":", 2)
    out = tag.encode()
    if t == "A":
        return out + b"A" + v.encode()[:1]
    if t in "ZH":
        return out + t.encode() + v.encode() + b"\0"
    if t == "B":
        sub, *vals = v.split(",")
        return out + b"B" + sub.encode() + struct.pack(f"<i{len(vals)}{SIZES[sub]}", len(vals), *(float(x) if sub == "f" else int(x) for x in vals))
    if t in "fd":
        return out + t.encode() + struct.pack("<" + t, float(v))
    n = int(v)
    kind = ("C" if n < 256 else "S" if n < 65536 else "I") if n >= 0 else ("c" if n >= -128 else "s" if n >= -32768 else "i")
    return out + kind.encode() + struct.pack("<" + SIZES[kind], n)


def deflate(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return (
        b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    )


class Done(WriterCommitMessage):
    """A task's finished file and the name it shall have."""

    def __init__(self, temp: str, path: str):
        self.temp, self.path = temp, path


class BamWriter(DataSourceWriter):
    """Every task writes a complete file with the header under a hidden name, in the output
    folder that driver and executors share. Only when all are done does the driver give
    them their names, after it has removed an earlier run's files if the mode says so; a
    run that fails leaves nothing that a reader takes for data."""

    def __init__(self, folder: str, header: str, level: int, overwrite: bool = False):
        self.folder, self.header, self.level, self.overwrite = folder, header, level, overwrite

    def commit(self, messages):
        import glob
        import os

        new = [m for m in messages if m is not None]
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.folder)}/part-*.bam"):
                os.remove(old)
        for m in new:
            os.replace(m.temp, m.path)

    def abort(self, messages):
        import os

        for m in messages:
            if m is not None and os.path.exists(m.temp):
                os.remove(m.temp)

    def write(self, rows):
        import os

        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        part = TaskContext.get().partitionId()
        refs = []
        for line in self.header.splitlines():
            if line.startswith("@SQ"):
                f = dict(x.split(":", 1) for x in line.split("\t")[1:])
                refs.append((f["SN"], int(f["LN"])))
        text = self.header.encode()
        head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
        for name, n in refs:
            head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<I", n & 0xFFFFFFFF)
        ids = {name: k for k, (name, _) in enumerate(refs)}
        run = "" if self.overwrite else f"-{os.urandom(4).hex()}"  # files of an earlier run stay beside these
        path = f"{self.folder}/part-{part:05d}{run}.bam"
        temp = f"{self.folder}/.part-{part:05d}-{TaskContext.get().taskAttemptId()}"
        with open(temp, "wb") as f:
            pending = head
            for row in rows:
                pending += encode(row, ids)
                while len(pending) >= 65280:
                    f.write(deflate(pending[:65280], self.level))
                    pending = pending[65280:]
            if pending:
                f.write(deflate(pending, self.level))
            f.write(EOF_BLOCK)
        return Done(temp, path)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> T.StructType:
        return ALIGNMENTS

    def reader(self, schema):
        cols = self.options.get("columns")
        chosen = {c.strip() for c in cols.split(",")} if cols else {f.name for f in ALIGNMENTS.fields}
        return BamReader(self.options["path"], int(self.options.get("runBytes", 32 << 20)), chosen, self.options.get("failOnTruncated", "false").lower() == "true")

    def writer(self, schema, overwrite):
        return BamWriter(self.options["path"], self.options.get("header", ""), int(self.options.get("level", 6)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Records of whole files through Spark's binary reader (any file system, files under 2 GB)."""
    import io

    names = [f.name for f in ALIGNMENTS.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                f = io.BytesIO(content)
                head = Header.read(f)
                data = b"".join(d for _, d in blocks(f, head.block))[head.inside :]
                at, rows = 0, []
                while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
                    rows.append(decode(data[at + 4 : at + 4 + size], head.refs, set(names), len(rows)))
                    at += 4 + size
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(ALIGNMENTS)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ALIGNMENTS)
