"""Trace files: SCF, ABI, ZTR, SFF, Experiment, plain and FASTA text to trace records.

Files come through Spark's binary reader, one row a file, and are told apart by their
first bytes; Arrow batches decode them. SCF, ZTR and Experiment records are also
written. Cut-off or unknown files give no record unless ``fail`` is set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from basestream.functions.codecs import open_bytes
from basestream.model import TRACES

ZTR_MAGIC = b"\xaeZTR\r\n\x1a\n"
CHANNELS = ("trace_a", "trace_c", "trace_g", "trace_t")
PROBS = ("prob_a", "prob_c", "prob_g", "prob_t")


def sniff(data: bytes) -> str | None:
    if data[:4] == b".scf":
        return "SCF"
    if data[:8] == ZTR_MAGIC:
        return "ZTR"
    if data[:4] == b".sff":
        return "SFF"
    if data[:4] == b"ABIF" or data[128:132] == b"ABIF":
        return "ABI"
    if data[:4] == b"SSRF":
        return "SRF"
    if data[:2] == b"\x1f\x8b":
        return "GZIP"
    if data[:5] in (b"ID   ", b"EN   "):
        return "EXP"
    head = data[:256]
    shown = [c for c in head if 32 <= c < 127 or c in b"\t\r\n"]
    letters = [c for c in shown if c not in b" \t\r\n>;"]
    if data[:1] in (b">", b";") or head and len(shown) > 0.75 * len(head) and letters and sum(chr(c) in "ACGTNacgtn-" for c in letters) > 0.75 * len(letters):
        return "PLN"
    return None


def blank(fmt: str) -> dict:
    return {f.name: None for f in TRACES.fields} | {"format": fmt, "npoints": 0, "nbases": 0, "baseline": 0, "left_cutoff": 0, "right_cutoff": 0}


def second_differences(x: np.ndarray, bits: int) -> np.ndarray:
    return np.diff(x.astype(np.int64), n=2, prepend=[0, 0]) % (1 << bits)


def undo_second_differences(x: np.ndarray, bits: int) -> np.ndarray:
    return np.cumsum(np.cumsum(x.astype(np.int64)) % (1 << bits)) % (1 << bits)


def read_scf(data: bytes) -> dict:
    magic, n, at, bases, left, right, base_at, csize, cat = struct.unpack_from(">4s8I", data)
    version = float(data[36:40].decode("ascii", "replace").strip("\0 ") or 1)
    size = struct.unpack_from(">I", data, 40)[0]
    width = 2 if size == 2 else 1
    raw = np.frombuffer(data, ">u2" if width == 2 else "u1", 4 * n, at)
    r = blank("SCF")
    if version >= 3:
        lanes = [undo_second_differences(x, 8 * width) for x in raw.reshape(4, n)]
        k = base_at
        pos = np.frombuffer(data, ">u4", bases, k)
        probs = np.frombuffer(data, "u1", 4 * bases, k + 4 * bases).reshape(4, bases)
        text = data[k + 8 * bases : k + 9 * bases]
    else:
        lanes = list(raw.reshape(n, 4).T)
        rows = np.frombuffer(data, np.dtype([("p", ">u4"), ("q", "u1", 4), ("b", "S1"), ("x", "u1", 3)]), bases, base_at)
        pos, probs, text = rows["p"], rows["q"].T, b"".join(x or b"-" for x in rows["b"].tolist())
    comments = data[cat : cat + csize].rstrip(b"\0\n").decode("latin-1")
    info = dict(x.split("=", 1) for x in comments.split("\n") if "=" in x)
    for name, lane in zip(CHANNELS, lanes):
        r[name] = lane.astype(int).tolist()
    for name, p in zip(PROBS, probs):
        r[name] = p.astype(int).tolist()
    return r | {
        "npoints": n, "nbases": bases, "max_trace": int(max((x.max() for x in lanes if len(x)), default=0)), "base": text.decode("latin-1"),
        "base_pos": pos.astype(int).tolist(), "left_cutoff": left, "right_cutoff": bases - right + 1 if right else 0, "info": info,
    }


def write_scf(r: dict, version: int = 3) -> bytes:
    n, bases = r["npoints"], r["nbases"]
    width = 2 if (r["max_trace"] or 0) > 255 else 1
    lanes = [np.array(r[c] or [0] * n, np.int64) for c in CHANNELS]
    probs = [np.array(r[p] or [0] * bases, np.uint8) for p in PROBS]
    kind = ">u2" if width == 2 else "u1"
    pos = np.array(r["base_pos"] or [0] * bases, ">u4")
    text = (r["base"] or "").encode("latin-1")
    if version >= 3:
        samples = b"".join(second_differences(x, 8 * width).astype(kind).tobytes() for x in lanes)
        called = pos.tobytes() + b"".join(p.tobytes() for p in probs) + text + bytes(3 * bases)
    else:
        samples = np.stack(lanes, 1).astype(kind).tobytes()
        called = b"".join(struct.pack(">I4Bc3x", int(pos[k]), *(int(p[k]) for p in probs), text[k : k + 1]) for k in range(bases))
    comments = "".join(f"{k}={v}\n" for k, v in (r["info"] or {}).items()).encode("latin-1") + b"\0"
    right = bases - r["right_cutoff"] + 1 if r["right_cutoff"] else 0
    at = 128
    head = struct.pack(
        ">4s8I4sIIII", b".scf", n, at, bases, r["left_cutoff"] or 0, right, at + len(samples), len(comments), at + len(samples) + len(called),
        b"3.00" if version >= 3 else b"2.00", width, 0, 0, at + len(samples) + len(called) + len(comments),
    )
    return head.ljust(128, b"\0") + samples + called + comments


def unrle(d: bytes) -> bytes:
    size, guard, out, k = struct.unpack_from("<I", d, 1)[0], d[5], bytearray(), 6
    while len(out) < size:
        if d[k] != guard:
            out.append(d[k])
            k += 1
        elif d[k + 1] == 0:
            out.append(guard)
            k += 2
        else:
            out += bytes([d[k + 2]]) * d[k + 1]
            k += 3
    return bytes(out)


def undelta(d: bytes, width: int) -> bytes:
    """Differences of the order in the second byte, over big-endian values after the
    header (padded to the value's width)."""
    kind = {1: "u1", 2: ">u2", 4: ">u4"}[width]
    x = np.frombuffer(d, kind, offset=max(2, width)).astype(np.int64)
    for _ in range(d[1]):
        x = np.cumsum(x) % (1 << 8 * width)
    return x.astype(kind).tobytes()


def grow(d: bytes, width: int) -> bytes:
    out, k = bytearray(), 1
    while k < len(d):
        v = d[k] - 256 if d[k] > 127 else d[k]
        if v == -128:
            out += d[k + 1 : k + 1 + width]
            k += 1 + width
        else:
            out += v.to_bytes(width, "big", signed=True)
            k += 1
    return bytes(out)


def unfollow(d: bytes) -> bytes:
    table, body = d[1:257], d[257:]
    out, last = bytearray(body[:1]), body[0] if body else 0
    for v in body[1:]:
        last = (table[last] - v) & 255
        out.append(last)
    return bytes(out)


def unpack_chunk(d: bytes) -> bytes:
    """A chunk's data with its stack of transforms undone."""
    while d and d[0]:
        f = d[0]
        if f == 1:
            d = unrle(d)
        elif f == 2:
            d = zlib.decompress(d[5:])
        elif f in (64, 65, 66):
            d = undelta(d, {64: 1, 65: 2, 66: 4}[f])
        elif f in (70, 71):
            d = grow(d, {70: 2, 71: 4}[f])
        elif f == 72:
            d = unfollow(d)
        else:
            raise ValueError(f"chunk transform {f} is not supported")
    return d


def ztr_chunks(data: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    at = 10
    while at + 12 <= len(data):
        kind, m = data[at : at + 4].decode("latin-1"), struct.unpack_from(">I", data, at + 4)[0]
        meta = data[at + 8 : at + 8 + m]
        n = struct.unpack_from(">I", data, at + 8 + m)[0]
        yield kind, meta, data[at + 12 + m : at + 12 + m + n]
        at += 12 + m + n


def read_ztr(data: bytes) -> dict:
    r = blank("ZTR")
    conf: bytes | None = None
    for kind, meta, body in ztr_chunks(data):
        d = unpack_chunk(body)
        if kind == "SMP4":
            lanes = np.frombuffer(d, ">u2", offset=2).reshape(4, -1)
            r |= {c: x.astype(int).tolist() for c, x in zip(CHANNELS, lanes)} | {"npoints": lanes.shape[1], "max_trace": int(lanes.max(initial=0))}
        elif kind == "SAMP":
            lane = np.frombuffer(d, ">u2", offset=2).astype(int).tolist()
            name = next((c for c in CHANNELS if c[-1].upper() in meta.decode("latin-1").upper()[-2:]), None)
            if name:
                r |= {name: lane, "npoints": len(lane), "max_trace": max(r["max_trace"] or 0, *lane, 0)}
        elif kind == "BASE":
            r |= {"base": d[1:].decode("latin-1"), "nbases": len(d) - 1}
        elif kind == "BPOS":
            r["base_pos"] = np.frombuffer(d, ">u4", offset=4).astype(int).tolist()
        elif kind in ("CNF4", "CNF1"):
            conf = d[1:]
        elif kind == "CLIP":
            r["left_cutoff"], r["right_cutoff"] = struct.unpack_from(">II", d, 1)
        elif kind == "TEXT":
            parts = d[1:].rstrip(b"\0").split(b"\0")
            r["info"] = {a.decode("latin-1"): b.decode("latin-1") for a, b in zip(parts[::2], parts[1::2])}
    if conf is not None and r["base"]:
        n = r["nbases"]
        rest = conf[n:]
        probs = {p: [0] * n for p in PROBS}
        for k, b in enumerate(r["base"].upper()):
            called = b if b in "ACGT" else "T"
            probs[f"prob_{called.lower()}"][k] = conf[k]
            if rest:
                for o, other in enumerate(x for x in "acgt" if x != called.lower()):
                    probs[f"prob_{other}"][k] = rest[3 * k + o]
        r |= probs
    return r


def write_ztr(r: dict, level: int = 2) -> bytes:
    """Level 0 raw, 1 delta, 2 delta and deflate."""

    def chunk(kind: str, d: bytes, width: int = 0) -> bytes:
        if level >= 1 and width and len(d) > width:
            x = np.frombuffer(d, {2: ">u2", 4: ">u4"}[width]).astype(np.int64)
            d = bytes([{2: 65, 4: 66}[width], 1]).ljust(max(2, width), b"\0") + (np.diff(x, prepend=0) % (1 << 8 * width)).astype({2: ">u2", 4: ">u4"}[width]).tobytes()
        if level >= 2:
            d = b"\x02" + struct.pack("<I", len(d)) + zlib.compress(d)
        return kind.encode() + struct.pack(">I", 0) + struct.pack(">I", len(d)) + d

    out = ZTR_MAGIC + b"\x01\x02"
    if r["npoints"]:
        out += chunk("SMP4", b"\0\0" + np.concatenate([np.array(r[c] or [0] * r["npoints"]) for c in CHANNELS]).astype(">u2").tobytes(), 2)
    if r["base"]:
        out += chunk("BASE", b"\0" + r["base"].encode("latin-1"))
        if r["base_pos"]:
            out += chunk("BPOS", b"\0" * 4 + np.array(r["base_pos"], ">u4").tobytes(), 4)
        if r["prob_a"]:
            first, rest = bytearray(), bytearray()
            for k, b in enumerate(r["base"].upper()):
                called = b.lower() if b in "ACGT" else "t"
                first.append(r[f"prob_{called}"][k])
                rest += bytes(r[f"prob_{o}"][k] for o in "acgt" if o != called)
            out += chunk("CNF4", b"\0" + bytes(first + rest))
    if r["info"]:
        out += chunk("TEXT", b"\0" + b"".join(k.encode("latin-1") + b"\0" + v.encode("latin-1") + b"\0" for k, v in r["info"].items()) + b"\0")
    return out + chunk("CLIP", b"\0" + struct.pack(">II", r["left_cutoff"] or 0, r["right_cutoff"] or 0))


def read_sff(data: bytes) -> Iterator[dict]:
    """All reads of a container."""
    _, _, index_at, index_size, reads, head, key, flows, _ = struct.unpack_from(">4sIQIIHHHB", data)
    order = data[31 : 31 + flows].decode()
    up8 = lambda n: (n + 7) & ~7
    at = up8(head)
    for _ in range(reads):
        if index_size and at == index_at:
            at = up8(at + index_size)
        size, m, n, ql, qr, al, ar = struct.unpack_from(">HHIHHHH", data, at)
        name = data[at + 16 : at + 16 + m].decode()
        at += up8(size)
        raw = np.frombuffer(data, ">u2", flows, at)
        step = np.frombuffer(data, "u1", n, at + 2 * flows)
        text = data[at + 2 * flows + n : at + 2 * flows + 2 * n].decode()
        qual = list(data[at + 2 * flows + 2 * n : at + 2 * flows + 3 * n])
        at += up8(2 * flows + 3 * n)
        rights = [x for x in (qr, ar) if x]
        r = blank("SFF") | {
            "trace_name": name, "nbases": n, "base": text, "base_pos": np.cumsum(step.astype(int)).tolist(), "left_cutoff": max(ql, al),
            "right_cutoff": min(rights) if rights else n + 1, "flow_order": order, "flow": (raw / 100.0).astype(np.float32).tolist(), "flow_raw": raw.astype(int).tolist(),
        }
        yield r | {p: [q if b == p[-1].upper() else 0 for q, b in zip(qual, text.upper())] for p in PROBS}


def read_experiment(text: str) -> dict[str, list[str]]:
    """Values per two-letter key. Sequence lines follow SQ, up to ``//``."""
    out: dict[str, list[str]] = {}
    in_seq, last = False, None
    for line in text.splitlines():
        if in_seq:
            if line.startswith("//"):
                in_seq = False
            else:
                out["SQ"][-1] += "".join(line.split())
        elif line[:2] == "SQ":
            out.setdefault("SQ", []).append("")
            in_seq = True
        elif line[:2].strip() and line[2:5] == "   ":
            last = line[:2]
            out.setdefault(last, []).append(line[5:].rstrip())
        elif last and line.startswith(" "):
            out[last][-1] += "\n" + line.strip()
    return out


def write_experiment(values: dict[str, list[str]]) -> str:
    lines = [f"{k}   {v}" for k, vs in values.items() if k != "SQ" for v in vs]
    for seq in values.get("SQ", []):
        lines.append("SQ")
        for k in range(0, len(seq), 60):
            lines.append("     " + " ".join(seq[k : k + 60][i : i + 10] for i in range(0, 60, 10)).rstrip())
        lines.append("//")
    return "\n".join(lines) + "\n"


def experiment_trace(values: dict[str, list[str]]) -> dict:
    one = lambda k, d=0: int(values[k][0]) if values.get(k) else d
    seq = "".join(values.get("SQ", [])[:1])
    left = max(one("QL"), one("SL"))
    right = max(min(one("QR", len(seq) + 1), one("SR", len(seq) + 1)), left + 1)
    return blank("EXP") | {
        "trace_name": (values.get("ID") or values.get("EN") or [None])[0], "nbases": len(seq), "base": seq, "left_cutoff": left, "right_cutoff": right,
        "info": {k: "\n".join(v) for k, v in values.items() if k != "SQ"},
    }


def read_plain(text: str) -> dict:
    """The first record; N becomes -, lines ``;<`` and ``;>`` hold the cut-off parts."""
    name, seq, left, right = None, "", "", ""
    for line in text.splitlines():
        if line.startswith(">"):
            if name is not None or seq:
                break
            name = line[1:].split()[0] if line[1:].split() else ""
        elif line.startswith(";<"):
            left += line[2:].strip()
        elif line.startswith(";>"):
            right += line[2:].strip()
        elif not line.startswith(";"):
            seq += "".join(c for c in line if not c.isspace())
    whole = (left + seq + right).translate(str.maketrans("Nn", "--"))
    return blank("PLN") | {"trace_name": name, "nbases": len(whole), "base": whole, "left_cutoff": len(left), "right_cutoff": len(left) + len(seq) + 1 if right else 0}


def decode(name: str, data: bytes) -> list[dict]:
    plain = open_bytes(data)  # gzip, bzip2 and xz
    if plain is not data:
        return decode(name, plain)
    kind = sniff(data)
    if kind == "SFF":
        return list(read_sff(data))
    from basestream.sources.abif import read_abif

    made = {
        "ABI": lambda: read_abif(data), "SCF": lambda: read_scf(data), "ZTR": lambda: read_ztr(data), "EXP": lambda: experiment_trace(read_experiment(data.decode("latin-1"))),
        "PLN": lambda: read_plain(data.decode("latin-1")),
    }.get(kind)
    if made is None:
        raise ValueError(f"{name}: unknown trace format")
    r = made()
    return [r | {"trace_name": r["trace_name"] or name.rsplit("/", 1)[-1]}]


UNREADABLE = (ValueError, struct.error, zlib.error, IndexError, KeyError, EOFError, OSError)


def read_traces(spark: SparkSession, path: str | list[str], fail: bool = True) -> DataFrame:
    """Traces of files of any known format, compressed or not. A file that can't be
    decoded is an error; without ``fail`` it has no rows here, and one in ``bad_traces``."""
    names = [f.name for f in TRACES.fields]
    kinds = to_arrow_schema(TRACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += decode(name, data)
                except UNREADABLE as e:
                    if fail:
                        raise ValueError(f"{name} can't be decoded: {e!r}") from e
            for r in rows:
                r["info"] = list(r["info"].items()) if r["info"] is not None else None
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.field(n).type) for n in names], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, TRACES)


def bad_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, error) of the files that ``read_traces`` can't decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    decode(name, data)
                except UNREADABLE as e:
                    rows.append((name, repr(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["path", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, error string")
