"""Chromatogram files with a tagged directory (big-endian; names of four letters and a number)."""

from __future__ import annotations

import struct

import numpy as np

from basestream.sources.traces import PROBS, blank

#: Numbers of the DATA entries that hold the four processed channels.
LANES = (9, 10, 11, 12)
#: Text entries and the comment each becomes.
COMMENTS = {"SMPL": "NAME", "CMNT": "COMM", "LANE": "LANE", "MCHN": "MACH", "PDMF": "DYEP", "TUBE": "TUBE"}


def directory(data: bytes) -> dict[tuple[str, int], tuple[int, int, bytes]]:
    """(name, number) to (element type, element count, raw bytes). A leading 128-byte
    wrapper is skipped."""
    base = 128 if data[128:132] == b"ABIF" else 0
    if data[base : base + 4] != b"ABIF":
        raise ValueError("not a tagged chromatogram file")
    count, = struct.unpack_from(">I", data, base + 18)
    start, = struct.unpack_from(">I", data, base + 26)
    out = {}
    for k in range(count):
        at = base + start + 28 * k
        name, number, kind, _, n, size, place = struct.unpack_from(">4sIHHIII", data, at)
        raw = data[at + 20 : at + 20 + size] if size <= 4 else data[base + place : base + place + size]
        if len(raw) < size:
            raise ValueError("an entry is cut off")
        out[name.decode("latin-1"), number] = kind, n, raw
    return out


def text_of(entry: tuple[int, int, bytes]) -> str:
    kind, _, raw = entry
    if kind == 18:  # length first
        raw = raw[1 : 1 + raw[0]]
    elif kind in (4, 5):
        return str(int.from_bytes(raw[: 2 if kind == 4 else 4], "big", signed=True))
    return raw.rstrip(b"\0").decode("latin-1").replace("\n", " ")


def read_abif(data: bytes, lanes: tuple[int, int, int, int] = LANES) -> dict:
    """A trace record; ``lanes`` picks the DATA entries."""
    d = directory(data)
    r = blank("ABI")
    order = d["FWO_", 1][2].decode("latin-1").lower() if ("FWO_", 1) in d else "gatc"
    top = 0
    for base, number in zip(order, lanes):
        if ("DATA", number) in d:
            v = np.maximum(np.frombuffer(d["DATA", number][2], ">i2"), 0).astype(int)
            r[f"trace_{base}"], r["npoints"] = v.tolist(), len(v)
            top = max(top, int(v.max(initial=0)))
    find = lambda name: d.get((name, 1)) or d.get((name, 2))
    if called := find("PBAS"):
        r["base"] = called[2].rstrip(b"\0").decode("latin-1").replace("N", "-")
        r["nbases"] = len(r["base"])
    if place := find("PLOC"):
        r["base_pos"] = np.frombuffer(place[2], ">i2").astype(int).tolist()
    if (conf := find("PCON")) and r["base"]:
        for p in PROBS:
            r[p] = [q if b.lower() == p[-1] else 0 for q, b in zip(conf[2], r["base"])]
    r["info"] = {key: text_of(d[name, 1]) for name, key in COMMENTS.items() if (name, 1) in d}
    return r | {"max_trace": top, "trace_name": r["info"].get("NAME")}
