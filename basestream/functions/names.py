"""Names on the driver or in batches: template names, cache paths, command lines, formats."""

from __future__ import annotations

import os
import re

#: Digits of base 36.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


class Bits:
    """Bits of a name's suffix, from the lowest of its last byte on."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        n = min(n, self.left)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return out


def in_base(value: int, base: int) -> str:
    out = ""
    while value or not out:
        value, d = divmod(value, base)
        out = DIGITS[d] + out
    return out


FIELD = re.compile(r"%(?:(\d+))?(?:\.(\d+))?([doxXjJcs%])")


def template_name(form: str, suffix: bytes) -> str:
    """A name from a format of fields ``%[width][.bits]code`` and the bits of a suffix."""
    bits = Bits(suffix)

    def field(m: re.Match) -> str:
        width, size, code = int(m[1] or 0), m[2], m[3]
        if code == "%":
            return "%"
        if code == "s":
            n = bits.left // 8 if size is None else int(size) // 8
            return bytes(bits.take(8) for _ in range(n)).decode("latin-1").ljust(width)
        if code == "c":
            return chr(bits.take(int(size or 8))).rjust(width)
        value = bits.take(bits.left if size is None else int(size))
        text = in_base(value, {"d": 10, "o": 8, "x": 16, "X": 16, "j": 36, "J": 36}[code]).rjust(width, "0")
        return text.upper() if code in "XJ" else text

    return FIELD.sub(field, form)


def template_suffix(form: str, name: str, size: int) -> bytes:
    """The suffix of ``size`` bytes that gives ``name``: the inverse where the fields can
    be told apart."""
    kinds = {"d": r"\d", "o": "[0-7]", "x": "[0-9a-f]", "X": "[0-9A-F]", "j": "[0-9a-z]", "J": "[0-9A-Z]"}
    parts, fields, last = [], [], 0
    for m in FIELD.finditer(form):
        parts.append(re.escape(form[last : m.start()]))
        last = m.end()
        if m[3] == "%":
            parts.append("%")
            continue
        fields.append((m[3], m[2]))
        one = kinds.get(m[3], ".")
        parts.append("(" + one + ("{%s}" % m[1] if m[1] and m[3] in kinds and m[2] and fields_width(m) == int(m[1]) else "*" if m[3] == "s" else "+" if m[3] in kinds else "") + ")")
    found = re.fullmatch("".join([*parts, re.escape(form[last:])]), name, re.S)
    if not found:
        raise ValueError(f"{name!r} doesn't follow {form!r}")
    value, at = 0, 0
    for (code, bits), text in zip(fields, found.groups()):
        if code == "s":
            for c in text.encode("latin-1"):
                value |= c << at
                at += 8
            continue
        number = ord(text) if code == "c" else int(text, {"d": 10, "o": 8, "x": 16, "X": 16, "j": 36, "J": 36}[code])
        value |= number << at
        at += int(bits or (8 if code == "c" else 8 * size - at))
    return value.to_bytes(size, "big")


def fields_width(m: re.Match) -> int:
    """Most characters of a numeric field of so many bits."""
    base = {"d": 10, "o": 8, "x": 16, "X": 16, "j": 36, "J": 36}[m[3]]
    return len(in_base((1 << int(m[2])) - 1, base))


def cache_path(folder: str, name: str) -> str:
    """``folder`` with %s as the rest of the name and %Ns as its next N characters; what is
    left of the name follows a slash."""
    out, rest, at = "", name, 0
    for m in re.finditer(r"%(\d*)(s?)", folder):
        out += folder[at : m.start()]
        at = m.end()
        if not m[2]:
            out += m[0]
            continue
        n = len(rest) if not m[1] else int(m[1])
        out, rest = out + rest[:n], rest[n:]
    out += folder[at:]
    return out + ("/" if rest and not out.endswith("/") else "") + rest


def command_line(words: list[str]) -> str:
    """Arguments as the text of a program line: blanks between them, tabs made blanks."""
    return " ".join(w.replace("\t", " ") for w in words)


def reference_places(md5: str, line: dict[str, str], env: dict[str, str] | None = None) -> list[str]:
    """Where the bases of a digest are looked for, in order: the cache folder, each place of
    the search path, and the address of the header line."""
    env = os.environ if env is None else env
    found = [cache_path(env["REF_CACHE"], md5)] if env.get("REF_CACHE") else []
    for part in re.split(r"(?<!https)(?<!http)(?<!ftp)(?<!file):", env.get("REF_PATH", "")):
        if part:
            found.append(cache_path(part, md5) if "%" in part else f"{part.rstrip('/')}/{md5}")
    if line.get("UR"):
        found.append(line["UR"])
    return found


def format_by_name(path: str) -> str | None:
    """sam, bam or cram by the ending, all lower or all upper case; else None."""
    ending = path.rpartition(".")[2]
    return ending.lower() if ending in ("sam", "SAM", "bam", "BAM", "cram", "CRAM") and "." in path else None


def format_by_magic(head: bytes) -> str:
    """Alignment format of a file's first bytes: the columnar one first, then blocks, then text."""
    if head[:4] == b"CRAM":
        return "cram"
    if head[:4] == b"\x1f\x8b\x08\x04" and b"BC\x02\0" in head[:64]:
        return "bam"
    return "gz" if head[:2] == b"\x1f\x8b" else "sam"


#: Records a slice by profile; 500 bases a record bound it too.
PROFILES = {"fast": 1000, "normal": 10_000, "default": 10_000, "small": 25_000, "archive": 100_000}


def profile(name: str) -> dict[str, object]:
    """Writer settings of a profile: records and bases a slice, and the codec of its files."""
    if name not in PROFILES:
        raise ValueError("choose from fast, normal, small or archive")
    codec = {"fast": ("zstd", 1), "small": ("zstd", 12), "archive": ("zstd", 19)}.get(name, ("zstd", 3))
    return {"records": PROFILES[name], "bases": 500 * PROFILES[name], "compression": codec[0], "level": codec[1]}


#: Series that a wanted field needs, and series that a series needs.
FIELD_SERIES = {
    "qname": "RN", "flag": "BF", "rname": "RI BF", "pos": "AP BF", "mapq": "MQ", "cigar": "RL FN FC FP DL IN SC HC PD RS", "rnext": "CF NF RI NS BF",
    "pnext": "CF NF AP NP BF", "tlen": "CF NF AP TS BF MF RI RL FN FC FP DL IN SC HC PD RS", "seq": "RL FN FC FP DL IN SC BS BA BB RS", "qual": "QS QQ", "tags": "RG TL aux", "rg": "RG BF",
}
SERIES_NEED = {
    **dict.fromkeys("RS PD HC IN SC DL".split(), "FC FP"), "BS": "FC FP RI", "FP": "FC", "FC": "FN", "FN": "RL", "aux": "TL", "MF": "CF", "MQ": "BF", "NS": "CF", "NP": "CF", "TS": "CF", "NF": "CF",
    **dict.fromkeys("QS BA BB QQ".split(), "FC FP BF CF RL"),
}


def series_of(fields: list[str], names_stored: bool = True) -> set[str]:
    """All data series that the wanted fields need, to the fixpoint of the rules."""
    need = {s for f in fields for s in FIELD_SERIES[f].split()}
    while True:
        more = {s for n in need for s in SERIES_NEED.get(n, "").split()} | ({"CF", "NF"} if "RN" in need and not names_stored else set())
        if more <= need:
            return need
        need |= more
