"""Decoders of the column encodings and blocks of columnar alignment files."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

#: Numbers of block methods that the standard library inflates.
METHODS: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: lambda d: zlib.decompress(d, 47), 2: bz2.decompress, 3: lzma.decompress}
#: The same by name, for whole files.
BY_NAME: dict[str, Callable[[bytes], bytes]] = {"none": bytes, "gzip": METHODS[1], "bzip2": METHODS[2], "xz": METHODS[3], "compress": METHODS[1]}


def inflate(method: int, data: bytes, size: int) -> bytes:
    """A block's bytes; the stated size must hold."""
    if method not in METHODS:
        raise ValueError(f"block method {method} is not supported")
    out = METHODS[method](data)
    if len(out) != size:
        raise ValueError(f"a block of {size} bytes gave {len(out)}")
    return out


def open_bytes(data: bytes) -> bytes:
    """Contents of a compressed file by its first bytes; others as they are."""
    for head, name in ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ", "xz")):
        if data.startswith(head):
            return BY_NAME[name](data)
    return data


class BitReader:
    """Bits of a block, highest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        if self.at >= 8 * len(self.data):
            raise EOFError("no bits left")
        out = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return out

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def zeros(self) -> int:
        n = 0
        while not self.bit():
            n += 1
        return n

    def ones(self) -> int:
        n = 0
        while self.bit():
            n += 1
        return n


def beta(offset: int, size: int) -> Callable[[BitReader], int]:
    """Numbers of a fixed number of bits."""
    return lambda b: b.bits(size) - offset


def gamma(offset: int) -> Callable[[BitReader], int]:
    """As many zeros as the number has bits after its first, then the number."""

    def read(b: BitReader) -> int:
        n = b.zeros()
        return (1 << n | b.bits(n)) - offset

    return read


def subexponential(offset: int, k: int) -> Callable[[BitReader], int]:
    """Small numbers in k bits, larger ones in as many more as a unary count says."""

    def read(b: BitReader) -> int:
        n = b.ones()
        return (b.bits(k) if n == 0 else 1 << (n + k - 1) | b.bits(n + k - 1)) - offset

    return read


def huffman(symbols: list[int], lengths: list[int]) -> Callable[[BitReader], int]:
    """Canonical codes: by length, then by symbol, each the one before plus one."""
    codes, code, last = {}, 0, 0
    for length, symbol in sorted(zip(lengths, symbols)):
        code <<= length - last
        codes[length, code] = symbol
        code, last = code + 1, length

    def read(b: BitReader) -> int:
        length = code = 0
        while (length, code) not in codes:
            length, code = length + 1, code << 1 | b.bit()
            if length > 32:
                raise ValueError("no such code")
        return codes[length, code]

    return read


def varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """A number of up to 32 bits whose leading ones count its further bytes; where it ends."""
    first = data[at]
    n = 0
    while n < 4 and first & 0x80 >> n:
        n += 1
    if n < 4:
        return int.from_bytes(bytes([first & (0x7F >> n)]) + data[at + 1 : at + 1 + n], "big"), at + 1 + n
    value = int.from_bytes(bytes([first & 0x0F]) + data[at + 1 : at + 4], "big") << 4 | data[at + 4] & 0x0F
    return value, at + 5


def varint_bytes(value: int) -> bytes:
    """The inverse, for numbers from 0 to 2**32 - 1."""
    for n in range(4):
        if value < 1 << (7 * (n + 1)):
            out = bytearray(value.to_bytes(n + 1, "big"))
            out[0] |= 0xFF00 >> n & 0xFF
            return bytes(out)
    return bytes([0xF0 | value >> 28, value >> 20 & 0xFF, value >> 12 & 0xFF, value >> 4 & 0xFF, value & 0x0F])


def constant(value: int, n: int) -> list[int]:
    return [value] * n


def undelta(values: list[int], zigzag: bool = True) -> list[int]:
    """Running sums of differences, which alternate signs if ``zigzag``."""
    out, last = [], 0
    for v in values:
        last += (v >> 1) ^ -(v & 1) if zigzag else v
        out.append(last)
    return out


def unpack_bits(data: bytes, n: int, symbols: list[int]) -> list[int]:
    """``n`` symbols packed by 1, 2, 4 or 8 bits, the lowest bits of a byte first."""
    width = next(w for w in (0, 1, 2, 4, 8) if len(symbols) <= 1 << w)
    if width == 0:
        return symbols[:1] * n
    out: list[int] = []
    for byte in data:
        for shift in range(0, 8, width):
            out.append(symbols[byte >> shift & (1 << width) - 1])
    return out[:n]


def unrun(literals: list[int], runs: list[int], repeated: set[int]) -> list[int]:
    """Literals, those that may repeat followed by as many copies as the next run says."""
    out, at = [], 0
    for v in literals:
        out.append(v)
        if v in repeated:
            out += [v] * runs[at]
            at += 1
    return out


def byte_array_stop(data: bytes, at: int, stop: int) -> tuple[bytes, int]:
    end = data.index(bytes([stop]), at)
    return data[at:end], end + 1


def byte_array_len(data: bytes, at: int, length: int) -> tuple[bytes, int]:
    if at + length > len(data):
        raise EOFError("no bytes left")
    return data[at : at + length], at + length
