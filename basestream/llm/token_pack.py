"""Token-id output: documents as packed id matrices.

Texts are encoded with a public byte-pair vocabulary (its path is a parameter),
split losslessly where they pass a row's capacity, and packed best-fit decreasing:
a segment tree over the amounts of free space finds the row
with the least free space that still holds a piece in logarithmic time. Each output row is one line of the id
matrix: little-endian uint16 or uint32 ids, padded to the capacity with the padding id, the
cumulative segment lengths, the positions at which position ids reset, and for
each segment the document it came from and where it begins there.

Ids take two bytes where the vocabulary and the padding id fit, else four.
``write_matrices`` writes them as files that can be mapped into memory, one matrix a shard.

Sharding is by a hash of the id, so one source or one group of copies never lands
in one task; ``shard_chars`` bounds what a task holds and the number of shards
follows the total length of the texts.

Defined cases: null and empty texts have no ids and appear as segments of length 0;
texts of any length are split without loss; repeated rows and null ids are packed one by
one; other columns than doc_id and text don't matter; no rows give no matrix rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basestream.llm.common import returning, small_batches

#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256


def read_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}


def id_width(ranks: bytes, pad: int) -> type:
    """The least type that holds every id of the vocabulary and the padding id."""
    return np.uint16 if max(pad, *read_ranks(ranks).values()) < 1 << 16 else np.uint32


class Encoder:
    """Byte-pair ids of whole texts."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = read_ranks(ranks)
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


class CapacityTree:
    """Segment tree over possible free space: the rows with each amount free, and for
    every range of amounts whether any row has one. ``tightest`` finds the smallest
    amount of at least a given size in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def put(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._add(free, 1)

    def take(self, free: int) -> int:
        self._add(free, -1)
        return self.rows[free].pop()

    def _add(self, free: int, by: int) -> None:
        at = free + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        if need >= self.size:
            return None
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document number, first id, number of ids), best-fit decreasing."""
    pieces = []
    for doc, size in enumerate(sizes):
        for first in range(0, max(size, 1), capacity):
            pieces.append((min(capacity, size - first), doc, first))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    tree, rows = CapacityTree(capacity), []
    for n, doc, first in pieces:
        free = tree.tightest(n)
        if free is None:
            row, free = len(rows), capacity
            rows.append([])
        else:
            row = tree.take(free)
        rows[row].append((doc, first, n))
        tree.put(free - n, row)
    return rows


SCHEMA = (
    "row_id string, n_tokens int, input_ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
)


def token_rows(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = 2048, shard_chars: int = 12_000_000, pad: int = END_OF_TEXT) -> DataFrame:
    """The packed matrix of ``docs``; the vocabulary file (about a megabyte) is read
    by the driver and broadcast."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    width = id_width(data, pad)
    ranks = docs.sparkSession.sparkContext.broadcast(data)
    small_batches(docs.sparkSession)
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, -(-((total[0] or 0) + 64 * total[1]) // shard_chars))
    shards = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held.get("encode") or held.setdefault("encode", Encoder(ranks.value))

        def done(shard: int, docs_: list[tuple]) -> Iterator[pa.RecordBatch]:
            docs_.sort(key=lambda d: (d[0] is None, d[0] or 0, len(d[1]), d[1].tobytes()))
            rows = pack([len(d[1]) for d in docs_], capacity)
            for at in range(0, len(rows), 512):
                cols: list[list] = [[] for _ in range(7)]
                for k, row in enumerate(rows[at : at + 512], at):
                    line = np.full(capacity, pad, width)
                    ends, used = [0], 0
                    for doc, first, size in row:
                        line[used : used + size] = docs_[doc][1][first : first + size]
                        used += size
                        ends.append(used)
                    for c, v in zip(cols, (f"{shard}-{k}", used, line.tobytes(), ends, ends[:-1], [docs_[d][0] for d, _, _ in row], [f for _, f, _ in row])):
                        c.append(v)
                kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        now, got = None, []
        for b in batches:
            for doc, text, shard in zip(*(b.column(i).to_pylist() for i in range(3))):
                if shard != now:
                    if got:
                        yield from done(now, got)
                    now, got = shard, []
                got.append((doc, encode(text).astype(width)))
        if got:
            yield from done(now, got)

    return shards.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(returning(run), SCHEMA)


def unpack(rows: list[tuple], width: type = np.uint16) -> dict:
    """(doc_ids, doc_offsets, cu_seqlens, input_ids) rows back to ids per document:
    the exact inverse, for unique ids. ``width`` is the ids' type."""
    parts: dict = {}
    for ids, offsets, ends, data in rows:
        line = np.frombuffer(data, width)
        for k, (doc, first) in enumerate(zip(ids, offsets)):
            parts.setdefault(doc, []).append((first, line[ends[k] : ends[k + 1]]))
    return {d: np.concatenate([p for _, p in sorted(ps, key=lambda x: x[0])]) for d, ps in parts.items()}


def write_matrices(rows: DataFrame, folder: str) -> None:
    """``token_rows`` as files: ``folder/ids`` has one binary column of fixed width (the
    matrix, row after row, uncompressed and without a dictionary, so that a reader maps its
    pages), and the segments of each row stand in the same order in other columns. The file
    source's commit protocol writes whole files only, so a lost task leaves none behind."""
    ordered = rows.sortWithinPartitions("row_id")
    ordered.write.option("compression", "none").option("parquet.enable.dictionary", "false").mode("errorifexists").parquet(f"{folder}/ids")


def read_matrix(path: str, width: type = np.uint16) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """One written file: (rows, capacity) ids, cumulative segment lengths, position resets."""
    import pyarrow.parquet as pq

    got = pq.read_table(path, columns=["input_ids", "cu_seqlens", "position_resets"])
    data = got["input_ids"].to_pylist()
    matrix = np.frombuffer(b"".join(data), width).reshape(len(data), -1) if data else np.zeros((0, 0), width)
    return matrix, got["cu_seqlens"].to_pylist(), got["position_resets"].to_pylist()
