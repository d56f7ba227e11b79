"""Conflict-constrained best-fit packing of documents into training rows.

Open bins stand in order of their residual capacity. A document goes to the
tightest bin that holds it and does not conflict with it: search begins at the
successor of its length among the residuals and continues upward past every bin
whose bitmaps clash. A bin carries, as bitmaps, the sources it holds (one bit plane
per allowed document of a source) and the duplicate clusters it holds; two documents
of a cluster never share a bin, and a source fills at most ``max_per_source`` places.

A tree stands over the bins in their order, and every node has the conjunction of the
bitmaps below it: a run of bins that a hot source or a large cluster has closed is passed
in one step, so the search stays logarithmic whatever the sources' and clusters' sizes.

A text longer than a bin is cut into pieces without loss; whole pieces fill bins of
their own and the rest is packed like a document of the same cluster.

Packing is exact best-fit decreasing inside a shard. Shards are a hash of the id, so
neither a hot source nor a large cluster lands in one task, and their number follows
the total length: ``shard_tokens`` bounds what a task holds.

Defined cases: null and empty texts have length 0 and are packed as empty pieces (any
compatible bin takes them); a null source is a source of its own, and a null id hashes
like any value; repeated rows are packed one by one and, being copies, never together;
only doc_id, text and source (and ``length``, ``cluster``) are read, other columns
don't matter; no rows give no bins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basestream.llm.common import returning, small_batches

SCHEMA = (
    "bin_id string, doc_id long, piece int, n_pieces int, first_token long, n_tokens long, "
    "bin_offset long, bin_tokens long, source string, cluster string"
)


#: Clusters of fewer documents have no bit in the tree: their few bins are passed one by one.
LARGE_CLUSTER = 16


class BestFit:
    """Bins of one shard, in order of (residual, number), as leaves of a sparse binary tree."""

    def __init__(self, capacity: int, max_per_source: int, most_bins: int = 1 << 20):
        self.capacity, self.planes = capacity, max_per_source
        self.low = max(1, most_bins).bit_length()
        self.base = 1 << (self.low + (capacity + 1).bit_length())
        self.closed: dict[int, int] = {}
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.large: list[int] = []
        self.free: list[int] = []

    def _put(self, key: int, closed: int) -> None:
        tree, node = self.closed, self.base + key
        tree[node] = closed
        while node > 1:
            beside = tree.get(node ^ 1)
            if beside is not None:
                closed &= beside
            node >>= 1
            if tree.get(node) == closed:
                return
            tree[node] = closed

    def _take(self, key: int) -> None:
        tree, node = self.closed, self.base + key
        del tree[node]
        while node > 1:
            left, right = tree.get(node & ~1), tree.get(node | 1)
            node >>= 1
            if left is None and right is None:
                del tree[node]
                continue
            now = right if left is None else left if right is None else left & right
            if tree[node] == now:
                return
            tree[node] = now

    def _next(self, key: int, marks: int) -> int | None:
        """The first leaf from ``key`` on that none of the marks closes."""
        tree, base = self.closed, self.base
        node = base + key
        while True:
            closed = tree.get(node)
            if closed is not None and not closed & marks:
                if node >= base:
                    return node - base
                node *= 2
                continue
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1

    def place(self, size: int, source: int, cluster: int | None = None, large: bool = False) -> tuple[int, int]:
        """Bin number and offset for an item. source and cluster are bit numbers;
        a cluster of one document needs none, a large one has its bit in the tree."""
        bit = 1 << 2 * source
        mark = 0 if cluster is None else 1 << cluster
        marks = bit | (mark and large and 2 << 2 * cluster)
        last = self.planes - 1
        key = self._next(size << self.low, marks)
        while key is not None and self.clusters[key & (1 << self.low) - 1] & mark:
            key = self._next(key + 1, marks) if key + 1 < self.base else None
        if key is None:
            b, residual = len(self.free), self.capacity
            self.free.append(residual)
            self.sources.append([0] * self.planes)
            self.clusters.append(0)
            self.large.append(0)
        else:
            b, residual = key & (1 << self.low) - 1, key >> self.low
            self._take(key)
        planes = self.sources[b]
        for k in range(self.planes):
            if not planes[k] & bit:
                planes[k] |= bit
                break
        self.clusters[b] |= mark
        if large:
            self.large[b] |= marks ^ bit
        self.free[b] = residual - size
        self._put(self.free[b] << self.low | b, planes[last] | self.large[b])
        return b, self.capacity - residual


def pack(items: Iterable[tuple], capacity: int, max_per_source: int) -> list[tuple]:
    """items: (doc_id, length, source, cluster). Rows of SCHEMA with bin numbers."""
    pieces = []
    for order, (doc, size, source, cluster) in enumerate(items):
        n = max(1, -(-size // capacity))
        for p in range(n):
            pieces.append((min(capacity, size - p * capacity), order, p, n, doc, source, cluster))
    members: dict = {}
    for _, _, _, _, _, _, cluster in pieces:
        members[cluster] = members.get(cluster, 0) + 1
    # Large clusters get the lowest numbers.
    cluster_bits = {c: k for k, c in enumerate(sorted((c for c, m in members.items() if m > 1), key=lambda c: -members[c]))}
    source_bits: dict = {}
    bins = BestFit(capacity, max_per_source, len(pieces))
    out = []
    for size, order, p, n, doc, source, cluster in sorted(pieces, key=lambda x: (-x[0], x[4] is None, x[4] or 0, x[1], x[2])):
        s = source_bits.setdefault(source, len(source_bits))
        b, offset = bins.place(size, s, cluster_bits.get(cluster), members[cluster] >= LARGE_CLUSTER)
        out.append((b, doc, p, n, p * capacity, size, offset, source, cluster))
    return [(b, *rest[:6], capacity - bins.free[b], *rest[6:]) for b, *rest in out]


def lengths(docs: DataFrame) -> DataFrame:
    """Words of a text, as its length in tokens."""
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def pack_documents(docs: DataFrame, capacity: int = 2048, max_per_source: int = 4, shard_tokens: int = 4_000_000, length=None, cluster=None) -> DataFrame:
    """One row per piece: its bin, its place there, and its place in the document.
    ``length`` and ``cluster`` are columns; by default the number of words, and a
    digest of the text, so that equal texts form a cluster."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    n_tokens = lengths(docs) if length is None else length
    mark = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")) if cluster is None else cluster.cast("string")
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), n_tokens.cast("long").alias("size"), source.alias("source"), mark.alias("cluster")
    )
    small_batches(docs.sparkSession)
    total = docs.select(n_tokens.cast("long").alias("size")).agg(F.sum("size"), F.count(F.lit(1))).first()
    n = max(1, -(-((total[0] or 0) + 8 * total[1]) // shard_tokens))
    shards = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(n)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3] or ""))
            packed = [(f"{shard}-{b}", *rest) for b, *rest in pack(rows, capacity, max_per_source)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*packed)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        now, rows = None, []
        for b in batches:
            for doc, size, source_, cluster_, shard in zip(*(b.column(i).to_pylist() for i in range(5))):
                if shard != now:
                    if rows:
                        yield done(now, rows)
                    now, rows = shard, []
                rows.append((doc, size, source_, cluster_))
        if rows:
            yield done(now, rows)

    return shards.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(returning(run), SCHEMA)
