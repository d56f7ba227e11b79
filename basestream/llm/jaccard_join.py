"""Exact n-gram Jaccard join of documents, as connected groups.

Jaccard distance is a metric, so pivots can cut a set of documents into Voronoi
regions: a document belongs to its nearest pivot, and is replicated to every other
region whose pivot is at most ``2 * radius`` farther, which by the triangle
inequality loses no link. Regions are joined recursively until they are small, and
then exactly.

Unrelated texts all lie at distance 1 from each other, where no pivot tells them
apart, so the space is first cut losslessly into blocks:

1. Documents with equal shingle sets become one class.
2. A class shows its least ``p`` shingle hashes (tokens), where p exceeds the most
   shingles that a link may lose by a slack. Linked classes then share at least as many
   tokens as the slack leaves, which is counted exactly: pairs below it are no links.
3. Tokens that more than ``HOT`` classes show make no pairs. A pair counts as if it shared
   all hot tokens that both sides have, so none is lost; classes whose hot tokens alone
   could make a link meet by part signatures instead: linked sets differ in at most D
   shingles, hash space is cut into more than D parts, so some part holds the same
   shingles in both. (Empty parts don't count, and a set with too many of them also signs
   its empty parts.)
4. Connected components over what is left are the blocks; no link leaves one.
5. A block of at most ``block_shingles`` shingles is one task's work: Voronoi regions,
   recursion, exact join. A larger block is cut into Voronoi regions across the cluster,
   again and again while that separates it; what pivots can't separate is compared in
   tiles of bounded size. Nothing is capped or sampled.

For whole groups, pairs already in one group aren't compared again: a group of near copies
costs about one comparison per copy, not one per pair. The number of links of every row
(``count_links``) takes the other pairs of each group as well; they are counted, not emitted.

Shingles are 64-bit hashes; two different shingles agree with probability 2**-64.

Defined cases: texts without words have an empty set and link with nothing; with fewer
words than a shingle has, the whole sequence is the one shingle; texts of any length are
used whole; rows with the same doc_id are nodes of their own that share the id; rows
without an id take no part in links and have no component; other columns of the input,
whatever their names, are left alone; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.llm.common import materialise, returning, small_batches, unused
from basestream.operators.ordering import number_rows

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * M2
    x = (x ^ (x >> np.uint64(32))) * M3
    return x ^ (x >> np.uint64(31))


def split_ranges(values: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted, evenly spread 64-bit values that fall into one of
    ``buckets`` (under 2**32) equal ranges; only ranges that have some."""
    if len(values):
        bucket = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        yield from zip(bucket[start].tolist(), start.tolist(), [*start[1:].tolist(), len(values)])


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int, most: int = 200_000):
        self.n, self.most = n, most
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        new = set(words).difference(cache)
        if new:
            if len(cache) + len(new) > self.most:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = mix(out * M1 + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
        if len(h) < self.n:  # a short sequence is not a shingle of its own length elsewhere
            out = mix(out ^ np.uint64(len(h) * int(M3) & 0xFFFFFFFFFFFFFFFF))
        return np.unique(out)


class Signer:
    """Part signatures for a threshold. Levels are size classes [b, b / t); a set signs
    at its own level, which serves its class with itself and the next, and at the level
    below, which serves the class below with its own."""

    def __init__(self, threshold: Fraction, most: int = 1 << 40):
        self.t = threshold
        starts = [1]
        while starts[-1] < most:
            nxt = -(-starts[-1] * threshold.denominator // threshold.numerator)
            starts.append(max(nxt, starts[-1] + 1))
        self.starts = np.array(starts)
        # Greatest difference of a linked pair whose smaller set is in the level's class.
        self.differ = [int((1 - threshold) / threshold * (b - 1)) for b in starts[1:]]

    def parts(self, level: int) -> int:
        d = self.differ[level]
        return 1 if d == 0 else d + 2 + d // 24

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0, np.uint64)
        level = int(np.searchsorted(self.starts, len(s), "right")) - 1
        found = [self._sign(s, level)]
        if level:
            found.append(self._sign(s, level - 1))
        return np.concatenate(found)

    def _sign(self, s: np.ndarray, level: int) -> np.ndarray:
        m, d = self.parts(level), self.differ[level]
        edges = ((np.arange(1, m, dtype=np.float64) / m) * 2.0**64).astype(np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + M1), dtype=np.uint64)])
        value = total[cuts[1:]] - total[cuts[:-1]]
        size = np.diff(cuts)
        tag = (np.uint64(level + 1) << np.uint64(40)) + np.arange(m, dtype=np.uint64)
        sig = mix(mix(value + size.astype(np.uint64) * M3) ^ mix(tag * M1))
        if int((size == 0).sum()) >= m - d:
            return sig
        return sig[size > 0]


def linked(common, a, b, num: int, den: int):
    """den * |intersection| >= num * |union|, in integers."""
    return den * common >= num * (a + b - common)


class Block:
    """The sets of one block, as dense numbers in one array."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, self.flat = np.unique(flat, return_inverse=True)
        self.flat = self.flat.astype(np.int32)
        self.mark = np.zeros(len(values) + 1, np.int8)
        self.num, self.den = threshold.numerator, threshold.denominator
        self.radius = float(1 - threshold)
        self.parent = list(range(len(sets)))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def common(self, i: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with the members' sets."""
        own = self.flat[self.start[i] : self.start[i + 1]]
        self.mark[own] = 1
        size = self.size[members]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[members] - (ends - size), size)
        got = np.add.reduceat(self.mark[self.flat[at]], ends - size, dtype=np.int64)
        self.mark[own] = 0
        return got

    def compare(self, i: int, members: np.ndarray) -> np.ndarray:
        """Links set i with the members it is linked to; distances to all of them."""
        c = self.common(i, members)
        for j in members[linked(c, self.size[i], self.size[members], self.num, self.den)]:
            self.union(i, int(j))
        return 1 - c / (self.size[i] + self.size[members] - c)

    def join(self, members: np.ndarray, leaf: int = 48, pivots: int = 8, slack: float = 1e-9) -> None:
        """Links among members by Voronoi regions, recursively and exactly."""
        while len(members) > leaf:
            roots = np.array([self.find(int(i)) for i in members])
            if (roots == roots[0]).all():
                return
            # Farthest-first pivots; each is finished once compared with all members.
            first = members[int(np.argmax(self.size[members]))]
            chosen, away = [int(first)], self.compare(int(first), members)
            table = [away]
            nearest = away.copy()
            for _ in range(pivots - 1):
                k = int(np.argmax(nearest))
                if nearest[k] <= 0:
                    break
                chosen.append(int(members[k]))
                table.append(self.compare(chosen[-1], members))
                nearest = np.minimum(nearest, table[-1])
            d = np.array(table)
            rest = ~np.isin(members, chosen)
            inside = d <= nearest[None] + 2 * self.radius + slack
            regions = [members[rest & inside[k]] for k in range(len(chosen))]
            if max(len(r) for r in regions) > 0.8 * len(members):
                break  # pivots don't separate these; the window join below is exact
            for r in regions:
                if len(r) > 1:
                    self.join(r, leaf, pivots, slack)
            return
        self._exact(members)

    def _exact(self, members: np.ndarray) -> None:
        """All links among members that don't yet share a group. Ordered by their number of
        holders here, a set's rarest shingles up to its size less ``t`` of it, and one
        more, must hold one that a linked set's do too; only such pairs are compared."""
        order = members[np.argsort(self.size[members], kind="stable")]
        size, n = self.size[order], len(order)
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if n else 0) + np.repeat(self.start[order] - (ends - size), size)
        _, token, holders = np.unique(self.flat[at], return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(n), size)
        ranked = np.lexsort((token, holders[token], doc))
        token, place = token[ranked], np.arange(len(token)) - np.repeat(ends - size, size)
        least = -(-size * self.num // self.den)
        rare = (place < (size - least + 1)[doc]) & (holders[token] > 1)
        token, doc = token[rare], doc[rare]
        by_token = np.lexsort((doc, token))
        token, holder = token[by_token], doc[by_token]
        until = np.searchsorted(token, token, "right")
        # Entries of each document, in the order of documents.
        mine = np.argsort(holder, kind="stable")
        first = np.searchsorted(holder[mine], np.arange(n + 1))
        group = np.array([self.find(int(i)) for i in order], np.int64)
        most = size * self.den // self.num
        for i in range(n):
            entries = mine[first[i] : first[i + 1]]
            spans = [holder[e + 1 : until[e]] for e in entries.tolist() if until[e] > e + 1]
            if not spans:
                continue
            others = np.concatenate(spans)
            others = others[(group[others] != group[i]) & (size[others] <= most[i])]
            if not len(others):
                continue
            others = np.unique(others)
            c = self.common(int(order[i]), order[others])
            for j in others[linked(c, size[i], size[others], self.num, self.den)].tolist():
                if group[j] != group[i]:
                    self.union(int(order[i]), int(order[j]))
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group[group == old] = new


def forest(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """Fewer edges (a, b) with the same components: each run of ``most`` edges of a
    partition becomes stars around its least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        seen = 0
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            seen += b.num_rows
            if seen >= most:
                yield _edges([(i, r) for i in list(up) if (r := find(i)) != i])
                up.clear()
                seen = 0
        yield _edges([(i, r) for i in list(up) if (r := find(i)) != i])

    return edges.select("a", "b").mapInArrow(returning(run), EDGES)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the least node it reaches.
    Alternates linking larger neighbours and own neighbours to the least one seen;
    every round is a few grouped shuffles, without a list of any node's neighbours."""
    now = materialise(forest(materialise(edges.select("a", "b"))).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        # Large star: each neighbour greater than a node links to the least node around it.
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its lesser neighbours link to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").unionAll(low.select(F.col("a").alias("x"), "m"))
        new = materialise(small.select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        before, after = ((x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"))).first() for x in (now, new))
        now = new
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    tops = now.select(F.col("b").alias("node")).join(now.select(F.col("a").alias("node")), "node", "left_anti").distinct()
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(tops.select("node", F.col("node").alias("root")))


#: A token is hot if more classes than this show it.
HOT = 16


def slack(size, t: Fraction):
    """Tokens that a set of ``size`` shingles shows beyond those a link may lose."""
    return np.minimum(-(-size * t.numerator // t.denominator), 16 + size // 16)


def shown(size, t: Fraction):
    """How many of its least hashes a set shows."""
    return size - -(-size * t.numerator // t.denominator) + slack(size, t)


def needed(x, y, t: Fraction):
    """Tokens that linked sets of these sizes share at least. They have at least ``common``
    shingles in common; of those, the k least stand among the first size - common + k of
    either set."""
    common = -(-t.numerator * (x + y) // (t.numerator + t.denominator))
    return np.minimum(shown(x, t) - x + common, shown(y, t) - y + common)


def pairs_of(token: np.ndarray, cls: np.ndarray, size: np.ndarray, t: Fraction) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the classes that show the tokens: pairs (a, b, tokens in common, tokens needed)
    by tokens that aren't hot, and (cls, size, hot tokens)."""
    names, first, dense = np.unique(cls, return_index=True, return_inverse=True)
    sizes = size[first].astype(np.int64)
    order = np.lexsort((dense, token))
    token, dense = token[order], dense[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (dense[1:] != dense[:-1])
    token, dense = token[fresh], dense[fresh]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    many = np.diff(np.append(start, len(token)))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, HOT + 1):
        at = start[many == k]
        if len(at):
            own = dense[at[:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            a, b = own[:, i].ravel(), own[:, j].ravel()  # a < b
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            ok = small * t.denominator >= large * t.numerator
            found, count = np.unique(a[ok] * len(names) + b[ok], return_counts=True)
            keys.append(found)
            counts.append(count)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)
    a, b = key // len(names), key % len(names)
    hot = np.bincount(dense[np.repeat(many > HOT, many)], minlength=len(names))
    has = hot > 0
    return [names[a], names[b], total, needed(sizes[a], sizes[b], t)], [names[has], sizes[has], hot[has].astype(np.int64)]


def scan(docs: DataFrame, n: int, t: Fraction, buckets: int, parts: int, most_docs: int = 30_000, most_tokens: int = 500_000) -> DataFrame:
    """One pass over the texts and one shuffle of tokens: rows of packed ``docs``
    (has an id, doc_id, shingles, class), ``pairs`` and ``hot`` as ``pairs_of`` has them.
    Tokens travel in packed arrays, one for each of ``buckets`` ranges of their values;
    the number of ranges follows the input."""
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    columns = ["bucket", "tokens", "own", "names", "sizes", "docs"]

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        told: list[tuple[int, int, int, int]] = []
        found: dict[int, np.ndarray] = {}
        size: list[int] = []
        amount = 0

        def flush() -> pa.RecordBatch:
            # Any range will do for the rows of documents; their ids and classes spread them.
            rows = [(sum(x[1] * 31 + x[3] for x in told) % buckets, b"", b"", b"", b"", np.array(told, np.int64).tobytes())]
            if found:
                names, sizes = np.array(list(found), np.int64), np.array(size, np.int64)
                own = np.repeat(np.arange(len(names), dtype=np.uint16), [len(x) for x in found.values()])
                token = mix(np.concatenate(list(found.values())) ^ M1)
                order = np.argsort(token)
                token, own = token[order], own[order]
                for k, a, z in split_ranges(token, buckets):
                    here, index = np.unique(own[a:z], return_inverse=True)
                    rows.append((k, token[a:z].tobytes(), index.astype(np.uint16).tobytes(), names[here].tobytes(), sizes[here].tobytes(), b""))
            told.clear()
            found.clear()
            size.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=columns)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingle(text)
                    c = class_of(s)
                    told.append((doc_id is not None, doc_id or 0, len(s), c))
                    if len(s) and doc_id is not None and c not in found:
                        found[c] = s[: int(shown(len(s), t))].copy()
                        size.append(len(s))
                        amount += len(found[c])
                    if len(told) >= most_docs or amount >= most_tokens:
                        yield flush()
                        amount = 0
        if told:
            yield flush()

    def packed(told: list[np.ndarray]) -> Iterator[bytes]:
        for at in range(0, len(told[0]), 100_000):
            yield np.stack([x[at : at + 100_000] for x in told]).tobytes()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 1):
            out: list[tuple] = [(r[4], None, None) for r in rows if r[4]]
            rows = [r for r in rows if r[0]]
            if rows:
                own = [np.frombuffer(r[1], np.uint16) for r in rows]
                pairs, hot = pairs_of(
                    np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]),
                    np.concatenate([np.frombuffer(r[2], np.int64)[o] for r, o in zip(rows, own)]),
                    np.concatenate([np.frombuffer(r[3], np.int64)[o] for r, o in zip(rows, own)]),
                    t,
                )
                out += [(None, x, None) for x in packed(pairs)] + [(None, None, x) for x in packed(hot)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(3)], names=["docs", "pairs", "hot"])

    shows = docs.mapInArrow(returning(show), "bucket long, tokens binary, own binary, names binary, sizes binary, docs binary")
    return materialise(shows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(returning(meet), "docs binary, pairs binary, hot binary"))


def unpacked(told: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The rows of a packed column of ``scan``; all are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                got = np.frombuffer(x, np.int64)
                got = got.reshape(-1, len(names)).T if column == "docs" else got.reshape(len(names), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in got], names=names)

    return told.select(column).where(F.col(column).isNotNull()).mapInArrow(returning(run), ", ".join(f"{x} long" for x in names))


def stars(sigs: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures in order with one class each, and edges of the other classes to it."""
    order = np.argsort(sigs, kind="stable")
    sigs, cls = sigs[order], cls[order]
    start = np.concatenate([[True], sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, bool)
    first = cls[start][np.cumsum(start) - 1] if len(sigs) else cls
    other = first != cls
    edges = np.unique(np.stack([cls[other], first[other]], 1), axis=0)
    return sigs[start], cls[start], edges[:, 0], edges[:, 1]


def candidate_edges(docs: DataFrame, n: int, threshold: Fraction, buckets: int, parts: int) -> DataFrame:
    """(a, b): classes with a signature in common, as stars. A task combines its own
    signatures first: of the classes that share one, a single class goes on and the others
    become edges, so a hot signature costs one entry per batch. Signatures travel as packed
    arrays per range of values (``buckets`` ranges, whose number follows the input)."""

    def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(n), Signer(threshold)
        for b in batches:
            for at in range(0, b.num_rows, 50_000):
                found: dict[int, np.ndarray] = {}
                for t in b.column(0).slice(at, 50_000).to_pylist():
                    s = shingle(t)
                    c = class_of(s)
                    if len(s) and c not in found:
                        found[c] = sign(s)
                if not found:
                    continue
                names = np.array(list(found), np.int64)
                owner = np.repeat(np.arange(len(names)), [len(x) for x in found.values()])
                sigs, own, a, z = stars(np.concatenate(list(found.values())), owner)
                rows = []
                if len(a):
                    rows.append((int(names.sum()) % buckets, b"", b"", b"", np.stack([names[a], names[z]]).tobytes()))
                for k, at_, to in split_ranges(sigs, buckets):
                    here, index = np.unique(own[at_:to], return_inverse=True)
                    rows.append((k, sigs[at_:to].tobytes(), index.astype(np.uint16).tobytes(), names[here].tobytes(), b""))
                if not rows:
                    continue
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["bucket", "sigs", "own", "names", "pairs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 1):
            sigs = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
            cls = np.concatenate([np.frombuffer(r[2], np.int64)[np.frombuffer(r[1], np.uint16)] for r in rows])
            _, _, a, b = stars(sigs, cls)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            for r in rows:
                if r[3]:
                    p = np.frombuffer(r[3], np.int64).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    packed = docs.select("text").mapInArrow(returning(sign_batches), "bucket long, sigs binary, own binary, names binary, pairs binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(returning(meet), EDGES).distinct()


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same leading ``keys`` columns, from sorted batches."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


EDGES = "a long, b long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def join_small(members: DataFrame, n: int, threshold: Fraction, parts: int) -> DataFrame:
    """members: (block, cls, text), one row per class. Edges (cls, least cls of its group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        out: list[tuple[int, int]] = []
        for _, rows in grouped(batches, 1):
            sets = {}
            if len(rows) > 1:
                for c, t in rows:
                    s = shingle(t)
                    if class_of(s) == c:
                        sets[c] = s
            names = sorted(sets)
            if len(names) > 1:
                block = Block([sets[c] for c in names], threshold)
                block.join(np.arange(len(names)))
                out += [(names[i], names[r]) for i in range(len(names)) if (r := block.find(i)) != i]
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return members.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(returning(run), EDGES)


def with_texts(members: DataFrame, texts: DataFrame) -> DataFrame:
    return members.join(texts.select("cls", "text"), "cls")


def measure(members: DataFrame, texts: DataFrame, n: int, t: Fraction, limit: int, parts: int, pivots: int, turn: int) -> DataFrame:
    """members: (block, cls, n_shingles). (block, cls, pivot, region): rows with a pivot are
    links to it, the others place a member in the region of the pivot with that number.
    Pivots of a block go once to each of its shares, before the members dealt to it."""
    ranks = [F.min(F.struct(F.xxhash64("cls", F.lit(turn * pivots + k)).alias("h"), "cls")).alias(f"p{k}") for k in range(pivots)]
    about = members.groupBy("block").agg(F.ceil(F.sum("n_shingles") / limit).cast("long").alias("shares"), *ranks)
    chosen = about.select("block", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.cls") for k in range(pivots)]))).alias("cls"), "shares")
    heads = with_texts(chosen, texts).select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "cls", "text")
    dealt = with_texts(members.join(about.select("block", "shares"), "block"), texts)
    dealt = dealt.select("block", F.pmod(F.xxhash64("cls"), F.col("shares")).alias("share"), F.lit(1).alias("kind"), "cls", "text")
    window = 2 * float(1 - t) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        now, known = None, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows: list[tuple] = []
                for block, share, kind, cls, text in zip(*(b.slice(at, 500).column(i).to_pylist() for i in range(5))):
                    if (block, share) != now:
                        now, known = (block, share), []
                    s = shingle(text)
                    if kind == 0:
                        known.append((cls, s))
                        known.sort(key=lambda x: x[0])
                        continue
                    far = []
                    for p, q in known:
                        c = len(np.intersect1d(s, q, assume_unique=True))
                        far.append(1 - c / (len(s) + len(q) - c))
                        if p != cls and linked(c, len(s), len(q), t.numerator, t.denominator):
                            rows.append((block, cls, p, -1))
                    rows += [(block, cls, None, k) for k, d in enumerate(far) if d <= min(far) + window]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["block", "cls", "pivot", "region"])

    both = heads.unionByName(dealt).repartition(parts, "block", "share").sortWithinPartitions("block", "share", "kind")
    return materialise(both.mapInArrow(returning(run), "block long, cls long, pivot long, region int"))


def tile_join(members: DataFrame, texts: DataFrame, n: int, t: Fraction, tile_shingles: int, parts: int) -> DataFrame:
    """members: (block, cls, n_shingles, grp). The members outside a block's main group meet
    all of the block, in tiles of bounded size."""
    sizes = members.groupBy("block", "grp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("block").agg(F.max(F.struct("n", "grp")).alias("top"))
    rest = members.join(main, "block").withColumn("inner", F.col("grp") == F.col("top.grp")).drop("top")
    amount = rest.groupBy("block").agg(F.sum("n_shingles").alias("every"), F.sum(F.when(~F.col("inner"), F.col("n_shingles")).otherwise(0)).alias("outer"))
    shape = amount.select("block", F.ceil(F.col("every") / tile_shingles).cast("int").alias("ny"), F.greatest(F.lit(1), F.ceil(F.col("outer") / tile_shingles).cast("int")).alias("nx"))
    tiled = rest.join(shape, "block")
    x = tiled.where(~F.col("inner")).select("block", "cls", "grp", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("nx")).cast("int").alias("tx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("ty"))
    y = tiled.select("block", "cls", "grp", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("tx"), F.pmod(F.xxhash64("cls", F.lit(2)), F.col("ny")).cast("int").alias("ty"))
    tiles = x.unionByName(y).select(F.xxhash64("block", "tx", "ty").alias("tile"), "cls", "grp").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for _, rows in grouped(batches, 1):
            rows = sorted({r[0]: r for r in rows}.values())
            block = Block([shingle(r[2]) for r in rows], t)
            first: dict[int, int] = {}
            for i, r in enumerate(rows):
                block.union(first.setdefault(r[1], i), i)
            block._exact(np.arange(len(rows)))
            yield _edges([(rows[i][0], rows[k][0]) for i in range(len(rows)) if (k := block.find(i)) != i])

    return with_texts(tiles, texts).select("tile", "cls", "grp", "text").repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(returning(compare), EDGES)


def join_large(members: DataFrame, n: int, t: Fraction, limit: int, parts: int, pivots: int = 6, depth: int = 8) -> DataFrame:
    """members: (block, cls, n_shingles, text) of blocks too large for a task. Edges (a, b)
    with the same components as the links have.

    Each turn measures the members against pivots of their block. Regions that hold at
    most ``limit`` shingles are joined by a task each, larger ones take another turn with
    pivots of their own. Where the windows would more than double a block, pivots
    don't separate it, and it is compared in tiles instead."""
    texts = members.select("cls", "text")
    now = members.select("block", "cls", "n_shingles")
    links, found = [], []
    for turn in range(depth):
        told = measure(now, texts, n, t, limit, parts, pivots, turn)
        links.append(told.where("pivot is not null").select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
        # Who is linked to a pivot is in the pivot's group.
        reached = links[0]
        for x in links[1:]:
            reached = reached.unionByName(x)
        group = connected(reached).select(F.col("node").alias("cls"), F.col("root").alias("grp"))
        known = now.join(group, "cls", "left").select("block", "cls", "n_shingles", F.coalesce("grp", "cls").alias("grp"))
        whole = known.groupBy("block").agg(F.sum("n_shingles").alias("whole"), F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1")
        placed = told.where("region >= 0").select("block", "region", "cls").join(known, ["block", "cls"])
        regions = placed.groupBy("block", "region").agg(F.sum("n_shingles").alias("every"), F.min("grp").alias("low"), F.max("grp").alias("high"))
        spread = regions.groupBy("block").agg(F.sum("every").alias("spread"), F.max("every").alias("widest"))
        state = materialise(whole.join(spread, "block").select("block", ((F.col("spread") <= 2 * F.col("whole")) & (F.col("widest") < F.col("whole"))).alias("parted")))
        if state.isEmpty():
            break
        stuck = state.where(~F.col("parted") | F.lit(turn == depth - 1)).select("block")
        if not stuck.isEmpty():
            found.append(tile_join(known.join(stuck, "block"), texts, n, t, limit // 4, parts))
        if turn == depth - 1:
            break
        going = regions.where("low <> high").join(state.where("parted").select("block"), "block").select("block", "region", "every")
        deeper = materialise(placed.join(going, ["block", "region"]).select(F.xxhash64("block", "region", F.lit(turn)).alias("block"), "cls", "n_shingles", "every"))
        leaves = deeper.where(F.col("every") <= limit)
        if not leaves.isEmpty():
            found.append(join_small(with_texts(leaves, texts).select("block", "cls", "text"), n, t, parts))
        now = deeper.where(F.col("every") > limit).select("block", "cls", "n_shingles")
        if now.isEmpty():
            break
    for x in found + links[1:]:
        links[0] = links[0].unionByName(x)
    return links[0]


def link_counts(members: DataFrame, texts: DataFrame, n: int, t: Fraction, tile_shingles: int, parts: int) -> DataFrame:
    """members: (block, cls, n_shingles, copies). (cls, links): how many documents of other
    classes each class is linked to. A block is cut into k x k tiles of bounded size;
    every ordered pair of its members meets in one of them and is only counted, not emitted."""
    shape = members.groupBy("block").agg(F.ceil(F.sum("n_shingles") / tile_shingles).cast("int").alias("k"), F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = members.join(shape, "block").select(
        "block", "cls", "copies", F.sequence(F.lit(0), F.col("k") - 1).alias("ks"), *[F.pmod(F.xxhash64("cls", F.lit(i)), F.col("k")).cast("int").alias(x) for i, x in ((1, "own"), (2, "other"))]
    )
    x = dealt.select("block", "cls", "copies", F.lit(1).alias("side"), F.col("own").alias("tx"), F.explode("ks").alias("ty"))
    y = dealt.select("block", "cls", "copies", F.lit(2).alias("side"), F.explode("ks").alias("tx"), F.col("other").alias("ty"))
    tiles = x.unionByName(y).groupBy(F.xxhash64("block", "tx", "ty").alias("tile"), "cls").agg(F.max("copies").alias("copies"), F.sum("side").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for _, rows in grouped(batches, 1):
            block = Block([shingle(r[3]) for r in rows], t)
            copies, side = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
            there = np.flatnonzero(side & 2)
            there = there[np.argsort(block.size[there], kind="stable")]
            sizes = block.size[there]
            found = []
            for i in np.flatnonzero(side & 1).tolist():
                # Only sets of a size that can be linked.
                low, high = -(-block.size[i] * block.num // block.den), block.size[i] * block.den // block.num
                near = there[np.searchsorted(sizes, low) : np.searchsorted(sizes, high, "right")]
                near = near[near != i]
                if len(near):
                    c = block.common(i, near)
                    k = int(copies[near[linked(c, block.size[i], block.size[near], block.num, block.den)]].sum())
                    if k:
                        found.append((rows[i][0], k))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64())], names=["cls", "links"])

    rows = with_texts(tiles, texts).select("tile", "cls", "copies", "side", "text").repartition(parts, "tile").sortWithinPartitions("tile")
    return rows.mapInArrow(returning(run), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))


def representatives(members: DataFrame, n: int) -> DataFrame:
    """Keep the rows of ``members`` whose text has the class they stand for (an id
    may repeat with other texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for b in batches:
            cls = b.column(b.schema.get_field_index("cls")).to_pylist()
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([class_of(shingle(t)) == c for c, t in zip(cls, text)], pa.bool_()))

    return members.mapInArrow(returning(run), members.schema)


def light(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A materialised side of a few long columns: sent to all if it has at most ``most``
    rows (some 20 MB), else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def jaccard_groups(docs: DataFrame, n: int = 3, threshold: str = "0.9", block_shingles: int = 1_000_000, bucket_tokens: int = 250_000, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; component_id is the
    least doc_id reachable by links. With ``count_links`` also n_links, the number of other
    rows (with an id) that the row is linked to, equal texts included; then pairs inside a
    group are compared too, which takes time with the square of a group's size."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    t = Fraction(threshold)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # About a shingle for six bytes, of which slack and losses are shown.
    shingles = (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    buckets = max(8, int(shingles * (float(1 - t) + 1 / 16) / bucket_tokens))
    told = scan(plain, n, t, buckets, parts)
    known = unpacked(told, "docs", ["has_id", "id", "n_shingles", "cls"]).select(F.when(F.col("has_id") == 1, F.col("id")).alias("doc_id"), "n_shingles", "cls")
    owners = known.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.count("doc_id").alias("copies"))

    pairs = unpacked(told, "pairs", ["a", "b", "c", "need"]).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need"))
    hot = materialise(unpacked(told, "hot", ["cls", "size", "h"]).groupBy("cls").agg(F.max("size").alias("size"), F.sum("h").alias("h")))
    if hot.isEmpty():
        candidates = pairs.where("c >= need").select("a", "b")
    else:
        for x in ("a", "b"):
            pairs = pairs.join(hot.select(F.col("cls").alias(x), F.col("h").alias(f"h{x}")), x, "left")
        close = pairs.where("c + least(coalesce(ha, 0), coalesce(hb, 0)) >= need").select("a", "b")
        # The least that a link of the class needs, whose smaller set has at least ``t`` of its size.
        least = F.expr(f"(size * {t.numerator} + {t.denominator - 1}) div {t.denominator}")
        need = F.least(F.expr(f"(least_size * {t.numerator} + {t.denominator - 1}) div {t.denominator}"), F.expr("16 + least_size div 16"))
        crowded = hot.withColumn("least_size", least).where(F.col("h") >= need).select("cls")
        signing = materialise(owners.join(crowded, "cls").where("rep is not null").select(F.col("rep").alias("doc_id")))
        signed = candidate_edges(plain.join(light(signing), "doc_id", "left_semi"), n, t, buckets, parts)
        candidates = close.unionByName(signed)
    blocks = connected(candidates).select(F.col("node").alias("cls"), F.col("root").alias("block"))
    placed = materialise(owners.join(blocks, "cls").where("rep is not null").select("block", "cls", "n_shingles", "copies", F.col("rep").alias("doc_id")))
    members = plain.join(light(placed.drop("copies")), "doc_id").select("block", "cls", "n_shingles", "text")
    large = placed.groupBy("block").agg(F.sum("n_shingles").alias("amount")).where(F.col("amount") > block_shingles).select("block")

    if large.isEmpty():
        edges = join_small(members.select("block", "cls", "text"), n, t, parts)
    else:
        small = members.join(large, "block", "left_anti").select("block", "cls", "text")
        big = materialise(representatives(members.join(large, "block", "left_semi"), n).dropDuplicates(["cls"]))
        edges = join_small(small, n, t, parts).unionByName(join_large(big, n, t, block_shingles, parts))
        edges = connected(edges).select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    # Links lead from a class to the root of its group; the group's id is its least document.
    roots = materialise(edges)
    grouped_ = owners.join(roots, owners["cls"] == roots["a"], "left").select("cls", "rep", "copies", F.col("a").isNotNull().alias("moved"), F.coalesce("b", "cls").alias("root"))
    least_ = grouped_.groupBy("root").agg(F.min("rep").alias("component"), F.sum("copies").alias("rows")).where("rows > 1")
    found = materialise(grouped_.join(least_, "root").select("cls", "component", "copies"))
    out = [F.col("doc_id"), F.col("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")]
    if count_links:
        # No link leaves a group, so only groups are cut into tiles.
        groups = materialise(found.join(owners.select("cls", "n_shingles", F.col("rep").alias("doc_id")), "cls").select(F.col("component").alias("block"), "cls", "n_shingles", "copies", "doc_id"))
        texts = materialise(representatives(plain.join(light(groups.select("cls", "doc_id")), "doc_id").select("cls", "text"), n).dropDuplicates(["cls"]))
        links = link_counts(groups, texts, n, t, block_shingles // 4, parts)
        found = materialise(found.join(links, "cls", "left"))
        out.append(F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
    return known.join(light(found), "cls", "left").select(*out)


def keep_one(docs: DataFrame, n: int = 5, threshold: str = "0.8", **options) -> DataFrame:
    """One row of each group stays: the one with the least id (rows without an id come
    last). Where ids repeat or lack, rows are told apart by numbers of their own."""
    doc_id = F.col("doc_id").cast("long")
    odd = docs.select(doc_id.alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("doc_id is null or rows > 1")
    if odd.isEmpty():
        key, keyed = "doc_id", docs
    else:
        key = unused(docs, "row_key")
        keyed = number_rows(docs, [doc_id.asc_nulls_last(), F.col("text").cast("string")], key)
    groups = jaccard_groups(keyed.select(F.col(key).alias("doc_id"), "text"), n, threshold, **options)
    out = unused(keyed, "gone_id")
    gone = materialise(groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(out)))
    return keyed.join(light(gone), F.col(key).cast("long") == F.col(out), "left_anti").select(*docs.columns)


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b using (g) where a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * c >= 90 * (s.n + t.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
least as (select x, min(y) as y from reach group by 1),
degree as (select x, count(*) as n_links from both_ways group by 1)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) as component_id, coalesce(e.n_links, 0) as n_links
from documents d left join sizes s using (doc_id) left join least l on l.x = d.doc_id left join degree e on e.x = d.doc_id
"""
