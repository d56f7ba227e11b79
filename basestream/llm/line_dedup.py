"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

State
  * ``pairs``  - which document holds which line key: (key, doc_id);
  * ``counts`` - the exact reference-count table: (key, n_docs, keep_doc);
  * ``filters`` - per shard a cuckoo filter over the keys that reach
    ``min_docs``. A key enters its filter when a document insertion lifts its
    count to the threshold and leaves it when a deletion takes it below, which a
    Bloom filter could not do.

Insertions and deletions group only the pairs they bring or take; the counts of
other keys are carried over, and only keys that lose the document that kept their line
look for another one among the pairs.

Every line of a document probes its shard's filter; only hits (a superset of
the repeated lines) go on to the exact table, so a false positive costs one
looked-up row and never changes a result. Filters are broadcast while
their measured total stays under ``max_broadcast_bytes``; beyond it the keys go to their
shards' filters instead, each shard's lines dealt over ``SALTS`` tasks, so that a
frequent line doesn't fill one.

Defined cases: null or empty text is one empty line; texts and lines of any length are
taken whole; rows that share a doc_id are one document; a null doc_id counts as one
document that never keeps a line others hold; columns named like an output (text,
n_lines, n_dropped, kept_sha256) are replaced, all others pass through; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basestream.llm.common import materialise, returning, small_batches, unused, with_columns_arrow

#: Tasks over which the lines of one shard are dealt.
SALTS = 16
STRIP = "\t\n\x0b\x0c\r "
SLOTS = 4


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four slots a bucket."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1
            while buckets * SLOTS * 0.85 < max(capacity, 1):
                buckets *= 2
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def _parts(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 16)
        fp = raw[:, 4:6].copy().view(np.uint16).ravel()
        fp[fp == 0] = 1
        return fp, raw[:, 8:12].copy().view(np.uint32).ravel()

    def _other(self, bucket, fp):
        with np.errstate(over="ignore"):
            return (bucket ^ (fp.astype(np.uint32) * np.uint32(0x5BD1E995))) & np.uint32(len(self.table) - 1)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        fp, h = self._parts(keys)
        one = h & np.uint32(len(self.table) - 1)
        two = self._other(one, fp)
        want = fp[:, None]
        return (self.table[one] == want).any(1) | (self.table[two] == want).any(1)

    def add(self, key: bytes) -> None:
        fp, h = self._parts([key])
        self._place(fp[0], h[0] & np.uint32(len(self.table) - 1))

    def _place(self, fp, bucket) -> None:
        t = self.table
        other = self._other(bucket, fp)
        for b in (bucket, other):
            free = np.flatnonzero(t[b] == 0)
            if len(free):
                t[b, free[0]] = fp
                return
        b = other
        for kick in range(500):
            slot = kick % SLOTS
            fp, t[b, slot] = t[b, slot], fp
            b = self._other(b, fp)
            free = np.flatnonzero(t[b] == 0)
            if len(free):
                t[b, free[0]] = fp
                return
        raise OverflowError("cuckoo filter is full")

    def remove(self, key: bytes) -> bool:
        fp, h = self._parts([key])
        one = h[0] & np.uint32(len(self.table) - 1)
        for b in (one, self._other(one, fp[0])):
            at = np.flatnonzero(self.table[b] == fp[0])
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    @classmethod
    def build(cls, keys: list[bytes]) -> CuckooFilter:
        size = max(64, len(keys))
        while True:
            f = cls(size)
            try:
                for k in keys:
                    f.add(k)
                return f
            except OverflowError:
                size *= 2

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit digest of the stripped, A-Z lower-cased line; None if it is short."""
    line = line.strip(STRIP)
    if len(line) < min_chars:
        return None
    return hashlib.md5(line.encode("utf-8", "surrogatepass").lower(), usedforsecurity=False).digest()


def _keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    return [line_key(x, min_chars) for x in (text or "").split("\n")]


def shard_of(key: bytes, n: int) -> int:
    return int.from_bytes(key[:4], "little") % n


def _shard(n: int):
    """``shard_of`` as a column."""
    reverse = F.concat(*[F.hex(F.substring("key", i, 1)) for i in (4, 3, 2, 1)])
    return (F.conv(reverse, 16, 10).cast("long") % n).cast("int")


class Probe:
    """The filters of all shards on the executor side; without them all keys pass."""

    def __init__(self, parts: list[tuple[int, bytes]] | None, n: int):
        self.n = n
        self.filters = None if parts is None else {s: CuckooFilter.load(d) for s, d in parts}

    def hits(self, keys: list[bytes]) -> list[bytes]:
        if self.filters is None:
            return keys
        by: dict[int, list[bytes]] = {}
        for k in keys:
            by.setdefault(shard_of(k, self.n), []).append(k)
        out = []
        for s, ks in by.items():
            if s in self.filters:
                out += [k for k, hit in zip(ks, self.filters[s].contains(ks)) if hit]
        return out


PAIRS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", T.LongType())])


def line_pairs(docs: DataFrame, min_chars: int, probe=None) -> DataFrame:
    """(key, doc_id), once per row of ``docs`` and key; ``probe`` thins the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = None
        for b in batches:
            if p is None and probe is not None:
                parts, n = probe.value
                p = Probe(parts, n)
            keys: list[bytes] = []
            ids: list = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = list({k for k in _keys_of(text, min_chars) if k is not None})
                keys += own
                ids += [doc_id] * len(own)
            if p is not None:
                good = set(p.hits(list(set(keys))))
                kept = [(k, i) for k, i in zip(keys, ids) if k in good]
                keys, ids = [k for k, _ in kept], [i for _, i in kept]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(returning(run), PAIRS)


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_doc"))


class LineStore:
    """Reference counts and filters of a corpus; insertions and deletions of whole documents."""

    def __init__(self, pairs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_keys: int = 100_000, max_broadcast_bytes: int = 64 << 20, counts: DataFrame | None = None):
        self.min_chars, self.min_docs = min_chars, min_docs
        self.shard_keys, self.max_broadcast_bytes = shard_keys, max_broadcast_bytes
        self.pairs = pairs
        self.counts = materialise(_counted(pairs) if counts is None else counts)
        self._filters = None

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = 20, **options) -> LineStore:
        return cls(line_pairs(docs, min_chars).distinct(), min_chars, **options)

    def _options(self) -> dict:
        return {"min_chars": self.min_chars, "min_docs": self.min_docs, "shard_keys": self.shard_keys, "max_broadcast_bytes": self.max_broadcast_bytes}

    def insert(self, docs: DataFrame) -> LineStore:
        """With the documents of ``docs``; lines that a document is known to hold add nothing."""
        came = line_pairs(docs, self.min_chars).distinct()
        held = self.pairs.select(F.col("key").alias("old_key"), F.col("doc_id").alias("old_doc"))
        new = materialise(came.join(held, (F.col("key") == F.col("old_key")) & F.col("doc_id").eqNullSafe(F.col("old_doc")), "left_anti"))
        more = _counted(new).select("key", F.col("n_docs").alias("more"), F.col("keep_doc").alias("other"))
        counts = self.counts.join(more, "key", "full").select(
            "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("keep_doc", "other").alias("keep_doc")
        )
        return LineStore(materialise(self.pairs.unionByName(new)), counts=counts, **self._options())._carry(self)

    def delete(self, docs: DataFrame) -> LineStore:
        """Without the documents whose ids ``docs`` holds: the state as if they had never come."""
        gone = docs.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        match = F.col("doc_id").eqNullSafe(F.col("gone"))
        left = materialise(self.pairs.join(gone, match, "left_anti"))
        less = _counted(self.pairs.join(gone, match, "left_semi")).select("key", F.col("n_docs").alias("less"), F.col("keep_doc").alias("lost"))
        now = self.counts.join(less, "key", "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("less", F.lit(0))).where("n_docs > 0")
        # The greatest document that goes is the one that kept the line, or it keeps it.
        now = now.withColumn("orphan", F.coalesce(F.col("lost") == F.col("keep_doc"), F.lit(False)))
        orphans = left.join(now.where("orphan").select("key"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("heir"))
        counts = now.join(orphans, "key", "left").select("key", "n_docs", F.when(F.col("orphan"), F.col("heir")).otherwise(F.col("keep_doc")).alias("keep_doc"))
        return LineStore(left, counts=counts, **self._options())._carry(self)

    def _carry(self, old: LineStore) -> LineStore:
        """Take over the filters of ``old``: keys whose count crossed the threshold are
        added or removed in their shard. A filter that overflows has all of them built anew."""
        if old._filters is None:
            return self
        n, parts = old._filters
        was = old.repeated.select("key", F.lit(True).alias("was"))
        now = self.repeated.select("key", F.lit(True).alias("now"))
        changed = was.join(now, "key", "full").where("was is null or now is null").select(_shard(n).alias("shard"), "key", F.col("now").isNotNull().alias("add"))
        room = self.shard_keys

        def update(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if not len(keys):
                return filters
            f = CuckooFilter.load(filters["filter"][0]) if len(filters) else CuckooFilter(room)
            try:
                for k, add in zip(keys["key"], keys["add"]):
                    f.add(k) if add else f.remove(k)
                data = f.dump()
            except OverflowError:
                data = None
            return pd.DataFrame({"shard": [keys["shard"][0]], "filter": [data]})

        new = materialise(parts.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(update, "shard int, filter binary"))
        if new.where("filter is null").isEmpty():
            self._filters = n, new
        return self

    @property
    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def filters(self) -> tuple[int, DataFrame]:
        """Number of shards and (shard, filter): one task holds one shard's keys,
        about ``shard_keys`` of them at any size of corpus."""
        if self._filters is None:
            n = max(1, -(-self.repeated.count() // self.shard_keys))

            def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                by: dict[int, list[bytes]] = {}
                for b in batches:
                    for k in b.column(0).to_pylist():
                        by.setdefault(shard_of(k, n), []).append(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(by), pa.int32()), pa.array([CuckooFilter.build(ks).dump() for ks in by.values()], pa.binary())],
                    names=["shard", "filter"],
                )

            built = self.repeated.select("key", _shard(n).alias("s")).repartition(n, "s").select("key").mapInArrow(returning(build), "shard int, filter binary")
            self._filters = n, materialise(built)
        return self._filters

    def probe(self):
        """Broadcast filters, or None where their measured size passes the bound."""
        n, parts = self.filters()
        total = parts.agg(F.sum(F.length("filter"))).first()[0] or 0
        if total > self.max_broadcast_bytes:
            return None
        rows = [(r["shard"], bytes(r["filter"])) for r in parts.collect()]
        return parts.sparkSession.sparkContext.broadcast((rows, n))

    def _by_shard(self, lines: DataFrame) -> DataFrame:
        """``lines`` (key, doc_id) that their shard's filter holds, without a broadcast: a
        shard's filter goes before the lines dealt to each of its ``SALTS`` tasks."""
        n, parts = self.filters()
        heads = parts.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("filter").alias("key"), F.lit(None).cast("long").alias("doc_id"))
        dealt = lines.select(_shard(n).alias("shard"), F.pmod(F.xxhash64("key", "doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "doc_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for b in batches:
                keys, ids = [], []
                rows = list(zip(*(b.column(i).to_pylist() for i in range(5))))
                at = 0
                while at < len(rows):
                    shard, salt, kind, key, _ = rows[at]
                    if kind == 0:
                        now, held = (shard, salt), CuckooFilter.load(key)
                        at += 1
                        continue
                    end = at
                    while end < len(rows) and rows[end][:3] == (shard, salt, 1):
                        end += 1
                    if (shard, salt) == now:
                        hit = held.contains([r[3] for r in rows[at:end]])
                        keys += [r[3] for r, ok in zip(rows[at:end], hit) if ok]
                        ids += [r[4] for r, ok in zip(rows[at:end], hit) if ok]
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

        width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = heads.unionByName(dealt).repartition(width, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        return both.mapInArrow(returning(run), PAIRS)

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys each document must give up."""
        probe = self.probe()
        lines = line_pairs(docs, self.min_chars, probe)
        if probe is None:
            lines = self._by_shard(lines)
        hit = lines.join(self.repeated.select("key", "keep_doc"), "key").where(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
        return hit.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, store: LineStore | None = None, **options) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, plus n_lines, n_dropped and
    kept_sha256. A key of at least ``min_chars`` code points held by at least
    ``min_docs`` documents stays only in the largest doc_id that holds it."""
    store = store or LineStore.of(docs, min_chars, min_docs=min_docs, **options)
    gone_id, gone_keys = unused(docs, "drop_id"), unused(docs, "drop_keys")
    drops = store.drops(docs).select(F.col("doc_id").alias(gone_id), F.col("keys").alias(gone_keys))
    joined = docs.join(drops, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)), "left").drop(gone_id)
    least = store.min_chars

    def rebuild(b: pa.RecordBatch) -> dict[str, pa.Array]:
        out: dict[str, list] = {"text": [], "n_lines": [], "n_dropped": [], "kept_sha256": []}
        col = lambda n: b.column(b.schema.get_field_index(n)).to_pylist()
        for text, gone in zip(col("text"), col(gone_keys)):
            lines = (text or "").split("\n")
            if gone:
                gone = set(gone)
                kept = [x for x in lines if line_key(x, least) not in gone]
            else:
                kept = lines
            new = "\n".join(kept)
            out["text"].append(new)
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
        kinds = {"text": pa.string(), "n_lines": pa.int64(), "n_dropped": pa.int64(), "kept_sha256": pa.string()}
        return {k: pa.array(v, kinds[k]) for k, v in out.items()}

    fields = [
        T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
    return with_columns_arrow(joined, rebuild, fields, drop=(gone_keys,))


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
keyed as (
  select doc_id, i, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
reps as (
  select key, max(doc_id) as keep_doc from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
marked as (
  select k.doc_id, k.i, k.line, (r.key is not null and r.keep_doc <> k.doc_id) as gone
  from keyed k left join reps r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
