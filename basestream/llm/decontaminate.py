"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the word sequences of all test items. A document's
words stream through it; the longest match ending at each word tells which
windows (``window`` consecutive item words, or a whole shorter item) occur.

The test set is read in blocks of at most ``block_words`` words (a longer item is a
block of its own), each block one automaton of at most two states a word, so what is
broadcast never grows with the corpus, nor past the bound with the test set: more items
mean more blocks, each a pass over all documents that merges its hits with those
found before, written to the shared folder in between.

Defined cases: null and empty texts have no words; items without words are
never found; repeated items each count under their own id; rows of ``docs`` are
judged one by one, so repeated or null ids keep their rows; texts of any length are
streamed whole; an empty test set marks nothing; no rows give no rows. Of columns named
like an output, ``scan_documents`` replaces them and ``remove_spans`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basestream.llm.common import beside, materialise, with_columns_arrow

#: Bytes of a word after A-Z are lower-cased: 0-9, a-z and all of non-ASCII.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class SuffixAutomaton:
    """Generalised over several word sequences; ids are dense vocabulary numbers."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        found_at: list[set[int]] = [set()]
        self.items = [i for i, _ in items]
        shorts: list[tuple[int, int, int]] = []
        for n, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
            del last
        while len(found_at) < len(self.link):
            found_at.append(set())
        for n, (_, words) in enumerate(items):
            state = 0
            for at, w in enumerate(words):
                state = self.next[state][self.vocab[w]]
                if len(words) < window:
                    continue
                if at + 1 >= window:
                    found_at[self._cut(state, window)].add(n)
            if 0 < len(words) < window:
                shorts.append((self._cut(state, len(words)), len(words), n))
        self.found = [tuple(sorted(s)) for s in found_at]
        # Whole short items on each state's chain of suffixes: (length, item).
        own: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for state, size, n in shorts:
            own[state].append((size, n))
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            up = self.short[self.link[s]] if s else ()
            self.short[s] = up + tuple(own[s])
        self.least = min([window, *(size for _, size, _ in shorts)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _cut(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word intervals [from, to) and the numbers of the items found."""
        ids = list(map(self.vocab.get, words))
        least, window, n = self.least, self.window, len(ids)
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        nxt, link, length, short = self.next, self.link, self.length, self.short
        at = 0
        while at < n:
            if ids[at] is None:
                at += 1
                continue
            # A window lies inside a run of known words; test the far end first.
            far = at + least - 1
            if far >= n:
                break
            back = far
            while back > at and ids[back] is not None:
                back -= 1
            if ids[back] is None:
                at = back + 1
                continue
            state = size = 0
            while at < n and (c := ids[at]) is not None:
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    size += 1
                at += 1
                if size >= least:
                    if size >= window:
                        found = self.found[self._cut(state, window)]
                        if found:
                            items.update(found)
                            self._mark(hits, at - window, at)
                    for k, item in short[state]:
                        if k <= size:
                            items.add(item)
                            self._mark(hits, at - k, at)
        return hits, items

    @staticmethod
    def _mark(hits: list[tuple[int, int]], start: int, end: int) -> None:
        while hits and hits[-1][1] >= start:
            start = min(start, hits[-1][0])
            end = max(end, hits[-1][1])
            hits.pop()
        hits.append((start, end))


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[tuple[object, list[bytes]]], bool]]:
    """Items in blocks of at most ``block_words`` words, or of one longer item, and
    whether the block is the last."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if size + len(words) > block_words and block:
            yield block, False
            block, size = [], 0
        block.append((r["item_id"], words))
        size += len(words)
    if block:
        yield block, True


ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def without(text: str, spans: list) -> str:
    """``text`` without the word intervals, each cut from its first word to its last."""
    at = [m.span() for m in WORD.finditer(text)]
    parts, last = [], 0
    for a, z in spans:
        parts.append(text[last : at[a][0]])
        last = at[z - 1][1]
    return "".join([*parts, text[last:]])


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 250_000, cut: bool = False) -> DataFrame:
    """``docs`` plus n_words, hit_spans (word intervals [from, to)) and hit_items (sorted);
    with ``cut``, ``text`` loses the spans. An automaton of ``block_words`` words takes
    some 180 MB; one block needs one pass, and of more blocks a pass holds one."""

    def once(df: DataFrame, shared, first: bool, last: bool) -> DataFrame:
        def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
            col = lambda n: b.column(b.schema.get_field_index(n)).to_pylist()
            auto = shared.value if shared is not None else None
            old = None if first else list(zip(col("hit_spans"), col("hit_items")))
            n_words, spans, items, rest = [], [], [], []
            for i, text in enumerate(col("text")):
                words = words_of(text)
                hits, found = auto.scan(words) if auto is not None and words else ([], set())
                names = {str(auto.items[n]) for n in found}
                if old is not None and (old[i][0] or old[i][1]):
                    hits = merge([*map(tuple, old[i][0]), *hits])
                    names |= set(old[i][1])
                n_words.append(len(words))
                spans.append([list(h) for h in hits])
                items.append(sorted(names))
                if cut and last:
                    rest.append(without(text, hits) if hits else text)
            done = {
                "n_words": pa.array(n_words, pa.int64()),
                "hit_spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "hit_items": pa.array(items, pa.list_(pa.string())),
            }
            return done | ({"text": pa.array(rest, pa.string())} if cut and last else {})

        return with_columns_arrow(df, run, ADDED + [T.StructField("text", T.StringType())] * (cut and last))

    out, first = docs, True
    for block, last in blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))
        out = once(out, shared, first, last)
        if not last:
            out = materialise(out)
            shared.unpersist()
        first = False
    return once(docs, None, True, True) if first else out


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0]), F.lit(0)).cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = 250_000) -> DataFrame:
    """``docs`` without contaminated spans. A document whose hit words pass
    ``max_coverage`` of its words goes; in the others every hit span is cut out,
    from its first word to its last. Documents without a hit stay as they are."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])

    def clean(df: DataFrame) -> DataFrame:
        return scan_documents(df, benchmark, window, block_words, cut=True).where(hit <= F.col("n_words") * max_coverage)

    done = beside(docs, clean, [f.name for f in ADDED])
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return done


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
b as (select item_id, w, least(len(w), 10) as k from bw where len(w) > 0),
bi as (select item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from b),
win as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from bi),
ks as (select distinct k from b),
di as (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from dw, ks where len(w) >= k),
dg as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from di),
hit as (select dg.doc_id, dg.i, dg.k, win.item_id from dg join win on dg.g = win.g and dg.k = win.k),
pos as (select doc_id, unnest(generate_series(i, i + k - 1)) as p from (select distinct doc_id, i, k from hit)),
nh as (select doc_id, count(distinct p) as n_hit from pos group by doc_id),
ni as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names
       from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join nh using (doc_id) left join ni using (doc_id)
"""
