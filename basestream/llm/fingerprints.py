"""Document fingerprints: bottom-k sketches of word shingles, in built-in functions only.

A text's shingles are its runs of ``n`` lower-cased words (a shorter text is one
shingle); the sketch keeps the ``k`` least of their distinct 64-bit hashes, sorted.
Sketches merge: the k least of two sketches' union are the sketch of the union, so
parts can be sketched apart. From sketches follow resemblance (exact while the union
has at most k shingles), containment and the number of distinct shingles.

Defined cases: null is the empty text, whose sketch is empty; two empty sketches
resemble each other by 1, an empty and another one by 0; equal texts have equal
sketches; texts of any length are sketched whole; rows that repeat an id stand next to
each other in the order of documents, rows without an id come last (in one range of
their own); other columns than doc_id and text don't matter; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sketch(text: Column, n: int = WORDS, k: int = K) -> Column:
    clean = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        last = F.size(h) - n
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(last < 0, whole).otherwise(runs)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.slice(F.sort_array(F.array_distinct(shingles(h))), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_count(a: Column, k: int = K) -> Column:
    """Exact below k shingles; else (k - 1) over the k-th least hash's place in hash space."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, from resemblance and the counts."""
    r = resemblance(a, b, k)
    share = r * (distinct_count(a, k) + distinct_count(b, k)) / ((1 + r) * distinct_count(a, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merge_groups(sketches: DataFrame, key: str, value: str, k: int = K, salts: int = 64) -> DataFrame:
    """(key, value): one sketch per key. Hot keys are cut into salted parts first, and
    each part keeps k hashes, so no task holds more than its share of a key."""
    h = sketches.select(key, F.explode(value).alias("h")).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts))).distinct()
    part = Window.partitionBy(key, "salt").orderBy("h")
    whole = Window.partitionBy(key).orderBy("h")
    least = h.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(value))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _bucket(value: Column, bounds: list[int], low: int = 0) -> Column:
    """Number of descending ``bounds`` above the value, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), _bucket(value, bounds[mid + 1 :], low + mid + 1)).otherwise(_bucket(value, bounds[:mid], low))


#: Literal cuts of the ids' range, and range ends that are broadcast, at most.
MOST_CUTS, LIGHT_ENDS = 256, 200_000


def _ranges(ids: DataFrame, rows: int, bucket_rows: int) -> Column:
    """A number for each doc_id that grows as the id falls, for ranges of about
    ``bucket_rows`` documents at any size: quantiles cut the ids at most ``MOST_CUTS`` times,
    and every such piece is cut evenly. Rows without an id are the last range."""
    n = max(1, rows // bucket_rows)
    coarse = min(MOST_CUTS, n)
    fine = -(-n // coarse)
    known = ids.where("doc_id is not null")
    ends = known.agg(F.min("doc_id"), F.max("doc_id")).first()
    if ends[0] is None:
        return F.lit(0).cast("long")
    cuts = sorted({int(q) for q in known.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], 0.1 / coarse)}, reverse=True) if coarse > 1 else []
    piece = _bucket(F.col("doc_id"), cuts)
    if fine == 1:
        return F.coalesce(piece.cast("long"), F.lit(len(cuts) + 1).cast("long"))
    top = F.element_at(F.array(*[F.lit(float(x)) for x in [ends[1] + 1, *cuts]]), piece + 1)
    low = F.element_at(F.array(*[F.lit(float(x)) for x in [*cuts, ends[0]]]), piece + 1)
    part = F.floor((top - F.col("doc_id")) / F.greatest(top - low, F.lit(1.0)) * fine)
    return F.coalesce(piece.cast("long") * fine + F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1)), F.lit((len(cuts) + 1) * fine).cast("long"))


def with_next(docs: DataFrame, bucket_rows: int = 4000) -> DataFrame:
    """``docs`` (doc_id, text, sketch) with next_text and next_sketch, those of the next
    document in descending doc_id; after the last comes the first. The texts are
    shuffled once: ids fall into ranges of about equal size, whose number follows the
    input, and each range is closed by a copy of the document that follows it."""
    ids = docs.select("doc_id")
    rows = ids.count()
    bucket = _ranges(ids, rows, bucket_rows)
    # One row a range: its first document, and the first one of the next range.
    firsts = ids.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("own"))
    line = Window.orderBy("b")
    closing = firsts.select("b", F.lead("own").over(line).alias("first"), F.lead("b").over(line).isNull().alias("last"), F.first("own").over(line).alias("top"))
    closing = closing.select("b", F.when(F.col("last"), F.col("top")).otherwise(F.col("first")).alias("first"))
    small = (lambda df: F.broadcast(df)) if rows // bucket_rows <= LIGHT_ENDS else (lambda df: df)
    tie = F.xxhash64("text")
    # One document a range (of equal ids, the first in order).
    ends = docs.join(small(closing.select(F.col("first").alias("f")).distinct()), F.col("doc_id").eqNullSafe(F.col("f")), "left_semi")
    ends = ends.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(tie))).where("r = 1").drop("r")
    copies = ends.join(small(closing), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "b", F.lit(True).alias("closing"))
    every = docs.select("doc_id", "text", bucket.alias("b"), F.lit(False).alias("closing")).unionByName(copies)
    sketched = every.withColumn("sketch", sketch(F.col("text"))).withColumn("tie", tie)
    order = Window.partitionBy("b").orderBy(F.col("closing"), F.col("doc_id").desc_nulls_last(), F.col("tie"))
    return (
        sketched.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("closing")).drop("b", "closing", "tie")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last third replaced by as
    much of the beginning of the next document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(plain)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch")
    )


def report(found: DataFrame) -> DataFrame:
    a, e, b = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        resemblance(a, e).alias("near_edited"), resemblance(a, b).alias("near_next"),
        distinct_count(a).alias("distinct_shingles"), containment(e, a).alias("edited_contained"),
    )
