"""CIGAR functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basestream.model import QUERY_OPS, REF_OPS


def parse(cigar: Column) -> Column:
    """``array<struct<len int, op string>>``; ``*`` is empty, an unknown operation is null."""
    good = cigar.rlike(r"^(\*|([0-9]+[MIDNSHP=X])+)$")
    found = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(0))
    split = F.transform(found, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.substring(x, -1, 1).alias("op")))
    return F.when(good, split)


def render(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, F.lit("*")).otherwise(F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))


def _span(ops: Column, letters: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, o: acc + F.when(o["op"].isin(*letters), o["len"]).otherwise(0))


def reference_span(ops: Column) -> Column:
    return _span(ops, REF_OPS)


def query_span(ops: Column) -> Column:
    return _span(ops, QUERY_OPS)


def reg2bin(start: Column, end: Column) -> Column:
    """UCSC bin of the half-open interval; the smallest of five levels that holds it."""
    last = end - 1
    out = F.lit(0)
    for level in range(1, 6):  # from 2**26 down to 2**14 bases a bin
        shift = 29 - 3 * level
        offset = ((1 << 3 * level) - 1) // 7
        out = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.lit(offset) + F.shiftright(start, shift)).otherwise(out)
    return out.cast("long")
