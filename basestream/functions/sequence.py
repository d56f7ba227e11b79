"""Base and quality functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quality bins as (first quality of the bin, value of the bin).
BINS = ((0, 0), (1, 1), (2, 6), (10, 15), (20, 22), (25, 27), (30, 33), (35, 37), (40, 40))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def bin_quality(q: Column) -> Column:
    out = F.lit(0)
    for first, value in BINS[1:]:
        out = F.when(q >= first, value).otherwise(out)
    return out


def logodds_phred(score: Column) -> Column:
    """Phred+33 character of a log-odds score; negative scores count as 0."""
    s = F.greatest(score, F.lit(0))
    q = F.floor(10 * F.log10(1 + F.pow(F.lit(10.0), s / 10.0)) + 0.499)
    return F.chr((33 + q).cast("int"))


def quality_char(q: Column) -> Column:
    return F.chr((F.least(q, F.lit(93)) + 33).cast("int"))


def composition(seq: Column) -> dict[str, Column]:
    """Counts of A, C, G, T in either case, of other bases, and of all."""
    n = F.length(seq)
    counts = {b: n - F.length(F.replace(F.replace(seq, F.lit(b), F.lit("")), F.lit(b.lower()), F.lit(""))) for b in "ACGT"}
    return {**counts, "N": n - sum(counts.values(), F.lit(0)), "total": n}


def wrap(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fastq(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), F.translate(seq, ".", "N"), F.lit("\n+\n"), qual)


def fasta(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.translate(seq, "-", "N"))


def clip(seq: Column, left: Column, right: Column) -> Column:
    """Bases strictly between the cutoffs (1-based, right exclusive)."""
    return F.substring(seq, left + 1, F.greatest(right - left - 1, F.lit(0)))


def cutoffs(ql: Column, sl: Column, qr: Column, sr: Column) -> tuple[Column, Column]:
    left = F.greatest(ql, sl)
    return left, F.greatest(F.least(qr, sr), left + 1)


def flow_clip(n: Column, quality_left: Column, adapter_left: Column, quality_right: Column, adapter_right: Column) -> tuple[Column, Column]:
    """Greatest of the lefts; least of the rights that are set, else one past the end."""
    end = lambda c: F.when(c == 0, n + 1).otherwise(c)
    return F.greatest(quality_left, adapter_left), F.least(end(quality_right), end(adapter_right))


def name_matches(name: Column, exact: list[str], prefixes: list[str]) -> Column:
    hit = name.isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        hit = hit | name.startswith(p)
    return hit
