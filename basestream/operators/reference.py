"""Reads against reference bases: NM, MD, substitution, consensus of slices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basestream.functions import cigar


def chunk_reference(reference: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(name, chunk, bases): a reference sequence in pieces that join by number."""
    n = F.ceil(F.length("bases") / size).cast("int")
    parts = reference.select("name", "bases", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("chunk"))
    return parts.select("name", "chunk", F.substring("bases", F.col("chunk") * size + 1, F.lit(size)).alias("bases"))


def _edit(ops, seq: str, ref: str) -> tuple[int, str]:
    """NM and MD of one read. ``ref`` begins at the read's first reference base."""
    r = q = run = nm = 0
    out: list[str] = []
    for o in ops:
        n, op = o["len"], o["op"]
        if op in "M=X":
            for a, b in zip(seq[q : q + n].upper(), ref[r : r + n].upper().ljust(n, "N")):
                if a == b:
                    run += 1
                else:
                    out.append(f"{run}{b}")
                    run, nm = 0, nm + 1
            r, q = r + n, q + n
        elif op == "D":
            out.append(f"{run}^{ref[r : r + n].upper()}")
            run, r, nm = 0, r + n, nm + n
        elif op == "I":
            q, nm = q + n, nm + n
        elif op == "S":
            q += n
        elif op == "N":
            r += n
    return nm, "".join(out) + str(run)


def with_md_nm(aln: DataFrame, reference: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``aln`` with nm and md. Reads meet the chunks they overlap by an equi-join on
    (reference, chunk); Arrow batches compute the strings. Reads without a known reference
    or without bases stay, with nulls."""
    ops = cigar.parse(F.col("cigar"))
    placed = aln.withColumn("ops", ops).withColumn("rspan", cigar.reference_span(F.col("ops")))
    last = F.greatest(F.col("pos"), F.col("pos") + F.col("rspan") - 1)
    spread = placed.select("*", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor(last / size))).alias("chunk"))
    joined = spread.join(chunk_reference(reference, size).withColumnRenamed("name", "rname"), ["rname", "chunk"], "inner")
    bases = joined.groupBy("file_ord").agg(F.array_sort(F.collect_list(F.struct("chunk", "bases"))).alias("c"))
    whole = placed.join(bases, "file_ord", "left").withColumn("ref", F.expr(f"substring(array_join(transform(c, x -> x.bases), ''), int(pos - c[0].chunk * {size}) + 1, int(rspan))"))

    @F.pandas_udf("nm long, md string")
    def edit(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for o, s, r in batches:
            told = [(None, None) if any(v is None for v in x) or x[1] == "*" else _edit(*x) for x in zip(o, s, r)]
            yield pd.DataFrame({"nm": pd.array([t[0] for t in told], "Int64"), "md": [t[1] for t in told]})

    return whole.withColumn("e", edit("ops", "seq", "ref")).select(*aln.columns, "e.nm", "e.md")
