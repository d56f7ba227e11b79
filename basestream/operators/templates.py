"""Records of one template: mate pairing inside slices, mate fields along the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basestream.model import MATE_REVERSE, MATE_UNMAPPED, PAIRED, READ1, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED


def _bit(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def pair_mates(aln: DataFrame) -> DataFrame:
    """``aln`` (slice_id, file_ord, qname, flag, ref_id, pos, span, mate_pos, tlen) with
    mate_line, the records to the one before of its template in the slice (primary and
    secondary records pair among themselves), and attached: whether all that the two say of
    each other can be told from them - positions, strands, mapping and template length -
    so that neither needs to store it. State is bounded by a slice."""
    w = Window.partitionBy("slice_id", F.col("flag").bitwiseAND(SECONDARY), "qname").orderBy("file_ord")
    fields = ["file_ord", "flag", "ref_id", "pos", "span", "mate_pos", "tlen"]
    seen = aln.withColumn("_p", F.lag(F.struct(*fields)).over(w))
    p, flag = F.col("_p"), F.col("flag")
    low = F.least(F.col("pos"), p["pos"])
    size = F.greatest(F.col("pos") + F.col("span"), p["pos"] + p["span"]) - low
    first = (F.col("pos") < p["pos"]) | ((F.col("pos") == p["pos"]) & _bit(flag, READ1))
    sign = F.when(first, 1).otherwise(-1)
    agree = (
        _bit(flag, PAIRED) & _bit(p["flag"], PAIRED) & (F.col("ref_id") == p["ref_id"]) & (F.col("mate_pos") == p["pos"]) & (p["mate_pos"] == F.col("pos"))
        & (_bit(flag, MATE_UNMAPPED) == _bit(p["flag"], UNMAPPED)) & (_bit(p["flag"], MATE_UNMAPPED) == _bit(flag, UNMAPPED))
        & (_bit(flag, MATE_REVERSE) == _bit(p["flag"], REVERSE)) & (_bit(p["flag"], MATE_REVERSE) == _bit(flag, REVERSE))
        & ~_bit(flag, SUPPLEMENTARY) & ~_bit(p["flag"], SUPPLEMENTARY) & (F.col("tlen") == sign * size) & (p["tlen"] == -sign * size)
    )
    return seen.select(*aln.columns, (F.col("file_ord") - p["file_ord"]).alias("mate_line"), F.coalesce(agree, F.lit(False)).alias("attached"))


def mate_fields(aln: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``aln`` with mate_ref_id, mate_pos and the mate bits of flag from the next record
    of its template, the first one following the last; a template of one record has none."""
    by = [*(scope or []), "qname"]
    w = Window.partitionBy(*by).orderBy("file_ord")
    own = F.struct("flag", "ref_id", "pos", "file_ord")
    told = aln.withColumn("_n", F.coalesce(F.lead(own).over(w), F.first(own).over(w)))
    n, alone = F.col("_n"), F.col("_n")["file_ord"] == F.col("file_ord")
    mate = F.when(_bit(n["flag"], REVERSE), MATE_REVERSE).otherwise(0) + F.when(_bit(n["flag"], UNMAPPED), MATE_UNMAPPED).otherwise(0)
    flag = F.col("flag").bitwiseAND(~(MATE_REVERSE | MATE_UNMAPPED)) + F.when(alone, 0).otherwise(mate)
    made = {"mate_ref_id": F.when(alone, -1).otherwise(n["ref_id"]), "mate_pos": F.when(alone, F.lit(-1)).otherwise(n["pos"]), "flag": flag}
    return told.select(*[c for c in aln.columns if c not in made], *[v.alias(k) for k, v in made.items()])
