"""Schemas and constants of alignment and trace records."""

from __future__ import annotations

from pyspark.sql import types as T

#: Flag bits of an alignment record.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 1, 2, 4, 8
REVERSE, MATE_REVERSE, READ1, READ2 = 16, 32, 64, 128
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048

#: Operations of a CIGAR that use up reference bases, and query bases.
REF_OPS, QUERY_OPS = "MDN=X", "MIS=X"

TAG_VALUE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("ai", T.ArrayType(T.LongType())),
        T.StructField("af", T.ArrayType(T.DoubleType())),
    ]
)

ALIGNMENTS = T.StructType(
    [
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("ref_id", T.IntegerType()),
        T.StructField("rname", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("mate_ref_id", T.IntegerType()),
        T.StructField("rnext", T.StringType()),
        T.StructField("pnext", T.LongType()),
        T.StructField("tlen", T.LongType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("file_ord", T.LongType()),
    ]
)

_INTS = T.ArrayType(T.IntegerType())
TRACES = T.StructType(
    [
        T.StructField("trace_name", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("npoints", T.IntegerType()),
        T.StructField("nbases", T.IntegerType()),
        *[T.StructField(c, _INTS) for c in ("trace_a", "trace_c", "trace_g", "trace_t")],
        T.StructField("max_trace", T.IntegerType()),
        T.StructField("baseline", T.IntegerType()),
        T.StructField("base", T.StringType()),
        T.StructField("base_pos", _INTS),
        T.StructField("left_cutoff", T.IntegerType()),
        T.StructField("right_cutoff", T.IntegerType()),
        T.StructField("info", T.MapType(T.StringType(), T.StringType())),
        *[T.StructField(c, _INTS) for c in ("prob_a", "prob_c", "prob_g", "prob_t")],
        T.StructField("flow_order", T.StringType()),
        T.StructField("flow", T.ArrayType(T.FloatType())),
        T.StructField("flow_raw", T.ArrayType(T.LongType())),
    ]
)
