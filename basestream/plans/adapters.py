"""Views of the driver's tables as alignment, sequence, flow and header tables, in
DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.functions.sequence import quality_char
from basestream.operators.ordering import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag():
    bit = lambda c, v: F.when(c, v).otherwise(0)
    c = F.col
    return (
        bit(c("l_linestatus") == "O", 1) + bit(c("l_returnflag") == "A", 2) + bit(c("l_partkey") % 11 == 0, 4) + bit(c("l_partkey") % 13 == 0, 8)
        + bit(c("l_suppkey") % 2 == 0, 16) + F.when(c("l_linenumber") == 1, 64).otherwise(128)
        + bit((c("l_returnflag") == "R") & (c("l_linenumber") > 5), 512) + bit(c("l_tax") > 0.07, 1024)
    ).cast("int")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records without a file order."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("qname"), (c("l_suppkey") % 4).cast("int").alias("ref_id"),
        c("l_partkey").cast("bigint").alias("pos"), F.round("l_quantity").cast("int").alias("mapq"), (10 + c("l_linenumber") * 5).cast("int").alias("span"),
        _flag().alias("flag"), ((c("l_suppkey") + c("l_linenumber")) % 4).cast("int").alias("mate_ref_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
    )


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def alignments(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return number_rows(records(spark, sf_dir), [F.col(k) for k in KEY], keep=list(keep) or None)


def with_reads(aln: DataFrame) -> DataFrame:
    """Made-up reads: full matches whose base at pos is the (pos mod 4)th of ACGT, all of quality mapq."""
    shift, span = (F.col("pos") % 4).cast("int"), F.col("span")
    seq = F.substring(F.repeat(F.lit("ACGT"), (span / 4).cast("int") + 2), shift + 1, span)
    return aln.withColumns({"cigar": F.concat(span.cast("string"), F.lit("M")), "seq": seq, "qual": F.repeat(quality_char(F.col("mapq")), span)})


ALN = """
aln as (
  select 'o'||l_orderkey as qname, cast(l_suppkey % 4 as int) as ref_id, cast(l_partkey as bigint) as pos,
         cast(round(l_quantity) as int) as mapq, cast(10 + l_linenumber * 5 as int) as span,
         cast((case when l_linestatus = 'O' then 1 else 0 end) + (case when l_returnflag = 'A' then 2 else 0 end)
            + (case when l_partkey % 11 = 0 then 4 else 0 end) + (case when l_partkey % 13 = 0 then 8 else 0 end)
            + (case when l_suppkey % 2 = 0 then 16 else 0 end) + (case when l_linenumber = 1 then 64 else 128 end)
            + (case when l_returnflag = 'R' and l_linenumber > 5 then 512 else 0 end)
            + (case when l_tax > 0.07 then 1024 else 0 end) as int) as flag,
         cast((l_suppkey + l_linenumber) % 4 as int) as mate_ref_id,
         row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as file_ord,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus
  from lineitem)
"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts reduced to the letters ACGTN."""
    upper = F.coalesce("text", F.lit(""))
    for b in "ACGT":  # a byte search each, far cheaper than a character map
        upper = F.replace(upper, F.lit(b.lower()), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(upper, "[^ACGT]", "N").alias("seq"))


SEQS = "seqs as (select doc_id, regexp_replace(translate(coalesce(text,''),'acgt','ACGT'),'[^ACGT]','N','g') as seq from documents)"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))


FLOWS = "flows as (select user_id, ts, event_id, event_type, cast(round(value * 100) as bigint) as v from events)"


def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("int").alias("id"), F.col("n_name").alias("name"), (1000 + n * 10).cast("long").alias("len"))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of programs: each nation follows the one five before it."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), F.lpad(n.cast("string"), 3, "0")).alias("id"),
        F.when(n >= 5, F.concat(F.lit("p"), F.lpad((n - 5).cast("string"), 3, "0"))).alias("prev_id"),
    )


PROGRAMS = """
programs as (select 'p'||lpad(cast(n_nationkey as varchar), 3, '0') as id,
  case when n_nationkey >= 5 then 'p'||lpad(cast(n_nationkey - 5 as varchar), 3, '0') end as prev_id from nation)
"""
