"""Alignment text: reader and writer in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.operators.lookups import header_lines


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records of text lines (column value; header lines are skipped). Positions become
    0-based, ``=`` becomes the record's own reference, ``*`` becomes null."""
    f = F.split("value", "\t")
    some = lambda k: F.when(F.get(f, F.lit(k)) != "*", F.get(f, F.lit(k)))
    rec = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    keep = [c for c in lines.columns if c != "value"]
    return rec.select(
        *keep, F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").bitwiseAND(0x7FFF).alias("flag"), some(2).alias("rname"),
        (F.get(f, F.lit(3)).cast("long") - 1).alias("pos"), F.get(f, F.lit(4)).cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"),
        F.when(F.get(f, F.lit(6)) == "=", some(2)).otherwise(some(6)).alias("rnext"), (F.get(f, F.lit(7)).cast("long") - 1).alias("pnext"),
        F.get(f, F.lit(8)).cast("long").alias("tlen"), F.regexp_replace(F.upper(some(9)), "[^=ACMGRSVTWYHKDBN]", "N").alias("seq"), some(10).alias("qual"),
        F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"),
    )


def render_line(df: DataFrame) -> Column:
    """One text line of a record with the columns of ``parse_lines``."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    mate = F.when(F.col("rnext").isNull(), "*").when(F.col("rnext") == F.col("rname"), "=").otherwise(F.col("rnext"))
    core = [s("qname"), s("flag"), s("rname"), (F.col("pos") + 1).cast("string"), s("mapq"), s("cigar"), mate, (F.col("pnext") + 1).cast("string"), s("tlen"), s("seq"), s("qual")]
    return F.concat_ws("\t", *core, F.col("tags"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header lines, records) of a text file; file order is the byte order of splits."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return header_lines(lines), parse_lines(lines.withColumnRenamed("line_no", "file_ord"))


def write(header: DataFrame, records: DataFrame, path: str) -> None:
    """Text parts in file order, the header first."""
    head = header.select(F.lit(0).alias("part"), F.col("line_no").alias("at"), "value")
    body = records.select(F.lit(1).alias("part"), F.col("file_ord").alias("at"), render_line(records).alias("value"))
    head.unionByName(body).orderBy("part", "at").select("value").write.text(path)
