"""Opening alignment files by what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.functions.names import format_by_magic, format_by_name


def detect(spark: SparkSession, path: str) -> str:
    """The format of a file's first bytes, read through Spark's file systems."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = files.getFileSystem(spark._jsc.hadoopConfiguration()).open(files)
    try:
        head = bytes(b for b in (stream.read() for _ in range(64)) if b >= 0)
    finally:
        stream.close()
    return format_by_magic(head)


def open_alignments(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of one file, whatever its format; the ending doesn't matter."""
    from basestream.sources import bam, sam

    kind = detect(spark, path)
    if kind == "bam":
        bam.register(spark)
        return spark.read.format("bam").options(**options).load(path)
    if kind in ("sam", "gz"):
        return sam.read(spark, path)[1]
    raise ValueError(f"{path}: records of {kind} files are not read (their blocks and index are, in sources.archives)")


def read_groups_of(header: DataFrame) -> DataFrame:
    """(id, name) of the read groups of a header table, numbered in the order of its lines."""
    groups = header.where("type = 'RG'").select("line_no", F.element_at("tags", "ID").alias("name"))
    before = groups.select(F.col("line_no").alias("other"))
    return groups.join(F.broadcast(before), F.col("other") < F.col("line_no"), "left").groupBy("line_no", "name").agg(F.count("other").alias("id")).select("id", "name")


def write_name(path: str, given: str | None = None) -> str:
    """The format to write: the one given, else by the ending, else text."""
    return given or format_by_name(path) or "sam"
