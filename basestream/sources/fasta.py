"""Reference sequences: FASTA text, its index, and lookup by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.functions.names import cache_path


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, bases) of every record; Spark splits the text at ``>``, so
    records of one file are read by several tasks."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s+", "")).otherwise("")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_replace(head, r"^\S*\s*", "").alias("description"), body.alias("bases"))


INDEX = "name string, length long, offset long, line_bases int, line_bytes int"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index file: name, length, offset of the first base, bases and bytes of a line."""
    return spark.read.option("sep", "\t").schema(INDEX).csv(path)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of one file; offsets are running sums over its records, whose order is that
    of their byte offsets."""
    from basestream.operators.lookups import archive_index
    from basestream.operators.ordering import number_rows

    rows = spark.read.option("lineSep", ">").text(path).select(F.col("value"), F.monotonically_increasing_id().alias("at"))
    numbered = number_rows(rows, [F.col("at")], "n")
    placed = archive_index(numbered, F.octet_length("value") + 1, "n")
    line = F.expr("split_part(value, '\n', 2)")
    head = F.octet_length(F.substring_index("value", "\n", 1)) + 1
    return placed.where(F.trim("value") != "").orderBy("n").select(
        F.regexp_extract("value", r"^(\S*)", 1).alias("name"),
        F.length(F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s+", "")).cast("long").alias("length"),
        (F.col("position") + head).alias("offset"), F.octet_length(F.rtrim(line)).cast("int").alias("line_bases"), (F.octet_length(line) + 1).cast("int").alias("line_bytes"),
    )


def portion(reference: DataFrame, name: str, start: int = 1, end: int = 0) -> DataFrame:
    """Bases [start, end] of a reference, 1-based; an end of 0 is its last base."""
    last = F.length("bases") if end == 0 else F.least(F.lit(end), F.length("bases"))
    return reference.where(F.col("name") == name).select("name", F.substring("bases", F.lit(start), F.greatest(last - (start - 1), F.lit(0))).alias("bases"))


def with_digests(reference: DataFrame) -> DataFrame:
    """``reference`` with md5, the digest of its bases in upper case."""
    return reference.withColumn("md5", F.md5(F.upper("bases").cast("binary")))


def by_digest(spark: SparkSession, digests: DataFrame, folders: list[str]) -> DataFrame:
    """(md5, bases): each digest's bases from the first folder that has them; folders may hold
    %s and %Ns, parts of the digest. The digests of a header bound their number."""
    out = None
    for rank, folder in enumerate(folders):
        for r in digests.select("md5").distinct().collect():
            place = cache_path(folder, r["md5"])
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                one = spark.read.text(place, wholetext=True).select(F.lit(r["md5"]).alias("md5"), F.lit(rank).alias("rank"), F.regexp_replace("value", r"\s+", "").alias("bases"))
                out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "md5 string, bases string")
    return out.groupBy("md5").agg(F.min_by("bases", "rank").alias("bases"))
