"""Finding inputs: lists of files, and names looked up along a search path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.sources.archives import tar_index

#: Endings tried after a name as given.
SUFFIXES = ("", ".gz", ".bz2", ".Z", ".z", ".sz")


def file_list(spark: SparkSession, path: str) -> list[str]:
    """Paths in a list file, one a line; a list's length is the user's own bound."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return [r["value"].strip() for r in lines.collect()]


def locate(spark: SparkSession, names: DataFrame, path: str) -> DataFrame:
    """(name, place, found, position, size): each name's first place along a path of
    elements joined by ``:`` - folders or TAR=files. A leading ``|`` on an element
    tries the name only as given."""
    places = None
    for rank, element in enumerate(path.split(":")):
        exact, element = element.startswith("|"), element.removeprefix("|")
        if element.startswith("TAR="):
            there = tar_index(spark, element[4:]).select(F.col("name").alias("found"), F.col("archive").alias("place"), "position", "size")
        else:
            files = spark.read.format("binaryFile").load(element).select("path", F.col("length").alias("size"))
            there = files.select(F.element_at(F.split("path", "/"), -1).alias("found"), F.col("path").alias("place"), F.lit(0).cast("long").alias("position"), "size")
        endings = F.array(*[F.lit(s) for s in (SUFFIXES[:1] if exact else SUFFIXES)])
        part = there.withColumn("rank", F.lit(rank)).withColumn("endings", endings)
        places = part if places is None else places.unionByName(part)
    tried = names.select("name", F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("order", "ending")).withColumn("found", F.concat("name", "ending"))
    hits = tried.join(places, "found").where(F.array_contains("endings", F.col("ending")))
    first = hits.groupBy("name").agg(F.min_by(F.struct("place", "found", "position", "size"), F.struct("rank", "order")).alias("h"))
    return names.join(first, "name", "left").select("name", "h.*")
