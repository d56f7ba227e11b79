"""Row numbers over a whole table without a single-partition window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of ``spark.checkpoint.dir``; a
    temporary folder only where that is unset."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basestream-ckpt-"))
    return df.checkpoint(eager=True)


def parts_for(df: DataFrame, mb: int = 8, most: int = 10_000) -> int:
    """As many partitions as the input of ``df`` needs: the session's number, and one for
    each ``mb`` MB of its sources at least, so that a task's share doesn't grow with them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a source of unknown size claims the largest number
    return max(n, min(most, -(-known // (mb << 20))))


def number_rows(df: DataFrame, order: list[Column], name: str = "file_ord", first: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Rows numbered in ``order``: range partitions, as many as the input needs, are
    sorted, and each one's start is the sum of the sizes before it. Only one count per
    partition reaches the driver. ``keep``: the columns that are wanted, if not all."""
    placed = df.repartitionByRange(parts_for(df), *order).sortWithinPartitions(*order)
    if keep is not None:
        placed = placed.select(*keep)
    marked = checkpointed(placed.withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted((r["p"], r["n"]) for r in marked.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    start, total = [first] * (sizes[-1][0] + 1 if sizes else 1), first
    for p, size in sizes:
        start[p], total = total, total + size
    # An array is read at its index; a map would be searched for each row.
    offset = F.array(*[F.lit(x).cast("long") for x in start])
    return marked.withColumn(name, (F.get(offset, F.shiftright("_at", 33).cast("int")) + F.col("_at").bitwiseAND(_LOW)).cast("long")).drop("_at")
