"""Column statistics, block statistics and archive counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("content_id").agg(F.sum("comp_size").alias("bytes"), F.count(F.lit(1)).alias("blocks"))


def block_methods(blocks: DataFrame) -> DataFrame:
    """Use of each method per content id; marks from a tenth and from a half of its blocks."""
    counts = blocks.groupBy("content_id", "method").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("content_id"))
    return counts.select("content_id", "method", "n", F.round(share, 6).alias("ratio"), F.when(share >= 0.5, 2).when(share >= 0.1, 1).otherwise(0).alias("mark"))


def histogram(df: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    """Value counts; a weight of -1 takes values back out."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(F.col(column).alias("value")).agg(n.cast("long").alias("n")).where("n <> 0")


def summary(hist: DataFrame) -> DataFrame:
    """Number of values, least, greatest, and the encoding they lead to."""
    return hist.agg(
        F.count(F.lit(1)).alias("nvals"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum("n").alias("total"),
        F.when(F.count(F.lit(1)) == 1, "constant").otherwise("external").alias("encoding"),
    )


def entropy(values: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Shannon entropy in bits per symbol, and the symbols' number, per key."""
    counts = values.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("n"))
    # -sum(p log p) from sums that combine before the shuffle: log N - sum(n log n) / N.
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(*keys, "total", F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("bits"))


def text_entropy(text: Column, usual: str = "ACGTN") -> Column:
    """Entropy in bits per character of one string, without a row per character. Strings of
    the ``usual`` symbols alone are counted without being taken apart."""
    n = F.length(text)
    count = lambda c: n - F.length(F.replace(text, c, F.lit("")))
    known = F.array(*[count(F.lit(c)) for c in usual])

    def bits(counts: Column) -> Column:
        total = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda acc, k: acc + k * F.log2(k.cast("double")))
        return F.round(F.log2(n.cast("double")) - total / n, 6)

    apart = F.transform(F.array_distinct(F.split(text, "")), count)
    return F.get(F.transform(F.array(known), lambda k: bits(F.when(F.aggregate(k, F.lit(0), lambda a, x: a + x) == n, k).otherwise(apart))), 0)



def run_benefit(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Gain of run lengths per symbol: +1 where a value repeats the one before, -2 where not."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = df.withColumn("same", F.col(value).eqNullSafe(F.lag(value).over(w)))
    return same.groupBy(F.col(value).alias("value")).agg(F.sum(F.when(F.col("same"), 1).otherwise(-2)).alias("benefit"), F.count(F.lit(1)).alias("n"))


def first_last(df: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    o = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(name, o).alias("first_name"), F.max_by(name, o).alias("last_name"), F.count(F.lit(1)).alias("n"))


def read_counts(reads: DataFrame, bad: Column) -> DataFrame:
    return reads.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("total"))


def crc_sums(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.sum(F.crc32(F.col(c).cast("binary"))) % F.lit(1 << 32)).alias(f"crc_{c}") for c in columns])


def ratio(raw: Column, packed: Column) -> Column:
    """Share of the raw size that is left, in per cent; null without raw bytes."""
    return F.when(raw > 0, F.round(F.lit(100.0) * packed / raw, 2))


#: Cost of a block method as a multiple of its size.
METHOD_COST = {"raw": 1.0, "gzip": 1.04, "bzip2": 1.08, "lzma": 1.04, "rans0": 1.0, "rans1": 1.01, "fqz": 1.05, "tok3": 1.05, "zstd": 1.03}


def best_method(trials: DataFrame, by: list[str], level: int = 5) -> DataFrame:
    """The method of the least weighted total size of each group of trials (method, size);
    the level says how much a method's cost weighs: four times, whole, half, a third, not."""
    weight = 4.0 if level <= 1 else 1.0 if level <= 3 else 1 / 2 if level <= 6 else 1 / 3 if level <= 7 else 0.0
    cost = F.lit(1.0)
    for name, c in METHOD_COST.items():
        cost = F.when(F.col("method") == name, F.lit(1 + (c - 1) * weight)).otherwise(cost)
    sizes = trials.groupBy(*by, "method").agg((F.sum("size") * F.max(cost)).alias("cost"))
    return sizes.groupBy(*by).agg(F.min(F.struct("cost", "method")).alias("b")).select(*by, F.col("b.method").alias("method"))
