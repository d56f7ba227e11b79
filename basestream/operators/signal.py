"""Operators over trace samples: as ordered rows (key, at, v), or as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def deltas(df: DataFrame, value: str, keys: list[str], order: list[str], times: int, bits: int = 16) -> DataFrame:
    """Differences of order 1 to 3 with zeros before the first value, modulo 2**bits."""
    w = over(keys, order)
    # Coefficients of (1 - x)**times.
    coefficients = {1: (1, -1), 2: (1, -2, 1), 3: (1, -3, 3, -1)}[times]
    total = sum((F.lit(c) * F.coalesce(F.lag(value, k).over(w), F.lit(0)) for k, c in enumerate(coefficients)), F.lit(0))
    return df.withColumn("delta", F.pmod(total, F.lit(1 << bits)).cast("long"))


def undo_deltas(df: DataFrame, value: str, keys: list[str], order: list[str], times: int, bits: int = 16) -> DataFrame:
    """Running sums, once per order."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(times):
        df = df.withColumn(value, F.pmod(F.sum(value).over(w), F.lit(1 << bits)).cast("long"))
    return df


def array_deltas(a: Column, times: int, bits: int = 16) -> Column:
    for _ in range(times):
        a = F.zip_with(a, F.slice(F.concat(F.array(F.lit(0).cast("long")), a.cast("array<bigint>")), F.lit(1), F.greatest(F.size(a), F.lit(0))), lambda x, y: F.pmod(x - y, F.lit(1 << bits)))
    return a


def sliding_background(df: DataFrame, value: str, keys: list[str], order: list[str], before: int = 250, after: int = 249) -> DataFrame:
    w = over(keys, order).rowsBetween(-before, after)
    return df.withColumn("background", F.min(value).over(w)).withColumn("corrected", F.col(value) - F.col("background"))


def pair_average(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Every two neighbours become their truncated mean; an odd last value goes."""
    numbered = df.withColumn("n", F.row_number().over(over(keys, order)) - 1)
    pairs = numbered.groupBy(*keys, F.floor(F.col("n") / 2).cast("long").alias("pair")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c")).where("c = 2")
    return pairs.select(*keys, "pair", F.expr("s div 2").cast("long").alias("average"))


def rescale(df: DataFrame, value: str, keys: list[str], most: int) -> DataFrame:
    """Down to a greatest value, rounding half up; values already below stay."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn("scaled", F.when(top > most, F.floor(F.col(value) * F.lit(float(most)) / top + 0.5)).otherwise(F.col(value)).cast("long"))


def no_negatives(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    low = F.min(value).over(Window.partitionBy(*keys))
    return df.withColumn("raised", F.col(value) - F.least(low, F.lit(0)))


def clip_at_called(df: DataFrame, value: str, called: Column, keys: list[str]) -> DataFrame:
    """No value above the highest at a called base."""
    top = F.max(F.when(called, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("clipped", F.least(F.col(value), F.coalesce(top, F.col(value))))


def attack_decay(samples: Column, floor: int = 100, scale: int = 2000, cap: int = 32767) -> Column:
    """Recursive envelope as a fold: a twentieth of the way up, a tenth of the way down,
    never under ``floor``; samples scaled to it."""
    start = F.struct(F.lit(float(floor)).alias("m"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        m = F.greatest(F.lit(float(floor)), F.when(v > acc["m"], acc["m"] + (v - acc["m"]) / 20.0).otherwise(acc["m"] - (acc["m"] - v) / 10.0))
        scaled = F.least(F.lit(float(cap)), v * F.lit(float(scale)) / m)
        return F.struct(m.alias("m"), F.concat(acc["out"], F.array(F.floor(scaled).cast("long"))).alias("out"))

    return F.aggregate(samples.cast("array<double>"), start, step, lambda acc: acc["out"])


def channel_background(*channels: Column) -> list[Column]:
    """Each point of every channel less the least of the channels at that point."""
    low = channels[0]
    for c in channels[1:]:
        low = F.zip_with(low, c, lambda x, y: F.least(x, y))
    return [F.zip_with(c, low, lambda x, y: x - y) for c in channels]


def window_normalise(df: DataFrame, value: str, keys: list[str], order: list[str], width: int = 1000, peak: int = 65535) -> DataFrame:
    """Samples against the mean envelope of the ``width`` points that follow."""
    w = over(keys, order).rowsBetween(1, width)
    total = F.sum(value).over(w)
    top = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn("normal", F.when(total > 0, F.least(F.lit(peak), F.floor(F.col(value) * F.lit(1000.0) * top / total))).otherwise(F.col(value)).cast("long"))


def range_strings(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Ascending runs of consecutive distinct numbers as ``a..b``, joined by blanks."""
    w = Window.partitionBy(*keys).orderBy(value)
    runs = df.select(*keys, value).distinct().withColumn("g", F.col(value) - F.row_number().over(w))
    ends = runs.groupBy(*keys, "g").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit(".."), F.col("b").cast("string")))
    parts = ends.select(*keys, F.struct("a", text.alias("t")).alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("ranges"))


def expand_ranges(df: DataFrame, text: str, keys: list[str], value: str = "value") -> DataFrame:
    """The numbers that ``a..b`` runs name, in either direction."""
    part = df.select(*keys, F.explode(F.split(text, " ")).alias("r")).where("r <> ''")
    a = F.substring_index("r", "..", 1).cast("long")
    b = F.substring_index("r", "..", -1).cast("long")
    return part.select(*keys, F.explode(F.sequence(a, b)).alias(value))


def confidence_at(positions: Column, confidence: Column) -> Column:
    """Confidence by original position; position 0 (an inserted base) has none."""
    return F.transform(positions, lambda p: F.when(p == 0, F.lit(0)).otherwise(F.coalesce(F.get(confidence, p - 1), F.lit(0))))
