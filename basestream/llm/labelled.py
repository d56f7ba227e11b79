"""Bounded, deterministic samples of labelled rows and one-task fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basestream.llm.common import materialise, returning, small_batches


def crc_rest(mod: int):
    """crc32 of the id's decimal text modulo ``mod``; null ids give null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def held_out(mod: int, rest: int):
    return F.coalesce(crc_rest(mod) == rest, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, keep, bounds: dict[int, int], max_bytes: int = 96 << 20, max_text_bytes: int = 1 << 20
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most about ``bounds[c]`` labelled rows of each
    class c, picked by a hash of the id among rows where ``keep`` holds, and the
    class counts over all such rows. Repeated labels of a document count once, by
    the larger label; rows without a label or an id are left out, and so are texts over
    ``max_text_bytes``. Where the picked texts pass ``max_bytes`` together, a smaller share
    of them is taken by the same hash. The picked ids are broadcast: their number is
    bounded by ``bounds``."""
    rows = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max(label).cast("int").alias("label_value"))
    )
    counts = {r["label_value"]: r["n"] for r in rows.groupBy("label_value").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for c, most in bounds.items():
        share = min(1.0, most / counts[c]) if counts.get(c) else 0.0
        chosen = chosen | ((F.col("label_value") == c) & (F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    picked = rows.where(chosen)
    fields = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
    fields = fields.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_text_bytes)
    joined = materialise(fields.join(F.broadcast(picked), "label_id").groupBy("label_id", "label_value").agg(F.min("text").alias("text")))
    size = joined.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        joined = joined.where(F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(1_000_000)) < int(max_bytes / size * 1_000_000))
    return joined, counts


def fit_in_one_task(rows: DataFrame, fit: Callable[[list[tuple]], bytes]) -> bytes:
    """Fit on an executor from the bounded sample; only the model comes back.
    Rows are sorted first, so a repeated task gives the same model."""

    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for b in batches:
            got += zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))
        got.sort(key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([fit(got)], pa.binary())], names=["model"])

    found = rows.select("label_id", "text", "label_value").repartition(1).mapInArrow(returning(run), "model binary").collect()
    return bytes(found[0]["model"]) if found else fit([])
