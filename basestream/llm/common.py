"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where
    it is unset and Spark runs in one process (local tests) is a temporary folder used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="basestream-ckpt-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Batches of at most ``rows`` texts between the JVM and Python, where the session
    doesn't set a number: Spark's 10,000 texts take some 100 MB a task on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives free memory back to the system: idle workers
    stay for a while, and several of them stand beside each executor."""

    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return outer


def beside(df: DataFrame, step: Callable[[DataFrame], DataFrame], names: Iterable[str]) -> DataFrame:
    """The columns of ``df`` after ``step``, in their order; those called like one of
    ``names``, which ``step`` gives to columns of its own, pass through unchanged."""
    taken = {n.lower() for n in names}
    held: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in taken:
            held[c] = unused(df, f"kept_{len(held)}_{c}")
    done = step(df.withColumnsRenamed(held))
    return done.select(*[F.col("`" + held.get(c, c).replace("`", "``") + "`").alias(c) for c in df.columns])


def with_columns_arrow(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: list[T.StructField],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append (or replace) columns computed from whole Arrow batches; the other
    columns pass through untouched. A clashing column is replaced."""
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in drop]
    schema = T.StructType(kept + fields)
    names = [f.name for f in kept]
    added = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            out = fn(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(n)) for n in names] + [out[n] for n in added],
                names=names + added,
            )

    return df.mapInArrow(returning(run), schema)


def texts(b: pa.RecordBatch, name: str = "text") -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def doc_ids(b: pa.RecordBatch, name: str = "doc_id") -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()
