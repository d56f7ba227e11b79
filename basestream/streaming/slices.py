"""Slices and depth over streams of alignment records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLICE = "source string, slice_no long, ref_id int, start long, end long, records long, bases long"
STATE = "slice_no long, ref_id int, start long, end long, records long, bases long"


def cut_slices(records: DataFrame, most_records: int = 10_000, most_bases: int = 5_000_000) -> DataFrame:
    """Closed slices of a stream (source, file_ord, ref_id, pos, span): a slice closes when it
    is full by records or bases, when the reference changes, or at the mark of its source's
    end: a row without ref_id, behind the records of its batch, which also drops the state.
    State is one open slice a source; a batch's rows of a source are taken in file order.
    Without the mark a source's last slice stays open."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, ref, start, end, n, bases = state.get if state.exists else (0, None, 0, 0, 0, 0)
        closed = []
        rows = pd.concat(list(frames))
        ended = bool(rows["ref_id"].isna().any())
        rows = rows[rows["ref_id"].notna()].sort_values("file_ord")
        for r, p, s in zip(rows["ref_id"], rows["pos"], rows["span"]):
            r, p, s = int(r), int(p), int(s)
            if n and (r != ref or n >= most_records or bases >= most_bases):
                closed.append((key[0], no, ref, start, end, n, bases))
                no, n, bases = no + 1, 0, 0
            if n == 0:
                ref, start, end = r, p, p + s - 1
            n, bases, start, end = n + 1, bases + s, min(start, p), max(end, p + s - 1)
        if ended:
            if n:
                closed.append((key[0], no, ref, start, end, n, bases))
            state.remove()
        else:
            state.update((no, ref, start, end, n, bases))
        yield pd.DataFrame(closed, columns=["source", "slice_no", "ref_id", "start", "end", "records", "bases"])

    return records.groupBy("source").applyInPandasWithState(step, SLICE, STATE, "append", GroupStateTimeout.NoTimeout)


def depth_stream(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Depth per (window of arrival, ref_id, pos); a watermark on the column ``ts`` lets
    windows close and their state go."""
    spread = records.withWatermark("ts", late).select("ts", "ref_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("span") - 1)).alias("pos"))
    return spread.groupBy(F.window("ts", "1 hour"), "ref_id", "pos").agg(F.count(F.lit(1)).alias("depth"))
