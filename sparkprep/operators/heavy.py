"""Heavy hitters of many columns in two scans, without shuffling every distinct cell.

The first scan sends one 64-bit hash a cell through Misra-Gries summaries: each task keeps at most ``counters`` hashes for
a column, summaries are added and cut back, so what is shuffled depends on tasks and columns only. A summary knows its
``error``: what was cut from every counter. A value that it does not list occurs at most ``error`` times, and ``error`` is
at most ``n / (counters + 1)`` for ``n`` values, however the summaries were merged: each unit cut took as much from
``counters + 1`` different hashes.

The second scan counts the values with listed hashes exactly, by value, so equal hashes of different values do no harm.
Therefore every value with more than ``error`` occurrences has an exact count here, and the largest ``k`` counts are the
column's top ``k`` wherever the last of them is above ``error``. Only columns where it is not need all their values counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.missing import canonical, field_type, is_missing, qcol, text_key
from sparkprep.operators.profile import ATOMIC, top_values, value_counts_long

COUNTERS = 64
#: Parts in which the tasks' summaries of one column are merged before they meet.
PARTS = 64

_SCHEMA = "i int, part int, n bigint, error bigint, hashes array<bigint>, counts array<bigint>"


@dataclass
class Summary:
    """Counters of the most frequent hashes; no hash occurs more than ``error`` times beyond its counter."""

    hashes: np.ndarray
    counts: np.ndarray
    n: int = 0
    error: int = 0

    @classmethod
    def empty(cls) -> Summary:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, hashes: np.ndarray, counts: np.ndarray, n: int, error: int, counters: int) -> None:
        """Add another summary, or counted values (error 0), and cut back to ``counters``."""
        found, of = np.unique(np.concatenate([self.hashes, hashes]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, of, np.concatenate([self.counts, counts]))
        self.n, self.error = self.n + n, self.error + error
        if len(found) > counters:
            cut = int(np.partition(total, len(total) - counters - 1)[len(total) - counters - 1])
            total = total - cut
            self.error += cut
            found, total = found[total > 0], total[total > 0]
        self.hashes, self.counts = found, total


def _batch(rows: list[tuple[int, int, Summary]]) -> pa.RecordBatch:
    i, part, found = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(i, pa.int32()),
            pa.array(part, pa.int32()),
            pa.array([s.n for s in found], pa.int64()),
            pa.array([s.error for s in found], pa.int64()),
            pa.array([s.hashes for s in found], pa.list_(pa.int64())),
            pa.array([s.counts for s in found], pa.list_(pa.int64())),
        ],
        names=["i", "part", "n", "error", "hashes", "counts"],
    )


def _hash(df: DataFrame, name: str) -> Column:
    """A hash that is equal for equal values, null where the value is missing."""
    dt = field_type(df, name)
    key = canonical(qcol(name), dt) if isinstance(dt, ATOMIC) else text_key(qcol(name), dt)
    return F.when(~is_missing(df, name), F.xxhash64(key))


def summaries(df: DataFrame, cols: Sequence[str], counters: int = COUNTERS) -> DataFrame:
    """``(i, part, n, error, hashes, counts)``, one row for each column ``i``: the merged summary of the whole table."""
    p = len(cols)

    def of_batches(batches):
        own = [Summary.empty() for _ in range(p)]
        for batch in batches:
            for summary, column in zip(own, batch.columns):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                if len(values):
                    summary.add(*np.unique(values, return_counts=True), len(values), 0, counters)
        part = TaskContext.get().partitionId() % PARTS
        yield _batch([(i, part, s) for i, s in enumerate(own)])

    def merge(table: pa.Table) -> pa.Table:
        whole = Summary.empty()
        for r in table.to_pylist():
            whole.add(np.array(r["hashes"], np.int64), np.array(r["counts"], np.int64), r["n"], r["error"], counters)
        return pa.Table.from_batches([_batch([(table.column("i")[0].as_py(), 0, whole)])])

    tasks = df.select(*[_hash(df, c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(of_batches, _SCHEMA)
    return tasks.groupBy("i", "part").applyInArrow(merge, _SCHEMA).groupBy("i").applyInArrow(merge, _SCHEMA)


def few_distinct(df: DataFrame, cols: Sequence[str], most: int) -> set[str]:
    """The numeric columns with at most ``most`` distinct values: exactly those whose summary never had to cut one of
    ``most`` counters. (The hash of a number of eight bytes is one to one.)"""
    return {cols[r["i"]] for r in summaries(df, cols, most).select("i", "error").collect() if r["error"] == 0} if cols else set()


@dataclass
class Heavy:
    """``counts`` is ``(column, value, num, cnt)`` as of V1, exact, for the listed values; ``n`` non-missing values and
    ``error`` by column: a value that ``counts`` does not have occurs at most ``error`` times."""

    counts: DataFrame
    n: dict[str, int]
    error: dict[str, int]


def heavy_hitters(df: DataFrame, cols: Sequence[str], counters: int = COUNTERS) -> Heavy:
    """Exact counts of every value that holds more than ``1 / (counters + 1)`` of a column's non-missing values (and of
    some others). The driver gets ``counters`` hashes a column. An empty table lists nothing."""
    cols = list(cols)
    n, error, listed = dict.fromkeys(cols, 0), dict.fromkeys(cols, 0), {}
    for r in summaries(df, cols, counters).collect() if cols else []:
        c = cols[r["i"]]
        n[c], error[c] = int(r["n"]), int(r["error"])
        if r["hashes"]:
            listed[c] = list(r["hashes"])
    # cells that are not listed become null, which V1 does not count
    cells = [F.when(_hash(df, c).isin(listed[c]), qcol(c)).alias(c) for c in listed]
    return Heavy(value_counts_long(df.select(*cells), list(listed)), n, error)


def top_counts(df: DataFrame, cols: Sequence[str], k: int = 1, counters: int = COUNTERS) -> DataFrame:
    """The ``k`` most frequent values of each column as ``(column, value, num, cnt, rank)``, ties by value; exact.

    Columns whose ``k``-th listed count is not above the error of their summary (nearly unique ones) are counted whole.
    """
    found = heavy_hitters(df, cols, max(counters, 2 * k))
    top = top_values(found.counts, k).persist()
    try:
        rows = top.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.min("cnt").alias("least")).collect()
        sure = {r["column"] for r in rows if r["least"] > found.error[r["column"]] and (r["k"] == k or found.error[r["column"]] == 0)}
        unsure = [c for c in cols if c not in sure and found.n[c]]
        values = top.filter(F.col("column").isin(list(sure))).collect()
    finally:
        top.unpersist()
    out = df.sparkSession.createDataFrame(values, top.schema)
    return out.unionByName(top_values(value_counts_long(df, unsure), k)) if unsure else out
