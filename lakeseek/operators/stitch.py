"""Per-key results where a handful of keys hold most rows.

Rows are range partitioned on the composite (key, value, further columns): Spark samples quantiles of the whole composite,
so a heavy key is cut over as many tasks as its rows ask for and every task gets about the same. Sorted inside a task, a
key is one run. Keys that begin and end inside a batch of a task are done there; only the first and the last key of a
batch can go on in a neighbour, and for these two it hands on partial states, one row for each value, as they come: a
task holds one batch, however many values a key has. The partial states of the boundary keys are stitched by two
aggregations that both combine inside their tasks first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.sources.shared import materialize


def _new(cols: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the row before it in any of ``cols``, nulls being equal; the first row does."""
    n = len(cols[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in cols:
        if n > 1:
            here, before = c.slice(1), c.slice(0, n - 1)
            out[1:] |= pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
            if c.null_count:
                out[1:] |= pc.xor(pc.is_null(here), pc.is_null(before)).to_numpy(zero_copy_only=False)
    return out


def _runs(batch: pa.RecordBatch, before: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """(key, value, count) of every run in a sorted batch without repeated rows; ``before`` is the row ahead of it."""
    cols = batch.columns
    last = tuple(c[-1] for c in cols)
    fresh = _new(cols)
    if before is not None and all(c[0] == b for c, b in zip(cols, before, strict=True)):
        fresh[0] = False
    cols = [c.filter(pa.array(fresh)) for c in cols[:2]]
    at = np.flatnonzero(_new(cols)) if len(cols[0]) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(cols[0])))
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in cols), pa.array(counts, pa.int64())], names=["key", "value", "n"]), last


def _best(t: pa.Table) -> tuple[pa.Table, pa.Array]:
    """(key, value, n, total) with the most frequent value of every key, ties to the smaller; t has whole keys, sorted."""
    key, value, n = (t.column(i).combine_chunks() for i in range(3))
    starts = np.flatnonzero(_new([key]))
    counts = n.to_numpy()
    sizes = np.diff(np.append(starts, len(counts)))
    most = np.repeat(np.maximum.reduceat(counts, starts), sizes)
    first = np.where(counts == most, np.arange(len(counts)), len(counts))
    best = np.minimum.reduceat(first, starts)
    return pa.table([key.take(pa.array(best)), value.take(pa.array(best)), pa.array(counts[best]), pa.array(np.add.reduceat(counts, starts))], names=["key", "value", "n", "total"])


def _of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the keys inside a batch (total set), partial states of its first and last key (total null)."""
    row = None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, row = _runs(batch, row)
        if not runs.num_rows:
            continue
        t = pa.Table.from_batches([runs])
        key = runs.column(0)
        edge = pc.or_(pc.equal(key, key[0]), pc.equal(key, key[-1]))
        open_runs, done = t.filter(edge), t.filter(pc.invert(edge))
        yield from open_runs.append_column("total", pa.nulls(len(open_runs), pa.int64())).to_batches()
        if len(done):
            yield from _best(done).to_batches()


def most_frequent_value(df: DataFrame, key: str, value: str, others: list[str], least: int = 1) -> DataFrame:
    """For every key with at least ``least`` distinct rows the value most of them have, ties to the smaller value.

    Columns: ``key``, ``value``, ``n`` (distinct rows with the value), ``total`` (of the key). A row is (``key``,
    ``value``, ``others``); rows equal in all of them count once. Null and empty keys are passed over, and rows whose
    value is null. Keys are compared as stored. An empty table gives an empty one. Other columns are ignored.
    """
    cols = [F.col(key).alias("key"), F.col(value).alias("value"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(others))]
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(value).isNotNull()).select(*cols)
    kind = dict(rows.dtypes)
    ranged = rows.repartitionByRange(*rows.columns).sortWithinPartitions(*rows.columns)
    parts = ranged.mapInArrow(_of_partition, f"key {kind['key']}, value {kind['value']}, n bigint, total bigint")
    # Written once, as two branches read it: an inside key is a row of its own, a boundary key adds up its partial states.
    parts = materialize(parts.where(F.col("total").isNull() | (F.col("total") >= least)), "runs")
    pieces = parts.where(F.col("total").isNull()).groupBy("key", "value").agg(F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best")
    stitched = pieces.groupBy("key").agg(best, F.sum("n").alias("total")).select("key", "best.value", (-F.col("best.n")).alias("n"), "total")
    return parts.where(F.col("total").isNotNull()).unionByName(stitched).where(F.col("total") >= least)
