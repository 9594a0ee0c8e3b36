"""New lake rows as a stream: each micro-batch is added to the state of its table.

State is a sum, so the order of batches and late rows play no part. A batch writes its own state only, under its number,
by one rename; the state of the table is the sum of what the batches wrote. So a batch is applied once, one that was applied is
skipped when the query restarts, and its cost doesn't grow with the table. Every ``compact`` batches the sum is written
as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeseek.operators import state
from lakeseek.sources.shared import children, delete, publish

BY = ["key", "col_name"]


class StateStore:
    """A table's numeric state under one folder: ``<root>/sums/<n>`` holds batches up to n, ``<root>/deltas/<n>`` batch n."""

    def __init__(self, spark: SparkSession, root: str, compact: int = 16):
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact

    def _numbers(self, kind: str) -> list[int]:
        return sorted(map(int, children(self.spark, f"{self.root}/{kind}")))

    def newest(self) -> int:
        """The number of the last batch that was applied; -1 before the first."""
        return max([*self._numbers("sums"), *self._numbers("deltas")], default=-1)

    def _parts(self) -> tuple[list[str], int]:
        """Folders that make up the state, and how many of them are batches."""
        at = max(self._numbers("sums"), default=-1)
        deltas = [f"{self.root}/deltas/{n}" for n in self._numbers("deltas") if n > at]
        return [*([f"{self.root}/sums/{at}"] if at >= 0 else []), *deltas], len(deltas)

    def read(self) -> DataFrame | None:
        parts, _ = self._parts()
        return state.merge_numeric([self.spark.read.parquet(*parts)], BY) if parts else None

    def _publish(self, df: DataFrame, kind: str, number: int) -> bool:
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        df.write.parquet(staged)
        return publish(self.spark, staged, f"{self.root}/{kind}/{number}")

    def add(self, delta: DataFrame, batch: int) -> bool:
        """Adds the state of a batch; False, with no effect, if that batch was applied already."""
        if batch <= max(self._numbers("sums"), default=-1) or not self._publish(delta, "deltas", batch):
            return False
        if self._parts()[1] >= self.compact:
            self._publish(self.read(), "sums", batch)
            # One sum and its batches stay behind the newest, for readers under way.
            for old in self._numbers("sums")[:-2]:
                delete(self.spark, f"{self.root}/sums/{old}")
            kept = self._numbers("sums")
            for n in self._numbers("deltas"):
                if len(kept) > 1 and n <= kept[0]:
                    delete(self.spark, f"{self.root}/deltas/{n}")
        return True


def append_updates(spark: SparkSession, source: str, schema: StructType, key: str, columns: list[str], store: StateStore, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Start a query that adds rows of new Parquet files under ``source`` to ``store``, then ends (available now)."""

    def apply(batch: DataFrame, number: int) -> None:
        store.add(state.numeric_state(batch, key, columns), number)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).parquet(source)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per time window and ``by``, for a stream or a table; a stream gives up on rows later than ``late``."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
