"""Exact group sizes, and the groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most groups that are held on the driver and broadcast; beyond it the split is an ordinary shuffled join.
MAX_LISTED = 10_000


class HotGroups:
    """Groups of ``df`` with more than ``threshold`` rows, found with one count aggregated before its shuffle.

    ``weight``: what a row counts for, if not 1, for example the length of its array. There are at most rows / threshold of them. Up to ``max_listed`` they are listed on the driver and broadcast;
    if there are more, the joins below shuffle, with the same result.
    """

    def __init__(self, df: DataFrame, keys: list[str], threshold: int, max_listed: int = MAX_LISTED, weight: Column | None = None):
        self.keys = keys
        # Names of its own, as the rows it is joined with may descend from the same table.
        named = [F.col(k).alias(f"__hot{i}") for i, k in enumerate(keys)]
        sizes = df.groupBy(*named).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("bigint").alias("__size"))
        self.table = sizes.where(F.col("__size") > threshold)
        listed = self.table.limit(max_listed + 1).collect()
        self.listed = len(listed) <= max_listed
        self.empty = not listed
        if self.listed:
            self.table = F.broadcast(df.sparkSession.createDataFrame(listed, self.table.schema))

    def _on(self, df: DataFrame):
        cond = F.lit(True)
        for i, k in enumerate(self.keys):
            cond = cond & df[k].eqNullSafe(self.table[f"__hot{i}"])
        return cond

    def hot(self, df: DataFrame) -> DataFrame:
        """Rows of the hot groups."""
        return df.join(self.table, self._on(df), "left_semi")

    def cold(self, df: DataFrame) -> DataFrame:
        """Rows of all other groups."""
        return df if self.empty else df.join(self.table, self._on(df), "left_anti")

    def sized(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the size of its group in ``name``, null outside the hot groups."""
        if self.empty:
            return df.withColumn(name, F.lit(None).cast("bigint"))
        cols = [df[c] for c in df.columns]
        return df.join(self.table, self._on(df), "left").select(*cols, self.table["__size"].alias(name))
