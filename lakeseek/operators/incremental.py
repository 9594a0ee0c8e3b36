"""Each run takes exactly the records that no successful run has taken.

A record gets its sequence number once, when its file is first seen: the file and the place in it. Files of a log are
only ever added, so a number never changes and is never given again, however late the record comes or how it sorts
(``Arrivals``). What successful runs took is kept as disjoint closed intervals of these numbers (``Progress``); a run
subtracts them from the available ranges and takes the gaps, wherever they are, so records that were committed late are
found as well. Its output and the intervals it took become visible by one rename, so a run that dies leaves nothing
behind, and one that ends is never repeated.
"""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeseek.sources.shared import children, exists, hadoop_path, publish

#: Sequence numbers that are turned into intervals together.
BLOCK = 1 << 16
SCHEMA = "first bigint, last bigint"
#: The stream of an interval of ``Arrivals``: the name of a file.
FILE = {"file": "string"}


def _segments(df: DataFrame, stream: list[str], takes: list[str]) -> DataFrame:
    """Sweep over the places: the stretches between marks with the running sum of each of ``takes``."""
    marks = df.groupBy(*stream, "__pos").agg(*[F.sum(c).alias(c) for c in takes])
    w = Window.partitionBy(*stream).orderBy("__pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.select(*stream, F.col("__pos").alias("first"), (F.lead("__pos").over(w) - 1).alias("last"), *[F.sum(c).over(upto).alias(c) for c in takes])


def _joined(df: DataFrame, stream: list[str]) -> DataFrame:
    """Adjacent disjoint intervals made one."""
    w = Window.partitionBy(*stream).orderBy("first")
    starts = F.when(F.lag("last").over(w) + 1 == F.col("first"), 0).otherwise(1)
    island = F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__starts", starts).withColumn("__island", island).groupBy(*stream, "__island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__island")


def _marks(df: DataFrame, stream: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """An interval as the place where it begins (+1) and the one after its end (-1)."""
    at = F.explode(F.array(F.struct(F.col("first").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("pos"), F.lit(-1).alias("d"))))
    return df.where(F.col("first") <= F.col("last")).select(*stream, at.alias("__m")).select(*stream, F.col("__m.pos").alias("__pos"), *[(F.col("__m.d") if k == kind else F.lit(0)).alias(k) for k in kinds])


def merge_intervals(df: DataFrame, stream: list[str]) -> DataFrame:
    """Disjoint, non-adjacent intervals (``first``, ``last``) that cover the same numbers; overlaps and repeats are fine.

    Intervals with null ends or ``first > last`` are empty. Null stream keys form a stream. Empty in, empty out. Stream
    columns may have any names but ``first`` and ``last``.
    """
    covered = _segments(_marks(df, stream, "__a", ["__a"]), stream, ["__a"]).where(F.col("__a") > 0)
    return _joined(covered.select(*stream, "first", "last"), stream)


def subtract_intervals(available: DataFrame, taken: DataFrame, stream: list[str]) -> DataFrame:
    """Disjoint intervals of the numbers that ``available`` covers and ``taken`` doesn't; the same rules as above."""
    kinds = ["__a", "__t"]
    marks = _marks(available, stream, "__a", kinds).unionByName(_marks(taken, stream, "__t", kinds))
    gaps = _segments(marks, stream, kinds).where((F.col("__a") > 0) & (F.col("__t") == 0))
    return _joined(gaps.select(*stream, "first", "last"), stream)


def to_intervals(df: DataFrame, stream: list[str], seq: str) -> DataFrame:
    """The numbers in the column ``seq`` as disjoint intervals; repeats count once, null numbers are passed over.

    Numbers are first joined into runs inside blocks, so that a stream with a great share of all rows is spread over
    many tasks, and only the runs of a stream come together.
    """
    numbers = df.where(F.col(seq).isNotNull()).select(*stream, F.col(seq).cast("bigint").alias("__seq")).distinct()
    numbers = numbers.withColumn("__block", F.floor(F.col("__seq") / BLOCK))
    island = F.col("__seq") - F.row_number().over(Window.partitionBy(*stream, "__block").orderBy("__seq"))
    runs = numbers.withColumn("__island", island).groupBy(*stream, "__block", "__island").agg(F.min("__seq").alias("first"), F.max("__seq").alias("last"))
    return _joined(runs.select(*stream, "first", "last"), stream)


def _by_name(df: DataFrame) -> dict[str, str]:
    """The files of a scan by their names."""
    return {PurePosixPath(p).name: p for p in map(unquote, df.inputFiles())}


class Arrivals:
    """The records of a log of Parquet files, numbered at arrival.

    ``ident``: columns that make a record what it is; a record delivered again, in the same file or a later one, is the
    one known already and isn't available a second time. Without ``ident`` every row is a record. ``dated``: records with
    a null in this column are never available.

    ``<root>/arrivals/<n>`` holds what the n-th intake found: ``files`` (name, rows, time), ``ranges`` (available
    intervals by file) and ``ids`` (``ident``, file, number), published together by one rename; of two intakes at once one
    wins and the other has no effect. An intake reads new files only, and of the history only ``ids``, where there are
    ``ident`` columns. File names identify files; a file that changed after its intake raises ``ValueError``.
    """

    def __init__(self, spark: SparkSession, root: str, ident: list[str] | None = None, dated: str | None = None):
        self.spark, self.root, self.ident, self.dated = spark, root.rstrip("/"), ident or [], dated

    def _parts(self, what: str) -> list[str]:
        return [f"{self.root}/arrivals/{n}/{what}" for n in children(self.spark, f"{self.root}/arrivals")]

    def files(self) -> dict[str, tuple[int, int]]:
        """Rows and time of change of every known file; as many entries as Spark itself lists for a scan."""
        parts = self._parts("files")
        return {r["file"]: (r["rows"], r["changed"]) for r in self.spark.read.parquet(*parts).collect()} if parts else {}

    def ranges(self) -> DataFrame:
        """Available intervals by file."""
        parts = self._parts("ranges")
        kind = f"file string, {SCHEMA}"
        return self.spark.read.schema(kind).parquet(*parts) if parts else self.spark.createDataFrame([], kind)

    def ids(self) -> DataFrame:
        """``ident``, ``file`` and ``seq`` of every available record; needs ``ident`` and an intake."""
        return self.spark.read.parquet(*self._parts("ids"))

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__seq"))

    def take_in(self, log: str) -> int:
        """Number the records of files of ``log`` (a file or folder) that aren't known yet; returns how many files those are."""
        now = _by_name(self.spark.read.parquet(log))
        known = self.files()
        seen = self._changed([*now.values()])
        if changed := [f for f in now if f in known and known[f][1] != seen[f]]:
            raise ValueError(f"files of the log changed after they were taken in: {sorted(changed)[:5]}")
        fresh = [now[f] for f in sorted(now) if f not in known]
        if not fresh:
            return 0
        staged, at = f"{self.root}/staged/{uuid.uuid4().hex}", len(children(self.spark, f"{self.root}/arrivals"))
        rows = self._rows(fresh)
        counts = {r["file"]: r["rows"] for r in rows.groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("rows")).collect()}
        names = [f for f in sorted(now) if f not in known]
        listed = self.spark.createDataFrame([(f, counts.get(f, 0), seen[f]) for f in names], "file string, rows bigint, changed bigint")
        listed.coalesce(1).write.parquet(f"{staged}/files")
        if self.dated:
            rows = rows.where(F.col(self.dated).isNotNull())
        if not self.ident:
            new = rows.select(F.col("__file").alias("file"), F.col("__seq").alias("seq"))
        else:
            first = rows.groupBy(*self.ident).agg(F.min(F.struct("__file", "__seq")).alias("__at"))
            if known and (parts := self._parts("ids")):
                old = self.spark.read.parquet(*parts).select(*[F.col(c).alias(f"__old_{i}") for i, c in enumerate(self.ident)])
                same = F.lit(True)
                for i, c in enumerate(self.ident):
                    same = same & F.col(c).eqNullSafe(F.col(f"__old_{i}"))
                first = first.join(old, same, "left_anti")
            first.select(*self.ident, F.col("__at.__file").alias("file"), F.col("__at.__seq").alias("seq")).write.parquet(f"{staged}/ids")
            new = self.spark.read.parquet(f"{staged}/ids").select("file", "seq")
        to_intervals(new, [*FILE], "seq").write.parquet(f"{staged}/ranges")
        return len(fresh) if publish(self.spark, staged, f"{self.root}/arrivals/{at:08d}") else self.take_in(log)

    def _changed(self, paths: list[str]) -> dict[str, int]:
        out, folders = {}, {p.rpartition("/")[0] for p in paths}
        for folder in folders:  # one listing a folder
            p, fs = hadoop_path(self.spark, folder)
            out |= {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)}
        return out

    def numbers(self, lines: DataFrame) -> DataFrame:
        """``file`` and ``seq`` of the records that ``lines`` name by their ``ident`` columns, null equal to null."""
        named = lines.select(*[F.col(c).alias(f"__line_{i}") for i, c in enumerate(self.ident)]).distinct()
        same = F.lit(True)
        for i, c in enumerate(self.ident):
            same = same & F.col(c).eqNullSafe(F.col(f"__line_{i}"))
        return self.ids().join(named, same, "left_semi").select("file", "seq")

    def records(self, log: str, gaps: DataFrame) -> DataFrame:
        """The rows of ``log`` in the intervals ``gaps``, and their ``file`` and ``seq``; other files aren't opened.

        An interval is cut into blocks of numbers, so that a file of any number of rows and gaps is joined in many tasks.
        """
        wanted = {r["file"] for r in gaps.select("file").distinct().collect()}  # names of files to open
        df = self.spark.read.parquet(log)
        paths = [p for f, p in _by_name(df).items() if f in wanted]
        if not paths:
            return df.limit(0).select("*", F.lit("").alias("file"), F.lit(0).cast("bigint").alias("seq"))
        block = lambda c: F.floor(F.col(c) / BLOCK)
        cut = gaps.select(F.col("file").alias("__g"), F.col("first").alias("__first"), F.col("last").alias("__last"), F.explode(F.sequence(block("first"), block("last"))).alias("__block"))
        rows = self._rows(paths)
        inside = (F.col("__file") == F.col("__g")) & (block("__seq") == F.col("__block")) & F.col("__seq").between(F.col("__first"), F.col("__last"))
        return rows.join(cut, inside).select(*[rows[c] for c in df.columns], F.col("__file").alias("file"), F.col("__seq").alias("seq"))


class Progress:
    """Outputs and taken intervals of the runs under one folder.

    ``<root>/done/<run>/data`` and ``<root>/done/<run>/taken`` are written under another name and appear together by one
    rename. A run that died before it has no effect: the next one finds the same gaps. One that died after it is done.
    """

    def __init__(self, spark: SparkSession, root: str, stream: dict[str, str]):
        self.spark, self.root, self.stream = spark, root.rstrip("/"), stream

    def runs(self) -> list[str]:
        """Names of the runs that ended well."""
        return children(self.spark, f"{self.root}/done")

    def taken(self) -> DataFrame:
        """Merged intervals that successful runs took."""
        kind = ", ".join([*(f"`{c}` {t}" for c, t in self.stream.items()), SCHEMA])
        paths = [f"{self.root}/done/{r}/taken" for r in self.runs()]
        df = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return merge_intervals(df, [*self.stream])

    def gaps(self, available: DataFrame) -> DataFrame:
        """What of the available intervals is still to be taken."""
        return subtract_intervals(available, self.taken(), [*self.stream])

    def commit(self, run: str, output: DataFrame, taken: DataFrame) -> bool:
        """Publish ``output`` and the intervals it covers as ``run``; False, with no effect, if that run is done already."""
        target = f"{self.root}/done/{run}"
        if exists(self.spark, target):
            return False
        staged = f"{self.root}/staged/{run}-{uuid.uuid4().hex}"
        output.write.parquet(f"{staged}/data")
        merge_intervals(taken, [*self.stream]).write.parquet(f"{staged}/taken")
        return publish(self.spark, staged, target)

    def output(self) -> DataFrame | None:
        """The rows of all successful runs; None before the first."""
        paths = [f"{self.root}/done/{r}/data" for r in self.runs()]
        return self.spark.read.parquet(*paths) if paths else None
