"""Lake tables: directories, zip and tar archives; guards; the catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.functions.text import column_names
from lakeseek.sources.shared import children, hadoop_path, scratch

FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv"}


@dataclass(frozen=True)
class TableSource:
    """Where a table lies and how to read it; executors read it by its path."""

    table_index: int
    name: str
    path: str
    format: str

    def read(self, spark: SparkSession, schema: T.StructType | None = None, quote: str = "") -> DataFrame:
        """The table. Text formats have a header; bad cells become null, ragged rows are cut, quotes are ordinary
        characters unless ``quote`` names one."""
        if self.format == "parquet":
            return spark.read.parquet(self.path)
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("sep", "\t" if self.format.startswith("tsv") else ",")
        reader = reader.option("quote", quote).option("encoding", "UTF-8")
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(self.path)


def _format(name: str) -> str | None:
    return next((f for end, f in FORMATS.items() if name.lower().endswith(end)), None)


ARCHIVES = (".zip", ".tar.gz", ".tgz", ".tar")


def _unpack(spark: SparkSession, archive: str, wanted: Callable[[str], bool]) -> dict[str, str]:
    """The wanted members of an archive, in its order, copied to the shared folder, where all executors can read them.

    The archive may lie in any store that Spark reads. It is copied as a stream inside the JVM of the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, fs = hadoop_path(spark, archive)
    raw = jvm.java.io.BufferedInputStream(fs.open(path))
    if archive.endswith(".zip"):
        stream = jvm.java.util.zip.ZipInputStream(raw)
    else:
        unzipped = raw if archive.endswith(".tar") else jvm.java.util.zip.GZIPInputStream(raw)
        stream = jvm.org.apache.commons.compress.archivers.tar.TarArchiveInputStream(unzipped)
    out, root = {}, scratch(spark, "unpacked")
    try:
        while (entry := stream.getNextEntry()) is not None:
            name = entry.getName()
            if not entry.isDirectory() and wanted(name):
                out[name] = f"{root}/{len(out)}-{PurePosixPath(name).name}"
                target, to = hadoop_path(spark, out[name])
                sink = to.create(target, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, conf, False)
                sink.close()
    finally:
        stream.close()
    return out


def archive(spark: SparkSession, path: str, members: dict[str, str]) -> None:
    """Pack files into a zip or tar.gz in any store; a member given as a folder is the single part file in it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p, fs = hadoop_path(spark, path)
    raw = fs.create(p, True)
    zipped = path.endswith(".zip")
    tar = jvm.org.apache.commons.compress.archivers.tar
    out = jvm.java.util.zip.ZipOutputStream(raw) if zipped else tar.TarArchiveOutputStream(jvm.java.util.zip.GZIPOutputStream(raw))
    for name, member in members.items():
        m, of = hadoop_path(spark, member)
        if of.getFileStatus(m).isDirectory():
            m, _ = hadoop_path(spark, f"{member}/{next(n for n in children(spark, member) if n.startswith('part-'))}")
        if zipped:
            out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        else:
            entry = tar.TarArchiveEntry(name)
            entry.setSize(of.getFileStatus(m).getLen())
            out.putArchiveEntry(entry)
        source = of.open(m)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
        out.closeEntry() if zipped else out.closeArchiveEntry()
    out.close()


def list_tables(spark: SparkSession, path: str, first_index: int = 0, after: str | None = None, n_tables: int | None = None) -> list[TableSource]:
    """Tables of a directory (by name, not recursive), of a zip (.parquet, .csv) or of a tar.gz (.tsv.gz), in order.

    The path may be one of any store that Spark reads; a folder named like a table is a table. ``after``: resume behind
    the table of this name; ``n_tables``: stop after so many.
    """
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory():
        found = [(n, f"{path.rstrip('/')}/{n}", _format(n)) for n in children(spark, path) if _format(n)]
    elif path.endswith(".zip"):
        found = [(n, f, _format(n)) for n, f in _unpack(spark, path, lambda n: _format(n) in ("parquet", "csv")).items()]
    elif path.endswith(ARCHIVES):
        found = [(n, f, "tsv.gz") for n, f in _unpack(spark, path, lambda n: n.endswith(".tsv.gz")).items()]
    else:
        raise FileNotFoundError(f"{path} is neither a folder nor an archive ({', '.join(ARCHIVES)})")
    if after is not None:
        at = [n for n, _, _ in found].index(after) + 1
        first_index, found = first_index + at, found[at:]
    return [TableSource(first_index + i, n, f, kind) for i, (n, f, kind) in enumerate(found[:n_tables])]


def resolve_sources(spark: SparkSession, path: str) -> Iterator[TableSource]:
    """All tables under ``path``; a directory of archives is read archive by archive with running table numbers."""
    p, fs = hadoop_path(spark, path)
    folder = fs.exists(p) and fs.getFileStatus(p).isDirectory()
    archives = [f"{path.rstrip('/')}/{n}" for n in children(spark, path) if n.endswith(ARCHIVES)] if folder else []
    start = 0
    for a in archives or [path]:
        tables = list_tables(spark, a, start)
        start += len(tables)
        yield from tables


def too_wide(df: DataFrame, max_cols: int = 100) -> bool:
    return len(df.columns) > max_cols


def cap_rows(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Sampling guard for one huge lake table, off by default in builds: the rows with fewest nulls.

    Of more than ``limit`` rows the 2 x ``limit`` with fewest nulls are kept and of these ``limit`` in the order of a
    hash of the row, so the choice is the same each time. Both steps are Spark's distributed top-n.
    """
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    order = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    ranked = df.withColumns({"__nulls": nulls, "__order": order})
    best = ranked.orderBy("__nulls", "__order").limit(2 * limit)
    return best.orderBy("__order").limit(limit).drop("__nulls", "__order")


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*column_names(df.columns))


def split_types(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """(table with booleans as text, numeric columns, text columns); other types are in neither list."""
    bools = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    df = df.withColumns({c: F.col(c).cast("string") for c in bools})
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df, numeric, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def catalog(spark: SparkSession, sources: list[TableSource]) -> DataFrame:
    """``table_index``, ``table_name``, ``path``, ``format`` of the tables."""
    rows = [(s.table_index, s.name, s.path, s.format) for s in sources]
    return spark.createDataFrame(rows, "table_index int, table_name string, path string, format string")


def select_known(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` in the columns of ``target``, in its types; columns that ``df`` lacks are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
