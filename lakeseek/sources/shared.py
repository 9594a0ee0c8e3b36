"""Tables written to the folder that all executors share, in order to cut lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that setting is absent a temporary folder is
made if the master is local, as driver and executors are then one machine; on a cluster its absence is an error, since
each executor would write to a disk of its own and rows would be lost in silence.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` isn't."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where the session names none and is local, else ``RuntimeError``."""
    named = spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lakeseek-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) of Hadoop, so that any store Spark can read is served."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none where it doesn't exist."""
    p, fs = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Make the finished folder ``staged`` visible as ``target`` by one rename.

    False, and ``staged`` is gone, if ``target`` is there already: of two writers exactly one wins, and neither lands
    inside the other's folder. Any other failure raises, so that nobody goes on as if the folder were published.
    """
    (src, fs), (dst, _) = hadoop_path(spark, staged), hadoop_path(spark, target)
    fs.mkdirs(dst.getParent())
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(src, dst, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as e:
        if fs.exists(dst) and "FileAlreadyExists" in str(e):
            fs.delete(src, True)
            return False
        raise
    return True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    The result has no lineage beyond the files, so losing an executor costs nothing but the tasks it ran. Its schema
    is the one of ``df``; an empty ``df`` gives an empty table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_all() -> None:
    """Delete every table that ``materialize`` wrote; results that read one can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; a local folder can still be removed
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    for path in _own.values():
        shutil.rmtree(path, ignore_errors=True)


atexit.register(forget_all)
