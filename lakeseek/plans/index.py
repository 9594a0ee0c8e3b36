"""The index of a lake on disk: features in long form, mergeable state, metadata; all partitioned by table.

Sections of one table are replaced by dynamic partition overwrite: readers see the old or the new files of a partition,
and a failed job leaves the old ones. An update writes all its sections aside, with its id, and publishes them by one rename;
from then on it is only carried over, which may be done again by whoever comes next. A lock keeps other updates of
the table away.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators import features as feat
from lakeseek.operators import state
from lakeseek.operators.retrieval import PAIR, resolve_tables
from lakeseek.operators.union import UnionPeer, find_union_peer, seek_categories, seek_keys, stacked_values
from lakeseek.plans.config import EngineConfig
from lakeseek.plans.errors import TableLocked
from lakeseek.sources.lake import TableSource, resolve_sources, split_types, too_wide, with_clean_names
from lakeseek.sources.shared import children, delete, exists, publish

#: Age from which a lock counts as left behind.
LOCK_SECONDS = 6 * 3600
log = logging.getLogger(__name__)
FEATURES = "table_index int, table_name string, key_col_index int, key_col string, key string, feature_pos int, feature string, base_col string, value double"
NUMERIC = "table_index int, key_col_index int, key string, col_name string, count_ bigint, sum_ double, min_ double, max_ double, values_ array<double>"
TEXT = "table_index int, key_col_index int, key string, col_name string, category string, raw_count bigint"
META = "table_index int, table_name string, numeric_cols array<string>, cat_cols array<string>, key_columns array<string>, useful_columns array<string>, n_rows bigint, last_updated timestamp"
KINDS = {"features": FEATURES, "num_state": NUMERIC, "cat_state": TEXT, "meta": META}


@dataclass(frozen=True)
class IndexStats:
    """Size of an index."""

    rows: int
    tables: int
    size_bytes: int


@dataclass
class LakeIndex:
    """An index by name under the engine's root folder."""

    spark: SparkSession
    name: str
    config: EngineConfig = field(default_factory=EngineConfig.resolve)
    failed_tables: list[tuple[int, str, str]] = field(default_factory=list)

    def _at(self, kind: str) -> str:
        return f"{self.config.root.rstrip('/')}/{self.name}/{kind}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(self._at("features"))
        return bool(fs.exists(p))

    def drop(self, missing_ok: bool = True) -> None:
        if not missing_ok and not self.exists():
            raise FileNotFoundError(self.name)
        fs, p = self._fs(f"{self.config.root.rstrip('/')}/{self.name}")
        fs.delete(p, True)

    def read(self, kind: str) -> DataFrame:
        """One of the index's tables; an empty one if nothing was written. Columns that older files lack are null."""
        fs, p = self._fs(self._at(kind))
        if not fs.exists(p):
            return self.spark.createDataFrame([], KINDS[kind])
        return self.spark.read.schema(KINDS[kind]).parquet(self._at(kind))

    def _write(self, kind: str, df: DataFrame) -> None:
        """Replaces the partitions of the tables in ``df``."""
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_index")
        writer.parquet(self._at(kind))

    # -- building ---------------------------------------------------------------------------------------------------

    def build(self, path: str, max_workers: int = 4, max_cols: int = 100, key_columns: dict[str, list[str]] | None = None, prune: bool = False, shares: bool = False, update_support: bool = False, max_attempts: int = 2, exact_median: bool = True) -> list[int]:
        """Index all tables under ``path``; the indexes of those that went in.

        Jobs of several tables are submitted together, so small tables fill the cluster. A table that fails is tried
        ``max_attempts`` times, then listed in ``failed_tables``; the others go on.
        """
        self.failed_tables = []

        def one(source: TableSource) -> int | None:
            for attempt in range(max_attempts):
                try:
                    df = source.read(self.spark)
                    if too_wide(df, max_cols):
                        log.info("%s has more than %d columns, passed over", source.name, max_cols)
                        return None
                    self.add_table(df, source.table_index, source.name, (key_columns or {}).get(source.name), prune, shares, update_support, exact_median)
                    return source.table_index
                except Exception as e:
                    log.warning("%s, attempt %d: %s", source.name, attempt + 1, e)
                    reason = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
            self.failed_tables.append((source.table_index, source.name, reason))
            return None

        with ThreadPoolExecutor(max_workers) as pool:
            done = [i for i in pool.map(one, resolve_sources(self.spark, path)) if i is not None]
        self.failed_tables.sort()
        return done

    def add_table(self, df: DataFrame, table_index: int, table_name: str, key_columns: list[str] | None = None, prune: bool = False, shares: bool = False, update_support: bool = False, exact_median: bool = True) -> None:
        """Index one table, replacing what was known of it.

        Key columns: those given; with ``prune`` the key-like among the useful ones; else all. Features: of the useful
        and key columns if either is asked for, else of all.
        """
        df, numeric, text = split_types(with_clean_names(df))
        useful = feat.useful_columns(df) if prune or key_columns else numeric + text
        if key_columns is not None:
            from lakeseek.functions.text import normalize_text

            keys = [k for k in map(normalize_text, key_columns) if k in df.columns]
        elif prune:
            keys = [k for k in feat.key_candidates(df) if k in useful]
        else:
            keys = numeric + text
        used = [c for c in df.columns if c in {*useful, *keys}]
        numeric, text = [c for c in numeric if c in used], [c for c in text if c in used]
        parts = []
        for at, k in enumerate(keys):
            wide = feat.combined_features(df, k, numeric, text, shares, exact_median)
            if len(wide.columns) > 1:
                parts.append(feat.to_long(wide, table_index, table_name, at, k))
        if parts:
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            self._write("features", out)
        n = df.count()
        meta = self.spark.createDataFrame([(table_index, table_name, numeric, text, keys, useful, n)], META.replace(", last_updated timestamp", ""))
        self._write("meta", meta.withColumn("last_updated", F.current_timestamp()))
        if update_support:
            self._write_state(table_index, self._state(df, table_index, keys, numeric, text))

    def _state(self, df: DataFrame, table_index: int, keys: list[str], numeric: list[str], text: list[str]) -> dict[str, DataFrame | None]:
        def all_keys(make, columns):
            out = None
            for at, k in enumerate(keys):
                if others := [c for c in columns if c != k]:
                    part = make(df, k, others).select(F.lit(table_index).alias("table_index"), F.lit(at).alias("key_col_index"), "*")
                    out = part if out is None else out.unionByName(part)
            return out

        return {"num_state": all_keys(state.numeric_state, numeric), "cat_state": all_keys(state.text_state, text)}

    def _write_state(self, table_index: int, states: dict[str, DataFrame | None]) -> None:
        for kind, df in states.items():
            if df is not None:
                self._write(kind, df)

    # -- maintenance ------------------------------------------------------------------------------------------------

    def catalog(self) -> DataFrame:
        return self.read("meta").select("table_index", "table_name")

    @contextmanager
    def _locked(self, table: int) -> Iterator[None]:
        """Keeps other updates of the table away; a lock older than ``LOCK_SECONDS`` was left by a process that died."""
        lock = self._at(f"locks/{table}")
        for _ in range(2):
            staged = self._at(f"staged/{uuid.uuid4().hex}")
            fs, p = self._fs(staged)
            fs.mkdirs(p)
            if publish(self.spark, staged, lock):
                break
            fs, p = self._fs(lock)
            if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < LOCK_SECONDS:
                raise TableLocked(f"table {table} of {self.name} is being updated")
            fs.delete(p, True)
        else:
            raise TableLocked(f"table {table} of {self.name} is being updated")
        try:
            yield
        finally:
            delete(self.spark, lock)

    def _carry_over(self, table: int) -> None:
        """Finish a published update: replace the table's partitions by its sections, then note its id."""
        at = self._at(f"pending/{table}")
        if not exists(self.spark, at):
            return
        for kind in KINDS:
            if exists(self.spark, f"{at}/{kind}"):
                self._write(kind, self.spark.read.schema(KINDS[kind]).parquet(f"{at}/{kind}"))
        for delta in children(self.spark, f"{at}/delta"):
            fs, p = self._fs(self._at(f"applied/{table}/{delta}"))
            fs.mkdirs(p)
        delete(self.spark, at)

    def update_table(self, name: str, rows: DataFrame, delta: str | None = None) -> bool:
        """Add rows to a table: merge their state, derive the features again, replace the table's partitions.

        ``delta``: an id of these rows; a second update with it has no effect, so a run that died can be repeated. False if the
        table is unknown (or has no state) or there are no rows. Unknown columns are dropped with a warning. Raises
        ``TableLocked`` while another update of the table is under way.
        """
        found = resolve_tables(self.catalog(), [name])
        if len(found) != 1:
            return False
        with self._locked(found[0]):
            self._carry_over(found[0])
            if delta and exists(self.spark, self._at(f"applied/{found[0]}/{delta}")):
                return True
            staged = self._at(f"staged/{uuid.uuid4().hex}")
            if not self._stage_update(found, name, rows, staged):
                delete(self.spark, staged)
                return False
            fs, p = self._fs(f"{staged}/delta/{delta or uuid.uuid4().hex}")
            fs.mkdirs(p)
            publish(self.spark, staged, self._at(f"pending/{found[0]}"))
            self._carry_over(found[0])
        return True

    def _stage_update(self, found: list[int], name: str, rows: DataFrame, staged: str) -> bool:
        """Write the table's sections as they are with the new rows under ``staged``."""
        rows, _, _ = split_types(with_clean_names(rows))
        n = rows.count()
        if not n:
            return False
        meta = self.read("meta").where(F.col("table_index") == found[0]).first()
        known = {*meta["numeric_cols"], *meta["cat_cols"], *meta["key_columns"]}
        if unknown := [c for c in rows.columns if c not in known]:
            log.warning("%s: unknown columns %s are passed over", name, unknown)
        for c in known - set(rows.columns):
            rows = rows.withColumn(c, F.lit(None).cast("double" if c in meta["numeric_cols"] else "string"))
        delta = self._state(rows, found[0], meta["key_columns"], meta["numeric_cols"], meta["cat_cols"])
        by = {"num_state": ["table_index", "key_col_index", "key", "col_name"], "cat_state": ["table_index", "key_col_index", "key", "col_name", "category"]}
        merge = {"num_state": state.merge_numeric, "cat_state": state.merge_text}
        merged = {}
        for kind, d in delta.items():
            if d is not None:
                merge[kind]([self.read(kind).where(F.col("table_index") == found[0]), d], by[kind]).write.parquet(f"{staged}/{kind}")
            merged[kind] = None if d is None else self.spark.read.schema(KINDS[kind]).parquet(f"{staged}/{kind}")
        if all(d is None for d in merged.values()):
            return False
        parts = None
        for at, key_col in enumerate(meta["key_columns"]):
            pick = lambda d, at=at: None if d is None else d.where(F.col("key_col_index") == at)
            numeric = pick(merged["num_state"]) if any(c != key_col for c in meta["numeric_cols"]) else None
            text = pick(merged["cat_state"]) if any(c != key_col for c in meta["cat_cols"]) else None
            if numeric is None and text is None:
                continue
            long = state.derive(numeric, text).select(F.lit(found[0]).alias("table_index"), F.lit(meta["table_name"]).alias("table_name"), F.lit(at).alias("key_col_index"), F.lit(key_col).alias("key_col"), "key", F.lit(0).alias("feature_pos"), "feature", feat.base_column(F.col("feature")).alias("base_col"), "value")
            parts = long if parts is None else parts.unionByName(long)
        parts.write.parquet(f"{staged}/features")
        stamped = self.spark.createDataFrame([(*[meta[c] for c in ("table_index", "table_name", "numeric_cols", "cat_cols", "key_columns", "useful_columns")], meta["n_rows"] + n)], META.replace(", last_updated timestamp", ""))
        stamped.withColumn("last_updated", F.current_timestamp()).write.parquet(f"{staged}/meta")
        return True

    def update_lake(self, path: str) -> dict[str, bool]:
        """``update_table`` for every file under ``path``; names match with and without extension."""
        return {s.name: self.update_table(s.name, s.read(self.spark)) for s in resolve_sources(self.spark, path)}

    def rebuild_table(self, name: str, df: DataFrame, **options) -> bool:
        """Index a table anew from all its rows, under the same number; False if it is unknown."""
        found = resolve_tables(self.catalog(), [name])
        if len(found) != 1:
            return False
        full = self.catalog().where(F.col("table_index") == found[0]).first()["table_name"]
        self.add_table(df, found[0], full, **options)
        return True

    def find_union_peer(self, df: DataFrame, exclude: list[str] | None = None, min_cols: float = 0.5, threshold: float = 0.0) -> UnionPeer | None:
        """The lake table that holds most values of the table's columns, column by column."""
        df, numeric, text = split_types(with_clean_names(df))
        out = resolve_tables(self.catalog(), exclude) if exclude else []
        values = stacked_values(df, numeric + text)
        keys = self.read("features").select(*PAIR, "key").distinct()
        key_names = self.read("features").select(*PAIR, F.col("key_col").alias("r_col")).distinct()
        by_key = seek_keys(values, keys, out).join(key_names, PAIR).select("q_col", "table_index", "r_col", "overlap")
        by_text = seek_categories(values, self.read("cat_state"), out)
        top = by_key.unionByName(by_text).groupBy("q_col", "table_index", "r_col").agg(F.max("overlap").alias("overlap"))
        hits = [tuple(r) for r in top.orderBy(F.desc("overlap"), "table_index", "r_col", "q_col").limit(200).collect()]
        found = sorted({h[1] for h in hits})
        meta = self.read("meta").where(F.col("table_index").isin(found)) if found else None
        tables = {r["table_index"]: (r["table_name"], len(r["numeric_cols"]) + len(r["cat_cols"]), r["n_rows"]) for r in meta.collect()} if found else {}
        return find_union_peer(hits, tables, len(numeric) + len(text), df.count(), min_cols, threshold)

    def stats(self) -> IndexStats:
        row = self.read("features").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("table_index").alias("t")).first()
        fs, p = self._fs(f"{self.config.root.rstrip('/')}/{self.name}")
        return IndexStats(row["n"], row["t"], fs.getContentSummary(p).getLength() if fs.exists(p) else 0)

    def indexed_tables(self) -> DataFrame:
        """``table_index``, ``table_name``, features and keys of each table."""
        return self.read("features").groupBy("table_index", "table_name").agg(F.countDistinct("key_col_index", "feature").alias("features"), F.countDistinct("key").alias("keys"))
