"""Per-key aggregates of a lake table: the features that may be joined to a query table.

``key`` is a column of the table; its normalised text is the key of the features. All functions take rows with a null
key out, treat null key groups as absent, and give an empty table for an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.functions.text import base_column, stored_key
from lakeseek.operators.sequence import number_rows
from lakeseek.operators.skew import HotGroups
from lakeseek.sources.shared import materialize

AGGREGATES = ("mean", "median", "max", "min")
#: Rows from which the median of a key isn't taken in one task.
HOT_ROWS = 5_000_000
# Parts of names of columns that hold prose or identifiers rather than join keys.
PROSE = ["desc", "text", "comment", "remark", "note", "memo", "content", "message", "feedback", "log", "msg"]
IDENTIFIERS = ["uuid", "guid", "key", "code", "ref", "hash", "token", "identifier", "unnamed"]


def _median(c: Column, exact: bool) -> Column:
    return F.median(c) if exact else F.percentile_approx(c, 0.5, 10_000).cast("double")


def _size(df: DataFrame) -> int:
    """Spark's estimate of the bytes that ``df`` reads, without a job. A key of n different values takes at least n bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def numeric_features(df: DataFrame, key: str, columns: list[str], exact_median: bool = True) -> DataFrame:
    """``key`` and ``<column>_mean, _median, _max, _min``; nulls count as the column's mean over rows with a key.

    An exact median keeps a key's distinct values in memory. Keys of more than ``HOT_ROWS`` rows get theirs from a
    numbering of all their values over a range partitioning instead, so no task holds a whole key; a table of fewer bytes
    than that has no such key and isn't counted. ``exact_median=False``
    takes a sketch for all keys, in one pass.
    """
    named = {f"v{i}": c for i, c in enumerate(columns)}  # a column may be called key
    rows = df.where(F.col(key).isNotNull()).select(stored_key(F.col(key)).alias("key"), *[F.col(f"`{c}`").cast("double").alias(v) for v, c in named.items()])
    means = rows.agg(*[F.avg(v).alias(v) for v in named])
    rows = rows.withColumns({v: F.coalesce(F.col(v), means.select(v).scalar()) for v in named})
    fns = {"mean": F.avg, "median": lambda v: _median(F.col(v), exact_median), "max": F.max, "min": F.min}
    aggs = {f"{c}_{a}": (fns[a], v) for v, c in named.items() for a in AGGREGATES}
    counted = exact_median and _size(df) >= HOT_ROWS
    hot = HotGroups(df.where(F.col(key).isNotNull()).select(stored_key(F.col(key)).alias("key")), ["key"], HOT_ROWS) if counted else None
    if hot is None or hot.empty:
        return rows.groupBy("key").agg(*[f(v).alias(n) for n, (f, v) in aggs.items()])
    cold = hot.cold(rows).groupBy("key").agg(*[f(v).alias(n) for n, (f, v) in aggs.items()])
    large = hot.hot(rows)
    rest = large.groupBy("key").agg(*[f(v).alias(n) for n, (f, v) in aggs.items() if not n.endswith("_median")])
    for v, c in named.items():
        rest = rest.join(numbered_medians(large, "key", v).withColumnRenamed("median", f"{c}_median"), "key", "left")
    return cold.unionByName(rest)


def numbered_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``median``, exact, for few keys of any size: all rows numbered by (key, value), then the middle ones."""
    rows = number_rows(df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("v")), ["key", "v"])
    ends = rows.groupBy("key").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    middle = F.col("seq").isin(F.floor((F.col("first") + F.col("last")) / 2), F.ceil((F.col("first") + F.col("last")) / 2))
    return rows.join(ends, "key").where(middle).groupBy("key").agg(F.avg("v").alias("median"))


def text_features(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and ``<column>_mean, _max, _nunique`` of the counts of a key's values.

    With r the counts of the distinct values of a key and N the distinct values of the column: mean is sum(r) / N^2,
    max is max(r) / N, nunique is the number of different counts. Nulls count as the column's mode (the smaller one).
    All columns go through one shuffle: they are stacked first.
    """
    rows = df.where(F.col(key).isNotNull()).select(stored_key(F.col(key)).alias("key"), *[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(columns)])
    stats = rows.agg(*[F.mode(f"v{i}", True).alias(f"v{i}") for i in range(len(columns))])
    filled = [F.coalesce(F.col(f"v{i}"), stats.select(f"v{i}").scalar()) for i in range(len(columns))]
    stacked = rows.select("key", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in zip(columns, filled, strict=True)])).alias("s")).select("key", "s.*")
    counts = stacked.where(F.col("value").isNotNull()).groupBy("key", "col", "value").agg(F.count(F.lit(1)).alias("r"))
    distinct = counts.select("col", "value").distinct().groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    per_key = counts.groupBy("key", "col").agg(F.sum("r").alias("s"), F.max("r").alias("x"), F.countDistinct("r").alias("u")).join(F.broadcast(distinct), "col")
    value = {"mean": F.col("s") / (F.col("n") * F.col("n")), "max": F.col("x") / F.col("n"), "nunique": F.col("u").cast("double")}
    picked = [F.max(F.when(F.col("col") == c, v)).alias(f"{c}_{a}") for c in columns for a, v in value.items()]
    return per_key.groupBy("key").agg(*picked)


def top_values(df: DataFrame, column: str, m: int, min_coverage: float) -> list[str]:
    """The ``m`` most frequent values (then the smaller), if they cover that share of all rows; else none.

    If they cover all rows the most frequent is left out, as its share follows from the others.
    """
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("v").isNotNull()).orderBy(F.desc("n"), "v").limit(m).collect()
    total = df.count()
    covered = sum(r["n"] for r in top)
    if not total or covered < min_coverage * total:
        return []
    return [r["v"] for r in (top[1:] if covered == total else top)]


def share_names(column: str, values: list[str]) -> list[str]:
    """``<column>_<value>_share``; empty and clashing value names get their rank."""
    from lakeseek.functions.text import normalize_text

    out: list[str] = []
    for at, v in enumerate(values, 1):
        name = normalize_text(v) or f"value{at}"
        out.append(f"{name}{at}" if name in out else name)
    return [f"{column}_{n}_share" for n in out]


def category_shares(df: DataFrame, key: str, columns: list[str], m: int = 5, min_coverage: float = 0.8) -> DataFrame:
    """``key`` and the share of the key's rows that hold each top value; nulls stay in the denominator."""
    rows = df.where(F.col(key).isNotNull())
    aggs = []
    for c in columns:
        values = top_values(rows, c, m, min_coverage)
        for name, v in zip(share_names(c, values), values, strict=True):
            aggs.append(F.avg(F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("double"), F.lit(0.0))).alias(name))
    keyed = rows.groupBy(stored_key(F.col(key)).alias("key"))
    return keyed.agg(*aggs) if aggs else keyed.agg(F.count(F.lit(1)).alias("n")).drop("n")


def fill_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of numeric columns as the column's mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means.select(c).scalar()) for c in columns})


def fill_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of text columns as the column's most frequent value, the smaller of several."""
    modes = df.agg(*[F.mode(c, True).alias(c) for c in columns])
    return df.withColumns({c: F.coalesce(F.col(c), modes.select(c).scalar()) for c in columns})


def _column_facts(features: DataFrame, key: str, columns: list[str]) -> dict[str, tuple[int | None, bool]]:
    """Per column a hash of all its (key, value) pairs, in which row order plays no part, and whether it is constant.

    A column whose values all lie on one side of their mean, or on it, has equal values throughout, so its ends meet.
    One aggregate serves all columns.
    """
    hashed = [F.expr(f"bit_xor(xxhash64(`{key}`, `{c}`))").alias(f"h{i}") for i, c in enumerate(columns)]
    ends = [(F.min(f"`{c}`") == F.max(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]
    row = features.agg(*hashed, *ends).first() if columns else {}
    return {c: (row[f"h{i}"], row[f"c{i}"] is not False) for i, c in enumerate(columns)}


def duplicate_columns(features: DataFrame, key: str, columns: list[str]) -> list[list[str]]:
    """Classes of columns with equal values at every key."""
    classes: dict[object, list[str]] = {}
    for c, (h, _) in _column_facts(features, key, columns).items():
        classes.setdefault(h, []).append(c)
    return list(classes.values())


def constant_columns(features: DataFrame, columns: list[str]) -> list[str]:
    """Columns without two different values."""
    return [c for c, (_, constant) in _column_facts(features, columns[0] if columns else "", columns).items() if constant]


def combined_features(df: DataFrame, key: str, numeric: list[str], text: list[str], shares: bool = False, exact_median: bool = True) -> DataFrame:
    """Numeric and text features of a key in one row, without repeated and constant columns.

    Of equal columns the last stays, in the place of the first.
    """
    numeric, text = [c for c in numeric if c != key], [c for c in text if c != key]
    out = numeric_features(df, key, numeric, exact_median) if numeric else None
    if text:
        counted = text_features(df, key, text)
        if shares:
            counted = counted.join(category_shares(df, key, text), "key", "left")
        out = counted if out is None else out.join(counted, "key")
    if out is None:
        return df.where(F.col(key).isNotNull()).select(stored_key(F.col(key)).alias("key")).distinct()
    out = materialize(out, "features")  # read again by the caller, after the columns are judged
    classes: dict[object, list[str]] = {}
    for c, (h, constant) in _column_facts(out, "key", [c for c in out.columns if c != "key"]).items():
        if not constant:
            classes.setdefault(h, []).append(c)
    return out.select("key", *[group[-1] for group in classes.values()])


def to_long(features: DataFrame, table_index: int, table_name: str, key_col_index: int, key_col: str) -> DataFrame:
    """One row a key and feature: the form in which features are stored and searched."""
    columns = [c for c in features.columns if c != "key"]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature_pos"), F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)]))
    long = features.select("key", cells.alias("f")).select("key", "f.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.select(
        F.lit(table_index).alias("table_index"),
        F.lit(table_name).alias("table_name"),
        F.lit(key_col_index).alias("key_col_index"),
        F.lit(key_col).alias("key_col"),
        "key",
        "feature_pos",
        "feature",
        base_column(F.col("feature")).alias("base_col"),
        "value",
    )


def column_stats(df: DataFrame) -> DataFrame:
    """Per column: ``column``, ``rows``, ``nulls``, ``uniq``, ``top`` (count of the top value), ``avg_len``.

    One pass: cells are stacked as text, counted per value with map-side aggregation, then summed up per column.
    """
    fields = [f for f in df.schema if isinstance(f.dataType, (T.AtomicType, T.NullType)) and not isinstance(f.dataType, T.BinaryType)]
    cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("v")) for f in fields]))
    counts = df.select(cells.alias("c")).select("c.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("v").isNotNull()
    return counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("nulls"),
        F.sum(F.when(known, 1).otherwise(0)).alias("uniq"),
        F.max(F.when(known, F.col("n"))).alias("top"),
        F.min(F.when(known, F.col("n"))).alias("least"),
        (F.sum(F.when(known, F.length("v") * F.col("n"))) / F.sum(F.when(known, F.col("n")))).alias("avg_len"),
    )


def useful_columns(df: DataFrame, null_share: float = 0.8, unique_share: float = 0.8, top_share: float = 0.99, text_length: float = 100, bool_share: float = 0.01) -> list[str]:
    """Columns worth indexing: not mostly null, unique, constant or prose; booleans with both values in use."""
    stats = {r["column"]: r for r in column_stats(df).collect()}
    out = []
    for f in df.schema:
        s = stats.get(f.name)
        if s is None or s["rows"] == s["nulls"] or s["nulls"] / s["rows"] > null_share:
            continue
        filled = s["rows"] - s["nulls"]
        if s["uniq"] / filled > unique_share or s["top"] / filled > top_share:
            continue
        if isinstance(f.dataType, T.StringType) and s["avg_len"] > text_length:
            continue
        if isinstance(f.dataType, T.BooleanType) and s["least"] / filled < bool_share:
            continue
        out.append(f.name)
    return out


def key_candidates(df: DataFrame) -> list[str]:
    """Columns that may be join keys: some value, more than one, and no name of prose or of an identifier."""
    stats = {r["column"]: r for r in column_stats(df).collect()}
    named = lambda c: any(t in c.lower() for t in PROSE + IDENTIFIERS) or c.startswith("id") or c.endswith("id")
    distinct = lambda s: s["uniq"] + (s["nulls"] > 0)
    return [c for c in df.columns if (s := stats.get(c)) and s["nulls"] < s["rows"] and distinct(s) > 1 and not named(c)]
