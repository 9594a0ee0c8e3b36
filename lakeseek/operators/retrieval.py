"""Finding joinable tables and dropping weak features, on the long form of the features.

``features``: table_index, key_col_index, key, feature, base_col, value and more (``features.to_long``). ``query``: key and
target columns. Nothing is broadcast by hand but results of at most k rows; Spark broadcasts what it measures as small.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions.text import normalize_text
from lakeseek.operators.materialize import pivot_features

PAIR = ["table_index", "key_col_index"]


def lake_keys(features: DataFrame) -> DataFrame:
    """The inverted index: distinct (table_index, key_col_index, key)."""
    return features.select(*PAIR, "key").distinct()


def overlap_topk(keys: DataFrame, query: DataFrame, k: int, key: str = "key", exclude: list[int] | None = None) -> DataFrame:
    """The ``k`` (table, key column) pairs that share most distinct keys with the query: ``n`` and ``ratio``.

    Ties go to the smaller ids. Null query keys match nothing; an empty query gives no pair.
    """
    asked = query.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
    if exclude:
        keys = keys.where(~F.col("table_index").isin(exclude))
    hits = keys.join(asked, "key").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    total = asked.agg(F.count(F.lit(1)).alias("n"))
    return hits.orderBy(F.desc("n"), *PAIR).limit(k).withColumn("ratio", F.col("n") / total.scalar())


def overlap_topk_many(keys: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``overlap_topk`` for each ``query_id`` of ``queries`` (query_id, key): query_id, the pair, ``n`` and ``ratio``."""
    asked = queries.where(F.col("key").isNotNull()).select("query_id", F.col("key").cast("string").alias("key")).distinct()
    hits = keys.join(asked, "key").groupBy("query_id", *PAIR).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), *PAIR))
    total = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    top = hits.withColumn("rank", rank).where(F.col("rank") <= k).join(total, "query_id")
    return top.select("query_id", *PAIR, "n", (F.col("n") / F.col("total")).alias("ratio"))


def fetch(features: DataFrame, hits: DataFrame, query: DataFrame, key: str = "key") -> DataFrame:
    """The features of the hit pairs at the query's keys; ``hits`` has at most k rows and is broadcast."""
    asked = query.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
    return features.join(F.broadcast(hits.select(*PAIR)), PAIR, "left_semi").join(asked, "key", "left_semi")


def _same_side(query: DataFrame, features: DataFrame, key: str, target: str) -> tuple[DataFrame, list[str]]:
    """Matched keys with the sides of query target and feature value: ``q`` and ``x``, each -1, 0 or 1."""
    group = [*PAIR, "feature"]
    per_key = query.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.avg(target).alias("y"))
    means = features.groupBy(*group).agg(F.avg("value").alias("mean"))
    matched = features.join(per_key, "key")
    y_means = matched.groupBy(*group).agg(F.avg("y").alias("y_mean"))
    # Few groups: a row a feature. The joins are on feature ids, so Spark broadcasts them.
    both = matched.join(means, group).join(y_means, group)
    return both.select(*group, "key", F.signum(F.col("y") - F.col("y_mean")).alias("q"), F.signum(F.col("value") - F.col("mean")).alias("x")), group


def side_scores(features: DataFrame, query: DataFrame, key: str, target: str, mode: str = "abs") -> DataFrame:
    """Per feature the share of matched keys where target and value lie on the same side of their means.

    ``mode='reference'``: equality of the three-valued sides, which never lets an opposed feature pass. ``abs``: the
    greater of the share and its complement, over keys where neither side is 0.
    """
    sides, group = _same_side(query, features, key, target)
    same = (F.col("q") == F.col("x")).cast("double")
    if mode == "reference":
        return sides.groupBy(*group).agg(F.avg(same).alias("score"), F.count(F.lit(1)).alias("matched"))
    decided = (F.col("q") != 0) & (F.col("x") != 0)
    p = F.avg(F.when(decided, same))
    scored = sides.groupBy(*group).agg(p.alias("p"), F.count(F.lit(1)).alias("matched"))
    return scored.select(*group, F.coalesce(F.greatest(F.col("p"), 1 - F.col("p")), F.lit(0.0)).alias("score"), "matched")


def eta_squared(features: DataFrame, query: DataFrame, key: str, target: str) -> DataFrame:
    """Per feature the share of its variance between the classes of ``target``; a constant feature gives 0.

    Query rows without a match keep their place in the sizes of the classes; means and total ignore them.
    """
    group = [*PAIR, "feature"]
    rows = query.groupBy(F.col(key).cast("string").alias("key"), F.col(target).alias("c")).agg(F.count(F.lit(1)).alias("w"))
    sizes = rows.groupBy("c").agg(F.sum("w").alias("size"))
    x, w = F.col("value"), F.col("w")
    stats = rows.join(features.select(*group, "key", "value"), "key").groupBy(*group, "c").agg(F.sum(w).alias("n"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("ss"))
    of_feature = Window.partitionBy(*group)  # a row a class
    between = stats.withColumns({f"t{c}": F.sum(c).over(of_feature) for c in ("n", "s", "ss")}).join(sizes, "c")
    gap = F.col("s") / F.col("n") - F.col("ts") / F.col("tn")
    spread = F.col("tss") - F.col("ts") * F.col("ts") / F.col("tn")
    marked = between.withColumns({"gap": gap, "spread": F.when(spread > 1e-12 * F.abs(F.col("tss")), spread)})
    eta = F.sum(F.col("size") * F.col("gap") * F.col("gap")) / F.first("spread")
    return marked.groupBy(*group).agg(F.coalesce(eta, F.lit(0.0)).alias("score"))


def prune(features: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """The features whose score exceeds the threshold; NaN never does."""
    kept = scores.where(~F.isnan("score") & (F.col("score") > threshold)).select(*PAIR, "feature")
    return features.join(kept, [*PAIR, "feature"], "left_semi")


def prune_reference(features: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """The masks as they were first defined: only pairs with passing and failing features survive, by their passing ones;
    if no pair is mixed, nothing is pruned."""
    passed = (F.col("score") > threshold) & ~F.isnan("score")
    marked = scores.withColumn("passed", passed)
    pairs = marked.groupBy(*PAIR).agg(F.bool_or("passed").alias("some"), F.bool_and("passed").alias("every"))
    mixed = pairs.where(F.col("some") & ~F.col("every"))
    if mixed.isEmpty():
        return features
    kept = marked.where("passed").join(mixed, PAIR, "left_semi").select(*PAIR, "feature")
    return features.join(kept, [*PAIR, "feature"], "left_semi")


def small_groups_out(features: DataFrame, more_than: int = 2) -> DataFrame:
    """Only (table, key column) pairs with more than so many features."""
    kept = features.select(*PAIR, "feature").distinct().groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return features.join(kept, PAIR, "left_semi")


_EXTENSIONS = (".parquet", ".csv", ".tsv", ".gz")


def _name_variants(name: str) -> set[str]:
    """A table's full name and its base name, each with and without extensions, normalised for comparison."""
    out = set()
    for n in (name, name.rsplit("/", 1)[-1]):
        out.add(n.lower())
        while n.lower().endswith(_EXTENSIONS):
            n = n.rsplit(".", 1)[0]
            out.add(n.lower())
    return out


def resolve_tables(catalog: DataFrame, names: list[str]) -> list[int]:
    """table_index of the named tables, by full name, base name or either without extension.

    A base name that several tables share excludes all of them. Unknown names warn. The catalog is read once; it has
    one small row a table.
    """
    asked = {n: _name_variants(n) for n in names}
    wanted = set().union(*asked.values()) if asked else set()
    base = F.lower(F.substring_index("table_name", "/", -1))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.gz$", ""), r"\.(parquet|csv|tsv)$", "")
    full = F.lower("table_name")
    variants = F.array(full, bare(full), base, bare(base))
    rows = catalog.select("table_index", "table_name").distinct().where(F.arrays_overlap(variants, F.array(*map(F.lit, sorted(wanted or {""}))))).collect()
    known = [(r["table_index"], _name_variants(r["table_name"])) for r in rows]
    out: set[int] = set()
    for n, v in asked.items():
        exact = [i for i, k in known if n.lower() in k]
        found = exact or [i for i, k in known if v & k]
        if not found:
            warnings.warn(f"table {n!r} is not in the lake", RuntimeWarning, stacklevel=2)
        out.update(found)
    return sorted(out)


def stop_features(features: DataFrame, stop: dict[str, list[str]]) -> DataFrame:
    """Without all aggregates of the named columns of the named tables; pairs with nothing left vanish."""
    if not stop:
        return features
    if "base_col" not in features.columns or "table_name" not in features.columns:
        raise ValueError("features have no column names; rebuild the index with names")
    cond: Column = F.lit(False)
    name = F.lower("table_name")
    for table, columns in stop.items():
        columns = [columns] if isinstance(columns, str) else list(columns)
        variants = sorted(_name_variants(table))
        base = F.substring_index(name, "/", -1)
        bare = F.regexp_replace(F.regexp_replace(base, r"\.gz$", ""), r"\.(parquet|csv|tsv)$", "")
        stems = [normalize_text(c) for c in columns]
        hit = (name.isin(variants) | base.isin(variants) | bare.isin(variants)) & F.col("base_col").isin([*columns, *stems])
        cond = cond | hit
    return features.where(~cond)


def pad_missing(features: DataFrame, query: DataFrame, key: str = "key") -> DataFrame:
    """One value of every feature at every query key; keys it lacks get its mean over the matched keys.

    The features of the hit pairs are columns of one row a key meanwhile, so no grid of keys and features is joined.
    """
    group = [*PAIR, "feature"]
    asked = query.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
    matched = features.join(asked, "key", "left_semi").select(*group, "key", "value")
    known = [tuple(r) for r in matched.select(*group).distinct().orderBy(*group).collect()]
    if not known:
        return matched
    names = [f"f{i}" for i in range(len(known))]
    wide = pivot_features(matched, known, names)
    means = wide.agg(*[F.avg(n).alias(n) for n in names]).first()
    full = asked.join(wide, "key", "left").withColumns({n: F.coalesce(n, F.lit(means[n])) for n in names})
    cells = [F.struct(F.lit(t).alias("table_index"), F.lit(k).alias("key_col_index"), F.lit(f).alias("feature"), F.col(n).alias("value")) for (t, k, f), n in zip(known, names, strict=True)]
    return full.select("key", F.explode(F.array(*cells)).alias("c")).select("c.table_index", "c.key_col_index", "c.feature", "key", "c.value")


def sample_per_class(query: DataFrame, key: str, target: str, order: str, most: int = 1024) -> DataFrame:
    """A proportional sample of about ``most`` rows over (key, target): round(share x most), at least 1, of each."""
    w = Window.partitionBy(key, target)
    total = query.agg(F.count(F.lit(1)).alias("n"))
    share = F.count(F.lit(1)).over(w) / total.scalar()
    ranked = query.withColumns({"__take": F.greatest(F.lit(1), F.round(share * most)), "__at": F.row_number().over(w.orderBy(F.md5(F.col(order).cast("string")), order))})
    return ranked.where((total.scalar() <= most) | (F.col("__at") <= F.col("__take"))).drop("__take", "__at")
