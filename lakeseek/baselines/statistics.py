"""Rank correlation, information measures, label sketches and closed-form regressions over joined columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.baselines.set_search import md5_number


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks (nulls last, and without a rank).

    From counts per value: the ranks of ties come from the rows before the value. Distinct values are numbered in a
    range partitioning, so no task sorts a whole column.
    """
    from lakeseek.operators.sequence import number_rows
    from lakeseek.sources.shared import materialize

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ordered = materialize(number_rows(counts, ["__v"], "__seq"), "ranks")
    block = F.floor(F.col("__seq") / 65_536)
    ordered = ordered.withColumn("__block", block)
    totals = ordered.groupBy("__block").agg(F.sum("__n").alias("__b"))
    offset = totals.select("__block", F.coalesce(F.sum("__b").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy("__block").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ordered.withColumn("__in", F.coalesce(upto, F.lit(0))).join(offset, "__block")
    ranks = ranks.select("__v", (F.col("__before") + F.col("__in") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, df[column] == ranks["__v"], "left").drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rho``: the correlation of average ranks over rows where both are known."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_rank(average_rank(both, a, "__ra"), b, "__rb").agg(F.corr("__ra", "__rb").alias("rho"))


def onehot_correlations(df: DataFrame, category: str, target: str) -> DataFrame:
    """(category, n, corr): Pearson correlation of each value's indicator with the target, in closed form from counts."""
    rows = df.where(F.col(target).isNotNull()).select(F.col(category).alias("category"), F.col(target).cast("double").alias("y"))
    total = rows.agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    n, m, v = (total.select(c).scalar() for c in ("n", "m", "v"))
    per = rows.where(F.col("category").isNotNull()).groupBy("category").agg(F.count("y").alias("n"), F.avg("y").alias("avg"))
    p = F.col("n") / n
    return per.select("category", "n", (p * (F.col("avg") - m) / F.sqrt(p * (1 - p) * v)).alias("corr"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``mi`` in nats, from the counts of pairs of values."""
    c = contingency(df, a, b)
    total = c.agg(F.sum("n").cast("double").alias("t")).scalar()
    ca, cb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    p = F.col("n") / total
    return c.join(ca, "a").join(cb, "b").agg(F.sum(p * F.ln(F.col("n") * total / (F.col("na") * F.col("nb")))).alias("mi"))


def conditional_entropy(df: DataFrame, a: str, given: str) -> DataFrame:
    """One row ``h``: entropy of ``a`` given ``given``, in nats."""
    c = contingency(df, a, given)
    total = c.agg(F.sum("n").cast("double").alias("t")).scalar()
    cb = c.groupBy("b").agg(F.sum("n").alias("nb"))
    return c.join(cb, "b").agg((-F.sum(F.col("n") / total * F.ln(F.col("n") / F.col("nb")))).alias("h"))


def conditional_mutual_information(df: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """One row ``cmi``: what ``a`` and ``b`` share beyond ``given``, in nats."""
    rows = df.dropna(subset=[a, b, given]).groupBy(F.col(a).alias("a"), F.col(b).alias("b"), F.col(given).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").cast("double").alias("t")).scalar()
    ac, bc, c = (rows.groupBy(*k).agg(F.sum("n").alias(x)) for k, x in ((["a", "c"], "nac"), (["b", "c"], "nbc"), (["c"], "nc")))
    joined = rows.join(ac, ["a", "c"]).join(bc, ["b", "c"]).join(c, "c")
    return joined.agg(F.sum(F.col("n") / total * F.ln(F.col("n") * F.col("nc") / (F.col("nac") * F.col("nbc")))).alias("cmi"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row ``ratio``: the square root of the share of a number's variance that lies between categories."""
    rows = df.where(F.col(category).isNotNull() & F.col(value).isNotNull())
    per = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    overall = rows.agg(F.avg(value).alias("m")).scalar()
    between, within = F.sum(F.col("n") * (F.col("m") - overall) ** 2), F.sum(F.col("n") * F.col("v"))
    return per.agg(F.when(between + within > 0, F.sqrt(between / (between + within))).alias("ratio"))


def robust_dispersion(df: DataFrame, by: str, value: str) -> DataFrame:
    """(``by``, dispersion): the median absolute deviation over the absolute median; null for a median of 0."""
    medians = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.median(value).alias("__m"))
    rows = df.where(F.col(value).isNotNull()).join(medians, by)
    spread = rows.groupBy(by).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("d"), F.first("__m").alias("m"))
    return spread.select(by, F.when(F.col("m") != 0, F.col("d") / F.abs("m")).alias("dispersion"))


def equal_width_bin(c: Column, low: Column, high: Column, bins: int = 5) -> Column:
    """The number (from 0) of the bin of equal width."""
    return F.least(F.lit(bins - 1), F.floor((c - low) / F.when(high > low, high - low).otherwise(1.0) * bins)).cast("int")


def redundancy_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, relevance, redundancy, score): mutual information with the target, the mean with the other features,
    and their difference; numbers are binned before."""
    rows = []
    for f in features:
        rel = mutual_information(df, f, target).first()["mi"] or 0.0
        red = [mutual_information(df, f, g).first()["mi"] or 0.0 for g in features if g != f]
        rows.append((f, float(rel), float(sum(red) / len(red)) if red else 0.0))
    out = df.sparkSession.createDataFrame(rows, "feature string, relevance double, redundancy double")
    return out.withColumn("score", F.col("relevance") - F.col("redundancy"))


def label_sketch(df: DataFrame, key: str, value: str, size: int = 512) -> DataFrame:
    """(key, side): of the keys with the ``size`` smallest md5 whether their mean value lies above (1) or below (-1) the
    mean of all keys' means; keys exactly at the mean have 0."""
    per_key = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.avg(value).alias("m"))
    overall = per_key.agg(F.avg("m").alias("a"))
    return per_key.withColumn("h", md5_number(F.col("key"))).withColumn("side", F.signum(F.col("m") - overall.scalar()).cast("int")).orderBy("h", "key").limit(size).select("key", "side")


def label_hits(query: DataFrame, sketches: DataFrame, by: list[str]) -> DataFrame:
    """Per sketch: keys met, with the same side, with the opposite, and the greater share: (by, met, same, opposite, score)."""
    j = sketches.join(query.select("key", F.col("side").alias("q_side")), "key")
    agg = j.groupBy(*by).agg(F.count(F.lit(1)).alias("met"), F.sum((F.col("side") * F.col("q_side") > 0).cast("int")).alias("same"), F.sum((F.col("side") * F.col("q_side") < 0).cast("int")).alias("opposite"))
    return agg.withColumn("score", F.greatest("same", "opposite") / F.greatest("met", F.lit(1)))


def best_r2(query: DataFrame, key: str, target: str, features: DataFrame) -> DataFrame:
    """(table_index, key_col_index, feature, n, r2): R squared of the target on each single feature over joined rows.

    Query rows are reduced per key first; all candidates go through one join and one aggregate.
    """
    per = query.where(F.col(target).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("y"), F.sum(F.col(target).cast("double") ** 2).alias("yy"))
    n, x = F.col("n"), F.col("value")
    s = features.join(per, "key").groupBy("table_index", "key_col_index", "feature").agg(F.sum(n).alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy"), F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"), F.sum(F.col("y") * x).alias("xy"))
    sxy, sxx, syy = (F.col(a) - F.col(b) * F.col(c) / n for a, b, c in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    # A spread that is nothing but rounding belongs to a constant.
    varies = (sxx > 1e-12 * F.abs("xx")) & (syy > 1e-12 * F.abs("yy"))
    return s.select("table_index", "key_col_index", "feature", "n", F.when(varies, sxy * sxy / (sxx * syy)).alias("r2"))
