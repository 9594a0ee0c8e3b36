"""Percentiles of very large numeric columns, by deterministic collapsing of weighted sorted buffers.

A state is ``(n, w, err, buf, low, high)``: ``buf`` holds at most ``k`` sorted values that stand for ``w`` values each,
``n`` is the exact number of values, ``low`` and ``high`` their exact ends, and ``err`` bounds how far the rank that the
buffer gives to any value can lie from its true rank. COLLAPSE lays the buffers out as one sorted weighted sequence of
total weight S, sets W = ceil(S / k) and keeps the values at the evenly spaced places c, c + W, c + 2 W ... with
c = ceil(W / 2); that moves no rank by more than floor(W / 2), so ``err`` of a result is the sum over the collapsed
states plus floor(W / 2). States are merged along a tree of fan-in ``fan_in``; each level adds at most n / 2k, so
``err <= n * levels / 2k``. States of other days, tables or clusters merge the same way.

All steps are JVM expressions. A group of any size is split over leaves of about ``leaf_values`` values before it is
gathered, so no task holds more than that (or the values of one row), plus ``fan_in`` buffers of ``k`` values.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.operators.skew import HotGroups
from lakeseek.sources.shared import materialize

#: Values with a larger amount are sentinels, not values.
SENTINEL = 1e17
#: Values that are sorted together.
LEAF_VALUES = 16_384
#: States that are merged together.
FAN_IN = 64
STATE = ["n", "w", "err", "buf", "low", "high"]


def valid_values(values: Column) -> Column:
    """The array without null, NaN, infinite and sentinel entries; a null array gives an empty one."""
    kept = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= SENTINEL))
    return F.coalesce(kept, F.array().cast("array<double>"))


def _from_values(gathered: DataFrame, keys: list[str], values: str, k: int) -> DataFrame:
    """States of rows that each hold all values of a leaf; their weight is 1, so one stride gives the places."""
    n, w = F.size("__v").cast("bigint"), F.ceil(F.size("__v") / F.lit(float(k))).cast("bigint")
    df = gathered.withColumn("__v", F.sort_array(values)).where(F.size("__v") > 0).withColumns({"n": n, "w": w})
    places = F.sequence(F.floor((F.col("w") + 1) / 2), F.col("n"), F.col("w"))
    return df.select(
        *keys,
        "n",
        "w",
        F.floor(F.col("w") / 2).alias("err"),
        F.when(F.col("w") == 1, F.col("__v")).otherwise(F.transform(places, lambda i: F.element_at("__v", i.cast("int")))).alias("buf"),
        F.element_at("__v", 1).alias("low"),
        F.element_at("__v", -1).alias("high"),
    )


def merge_states(states: DataFrame, keys: list[str], k: int = 1024) -> DataFrame:
    """COLLAPSE all states of equal ``keys`` into one; one shuffle on ``keys``.

    The states of a group must be few (a level of the tree, or a number of days); use ``sketch`` for raw values.
    Null keys form a group. An empty table gives an empty one.
    """
    df = states.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("err").alias("err"),
        F.collect_list(F.struct("w", "buf")).alias("__b"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    df = df.withColumn("__s", F.aggregate("__b", F.lit(0).cast("bigint"), lambda a, b: a + b["w"] * F.size(b["buf"])))
    df = df.withColumn("w", F.ceil(F.col("__s") / F.lit(float(k))).cast("bigint"))
    df = df.withColumn("__i", F.sort_array(F.flatten(F.transform("__b", lambda b: F.transform(b["buf"], lambda v: F.struct(v.alias("v"), b["w"].alias("w")))))))
    # floor((cum - c + W) / W) counts the places up to cum; a value is kept where its weight takes in the next place.
    shift = F.col("w") - F.floor((F.col("w") + 1) / 2)
    upto = lambda cum: F.floor((cum + shift) / F.col("w"))
    zero = F.struct(F.lit(0).cast("bigint").alias("cum"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cum = acc["cum"] + x["w"]
        kept = F.when(upto(cum) > upto(acc["cum"]), F.array_append(acc["out"], x["v"])).otherwise(acc["out"])
        return F.struct(cum.alias("cum"), kept.alias("out"))

    picked = F.aggregate("__i", zero, step, lambda a: a["out"])
    return df.select(
        *keys,
        "n",
        "w",
        (F.col("err") + F.when(F.size("__b") > 1, F.floor(F.col("w") / 2)).otherwise(0)).cast("bigint").alias("err"),
        F.when(F.size("__b") == 1, F.element_at("__b", 1)["buf"]).when(F.col("w") == 1, F.transform("__i", lambda x: x["v"])).otherwise(picked).alias("buf"),
        "low",
        "high",
        F.when(F.size("__b") == 1, F.element_at("__b", 1)["w"]).otherwise(F.col("w")).alias("__w"),
    ).drop("w").withColumnRenamed("__w", "w").select(*keys, *STATE)


def _climb(states: DataFrame, keys: list[str], leaves: int, k: int, fan_in: int) -> DataFrame:
    """Merges states with ``__leaf`` below ``leaves`` along the tree, until each group of ``keys`` has one."""
    while leaves > 1:
        leaves = ceil(leaves / fan_in)
        states = merge_states(states.withColumn("__leaf", F.floor(F.col("__leaf") / fan_in)), [*keys, "__leaf"], k)
    return states.drop("__leaf")


def combine(states: DataFrame, keys: list[str], parts: list[str], k: int = 1024, fan_in: int = FAN_IN) -> DataFrame:
    """One state for every group of ``keys`` of states that were made apart, for example by day or table.

    ``parts``: columns that tell the states of a group apart. Groups of more than ``fan_in`` states are merged along the
    tree, so no task holds more than about ``fan_in`` of them. Null keys form a group. Empty in, empty out.
    """
    named = states.select(*keys, *[F.col(c).alias(f"__part{i}") for i, c in enumerate(parts)], *STATE)
    hot = HotGroups(named.select(*keys), keys, fan_in)
    if hot.empty:
        return merge_states(named, keys, k)
    most = hot.table.agg(F.max("__size")).first()[0]
    leaf = F.pmod(F.xxhash64(*[f"__part{i}" for i in range(len(parts))]), F.col("__size_of_group"))
    named = hot.sized(named, "__size_of_group").withColumn("__leaf", F.coalesce(leaf, F.lit(0).cast("bigint"))).drop("__size_of_group")
    return _climb(named, keys, most, k, fan_in)


def sketch(df: DataFrame, keys: list[str], values: str, row: list[str] | None = None, k: int = 1024, leaf_values: int = LEAF_VALUES, fan_in: int = FAN_IN) -> DataFrame:
    """One state for every group of ``keys`` over all entries of the array column ``values``.

    ``row``: columns that, with ``keys`` and ``values``, identify a row; rows equal in all of them count once. None
    counts every row. Groups of more than ``leaf_values`` entries are split over leaves by a hash of the row, so a copy of
    a row meets it in its leaf and one shuffle serves both deduplication and gathering.

    Null keys form a group; null, NaN, infinite and sentinel entries are left out; a group without any value gives no
    state; an empty table gives no state. Other columns of ``df`` are ignored, whatever their names; ``keys`` named like
    columns of a state raise ``ValueError``.
    """
    if taken := sorted(set(keys) & set(STATE)):
        raise ValueError(f"keys can't be named like columns of a state: {taken}")
    ident = [c for c in (row or []) if c not in keys]
    rows = df.select(*keys, *ident, F.col(values).alias("__values"))
    # At least 1 a row, as empty arrays take room as well.
    hot = HotGroups(rows.select(*keys, "__values"), keys, leaf_values, weight=F.greatest(F.size("__values"), F.lit(1)))
    leaf = [] if hot.empty else ["__leaf"]  # a constant leaf would hide from Spark that one shuffle serves all
    if leaf:
        leaves = F.ceil(F.col("__size_of_group") / F.lit(float(leaf_values))).cast("bigint")
        spread = F.xxhash64(*ident, "__values") if ident else F.xxhash64("__values", F.monotonically_increasing_id())
        rows = hot.sized(rows, "__size_of_group").withColumn("__leaf", F.when(F.col("__size_of_group").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(spread, leaves))).drop("__size_of_group")
    rows = rows.repartition(*keys, *leaf)
    if row is not None:
        rows = rows.distinct()
    leafed = rows.withColumn("__values", valid_values(F.col("__values"))).groupBy(*keys, *leaf).agg(F.flatten(F.collect_list("__values")).alias("__all"))
    states = _from_values(leafed, [*keys, *leaf], "__all", k)
    if hot.empty:
        return states
    return _climb(states, keys, ceil(hot.table.agg(F.max("__size")).first()[0] / leaf_values), k, fan_in)


def bracket(q: float) -> tuple[Column, Column, Column]:
    """For a state: the value at place ceil(q n) lies between the first two columns; the third estimates it.

    The first two are equal where the state is exact. Place ceil(q n) is worked out on decimals, so 0.9 of 10 is 9.
    """
    n, w, err, buf = (F.col(c) for c in ("n", "w", "err", "buf"))
    r = place(q)
    below = F.floor((r - 1 - err) / w) + 1
    above = F.ceil((r + err) / w)
    low = F.when(r - 1 - err < 0, F.col("low")).otherwise(F.element_at(buf, F.least(below, F.size(buf)).cast("int")))
    high = F.when(above > F.size(buf), F.col("high")).otherwise(F.element_at(buf, above.cast("int")))
    middle = F.element_at(buf, F.least(F.ceil(r / w), F.size(buf)).cast("int"))
    return low, high, middle


def place(q: float, n: str = "n") -> Column:
    """ceil(q * n), at least 1, without binary rounding of q."""
    return F.greatest(F.ceil(F.lit(str(q)).cast("decimal(18,12)") * F.col(n).cast("decimal(18,0)")), F.lit(1)).cast("bigint")


def percentiles(states: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """``keys``, ``n`` and for every name in ``qs`` the estimate and its certain bounds ``<name>_low``, ``<name>_high``."""
    out = [*keys, "n", "err"]
    for name, q in qs.items():
        low, high, middle = bracket(q)
        out += [middle.alias(name), low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    return states.select(*out)


def ratio_exceeds(df: DataFrame, keys: list[str], values: str, row: list[str] | None, upper: float, lower: float, factor: float, least: int, k: int = 1024, leaf_values: int = LEAF_VALUES, fan_in: int = FAN_IN) -> DataFrame:
    """Groups of at least ``least`` values whose percentile ``upper`` exceeds ``factor`` times their percentile ``lower``.

    The bounds of the states decide most groups. For each group that they leave open a further pass sketches only the
    values strictly between the bounds of either percentile (fewer than one in k / levels) and so narrows it, until
    every group is decided; the result is exact. Each pass leaves fewer values, so passes end by themselves.
    """
    states = sketch(df, keys, values, row, k, leaf_values, fan_in).where(F.col("n") >= least)
    known = percentiles(states, keys, {"a": lower, "b": upper}).select(*keys, place(lower).alias("ra"), place(upper).alias("rb"), "a_low", "a_high", "b_low", "b_high")
    done = None
    while True:
        known = materialize(known, "percentiles")
        sure = known.where(F.col("b_low") > factor * F.col("a_high")).select(*keys)
        done = sure if done is None else done.unionByName(sure)
        known = known.where((F.col("b_low") <= factor * F.col("a_high")) & (F.col("b_high") > factor * F.col("a_low")))
        if known.isEmpty():
            return done
        known = _narrow(df, known, keys, values, row, k, leaf_values, fan_in)


def hold_truth(df: DataFrame, known: DataFrame, keys: list[str], values: str, row: list[str] | None, qs: dict[str, float]) -> DataFrame:
    """For every row of ``known`` (of ``percentiles``) and name in ``qs`` whether its bounds hold the true percentile.

    Columns: ``keys``, ``n``, ``<name>_held``. The true value lies within iff fewer values than its place are below the
    lower bound and at least as many are up to the upper one, so all values are compared but none is gathered or sorted.
    """
    marks = known.select(*[F.col(c).alias(f"__{c}") for c in known.columns])
    ident = [c for c in (row or []) if c not in keys]
    rows = df.select(*keys, *ident, F.col(values).alias("__v"))
    if row is not None:
        rows = rows.distinct()
    same = F.lit(True)
    for c in keys:
        same = same & rows[c].eqNullSafe(F.col(f"__{c}"))
    rows = rows.join(marks, same).withColumn("__v", valid_values(F.col("__v")))
    below = lambda bound: F.sum(F.size(F.filter("__v", lambda v: v < bound)))
    upto = lambda bound: F.sum(F.size(F.filter("__v", lambda v: v <= bound)))
    counts = [f(F.col(f"__{x}_{end}")).alias(f"__{x}_{name}") for x in qs for f, end, name in ((below, "low", "below"), (upto, "high", "upto"))]
    out = rows.groupBy(*keys, F.col("__n").alias("n")).agg(*counts)
    held = [((F.col(f"__{x}_below") < place(q)) & (F.col(f"__{x}_upto") >= place(q))).alias(f"{x}_held") for x, q in qs.items()]
    return out.select(*keys, "n", *held)


def _between(rows: DataFrame, kept: list[str], name: str, low: Column, high: Column) -> DataFrame:
    """Of every row, how many values lie below and at ``low``, and the values strictly between the bounds."""
    return rows.select(
        *kept,
        F.lit(name).alias("__p"),
        F.size(F.filter("__v", lambda v: v < low)).alias("__below"),
        F.size(F.filter("__v", lambda v: v == low)).alias("__at"),
        F.filter("__v", lambda v: (v > low) & (v < high)).alias("__in"),
    )


def _narrow(df: DataFrame, known: DataFrame, keys: list[str], values: str, row: list[str] | None, k: int, leaf_values: int, fan_in: int) -> DataFrame:
    """``known`` with closer bounds: each open percentile is searched among the values strictly between its bounds."""
    marks = known.select(*[F.col(c).alias(f"__{c}") for c in known.columns])
    cond = F.lit(True)
    for c in keys:
        cond = cond & df[c].eqNullSafe(F.col(f"__{c}"))
    ident = [c for c in (row or []) if c not in keys]
    rows = df.join(marks, cond).select(*[df[c] for c in [*keys, *ident]], df[values].alias("__v"), *[f"__{c}" for c in known.columns if c not in keys])
    if row is not None:
        rows = rows.distinct()  # on the stored values, as in ``sketch``: rows that differ only in values left out below are two
    rows = rows.withColumn("__v", valid_values(F.col("__v")))
    parts = []
    for p in "ab":
        parts.append(_between(rows, [*keys, *ident], p, F.col(f"__{p}_low"), F.col(f"__{p}_high")))
    parts = parts[0].unionByName(parts[1])
    counts = parts.groupBy(*keys, "__p").agg(F.sum("__below").alias("__below"), F.sum("__at").alias("__at"))
    inner = sketch(parts, [*keys, "__p"], "__in", None, k, leaf_values, fan_in)
    out = known
    for p in "ab":
        c = counts.where(F.col("__p") == p).select(*[F.col(x).alias(f"__k_{x}") for x in keys], "__below", "__at")
        s = inner.where(F.col("__p") == p).select(*[F.col(x).alias(f"__s_{x}") for x in keys], *STATE)
        on_c, on_s = F.lit(True), F.lit(True)
        for x in keys:
            on_c, on_s = on_c & F.col(x).eqNullSafe(F.col(f"__k_{x}")), on_s & F.col(x).eqNullSafe(F.col(f"__s_{x}"))
        j = out.join(c, on_c, "left").join(s, on_s, "left")
        r = F.col(f"r{p}") - F.col("__below") - F.col("__at")
        n, w, err, buf = (F.col(x) for x in ("n", "w", "err", "buf"))
        below, above = F.floor((r - 1 - err) / w) + 1, F.ceil((r + err) / w)
        inner_low = F.when(r - 1 - err < 0, F.col("low")).otherwise(F.element_at(buf, F.least(below, F.size(buf)).cast("int")))
        inner_high = F.when(above > F.size(buf), F.col("high")).otherwise(F.element_at(buf, above.cast("int")))
        old_low, old_high = F.col(f"{p}_low"), F.col(f"{p}_high")
        n0 = F.coalesce(n, F.lit(0))
        new_low = F.when(r <= 0, old_low).when(r > n0, old_high).otherwise(inner_low)
        new_high = F.when(r <= 0, old_low).when(r > n0, old_high).otherwise(inner_high)
        out = j.select(*[new_low.alias(x) if x == f"{p}_low" else new_high.alias(x) if x == f"{p}_high" else F.col(x) for x in known.columns])
    return out
