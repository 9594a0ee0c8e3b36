"""How many identifiers each pair of many large sets shares, without storing an intersection.

Set-identifier rows are deduplicated and joined with themselves on the identifier, each pair of sets in one order, and
counted per pair; the count is aggregated before its shuffle, so the shared identifiers are never stored.

Joining on an identifier that m sets hold makes m * m / 2 rows, so an identifier found nearly everywhere would make all
pairs. For a threshold on the share of the smaller set that is avoidable without losing a pair: order identifiers by the
number of sets that hold them. A set A of n identifiers that shares at least t with a set no smaller must share one
outside its t - 1 most frequent ones. So A looks for partners only with its other identifiers (its head); the most
frequent ones (its tail) enter the count afterwards, for the pairs that can still reach t. The head also takes in every
identifier held by at most ``common`` sets: that costs at most ``common`` / 2 rows an identifier and makes tails short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.sources.shared import materialize

#: Identifiers held by at most so many sets always count in the join.
COMMON = 64


def members(df: DataFrame, set_cols: list[str], id_col: str) -> DataFrame:
    """Distinct (``set``, ``id``) rows, ``set`` being a struct that sorts like ``set_cols``; null and empty ids are out.

    Copies are dropped before the shuffle, so a hot identifier of a hot set is one row of each task.
    """
    kept = df.where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != ""))
    return kept.select(F.struct(*set_cols).alias("set"), F.col(id_col).alias("id")).distinct()


def overlapping_pairs(df: DataFrame, set_cols: list[str], id_col: str, share: float = 0.5, least: int = 40, common: int = COMMON) -> DataFrame:
    """Pairs of sets that share at least ``share`` of the ids of the smaller one, both of at least ``least`` ids.

    Columns: ``set_a``, ``set_b`` (structs, a before b in their order), ``n_a``, ``n_b``, ``shared`` (exact). Rows with a
    null or empty id are passed over, repeated rows count once, null set columns are values like others. An empty table,
    or one with a single set, gives no pair. Other columns are ignored.
    """
    all_members = members(df, set_cols, id_col)
    # need: ids that A must share with a set no smaller; in decimals, so that half of 41 is 21.
    need = F.ceil(F.lit(str(share)).cast("decimal(18,12)") * F.col("n").cast("decimal(18,0)")).cast("bigint")
    sizes = all_members.groupBy("set").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    sizes = sizes.withColumn("need", F.greatest(need, F.lit(1).cast("bigint")))
    # An id of one set joins nothing: it only takes a place in its set's head. The others are few and written once.
    # Counting before the join leaves a hot id to Spark's splitting of skewed joins.
    held = all_members.groupBy("id").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    shared_ids = materialize(all_members.join(held, "id").join(sizes, "set"), "members")

    # A histogram per set, of one row a count, gives the head's end; ids of one set come first.
    per_count = shared_ids.groupBy("set", "need", "n", "held").agg(F.count(F.lit(1)).alias("ids"))
    of_set = Window.partitionBy("set")
    alone = F.col("n") - F.sum("ids").over(of_set)
    upto = alone + F.sum("ids").over(of_set.orderBy("held").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = per_count.withColumn("upto", upto).withColumn("in_head", (F.col("upto") - F.col("ids") < F.col("n") - F.col("need") + 1) | (F.col("held") <= common))
    ends = heads.where("in_head").groupBy("set").agg(F.max("held").alias("head_end"), (F.max("n") - F.max("upto")).alias("tail"))

    marked = shared_ids.join(ends, "set")
    a = marked.where(F.col("held") <= F.col("head_end")).select("id", *[F.col(c).alias(f"a_{c}") for c in ("set", "n", "need", "tail")])
    b = shared_ids.select("id", F.col("set").alias("b_set"), F.col("n").alias("b_n"))
    smaller_first = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_set") < F.col("b_set")))
    pairs = a.join(b, "id").where(smaller_first).groupBy("a_set", "b_set", "a_n", "b_n", "a_need", "a_tail").agg(F.count(F.lit(1)).alias("in_head"))
    pairs = materialize(pairs.where(F.col("in_head") + F.col("a_tail") >= F.col("a_need")), "pairs")

    # The tails of the pairs that are left: few ids a set, looked up by (set, id).
    tails = marked.where((F.col("held") > F.col("head_end"))).select(F.col("set").alias("a_set"), "id")
    asked = pairs.where(F.col("a_tail") > 0).select("a_set", "b_set").join(tails, "a_set")
    frequent = tails.select("id").distinct()
    inside = shared_ids.join(frequent, "id", "left_semi").select(F.col("set").alias("b_set"), "id")
    extra = asked.join(inside, ["b_set", "id"]).groupBy("a_set", "b_set").agg(F.count(F.lit(1)).alias("in_tail"))
    shared = F.col("in_head") + F.coalesce(F.col("in_tail"), F.lit(0))
    found = pairs.join(extra, ["a_set", "b_set"], "left").withColumn("shared", shared).where(F.col("shared") >= F.col("a_need"))
    first: Column = F.col("a_set") < F.col("b_set")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return found.select(pick("a_set", "b_set").alias("set_a"), pick("b_set", "a_set").alias("set_b"), pick("a_n", "b_n").alias("n_a"), pick("b_n", "a_n").alias("n_b"), "shared")
