"""Join discovery by sets of values: exact overlap, MinHash, banding, containment, vectors.

``sets``: set_id, token rows. Hashes are md5-based where another engine must agree, xxhash64 otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions.text import is_token

PRIME = (1 << 31) - 1


def token_sets(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct (set_id, token): one set a column, ``<name>.<column>``; blanks, nulls and mere digits are no tokens."""
    cells = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("set_id"), F.trim(F.col(f"`{c}`").cast("string")).alias("token")) for c in columns]))
    return df.select(cells.alias("c")).select("c.*").where(is_token(F.col("token"))).distinct()


def token_order(sets: DataFrame) -> DataFrame:
    """(token, frequency, token_id): rare tokens first, ties by token; ids are dense.

    Numbered over a range partitioning, so a vocabulary of any size has no single-task sort.
    """
    from lakeseek.operators.sequence import number_rows

    return number_rows(sets.groupBy("token").agg(F.count(F.lit(1)).alias("frequency")), ["frequency", "token"], "token_id")


def posting_groups(sets: DataFrame) -> DataFrame:
    """(frequency, sets, group_id, tokens): tokens with one and the same list of sets form a group."""
    lists = sets.groupBy("token").agg(F.sort_array(F.collect_set("set_id")).alias("sets"))
    groups = lists.groupBy("sets").agg(F.count(F.lit(1)).alias("tokens"), F.min("token").alias("first"))
    return groups.select(F.size("sets").alias("frequency"), "sets", F.xxhash64("sets").alias("group_id"), "tokens")


def exact_topk(sets: DataFrame, query: DataFrame, k: int, token: str = "token") -> DataFrame:
    """The ``k`` sets that share most distinct tokens with the query, ties to the smaller id: (set_id, overlap).

    Counting posting lists of the query's tokens gives the exact answer in one shuffle; no cost model is needed.
    """
    asked = query.select(F.col(token).alias("token")).where(is_token(F.col("token"))).distinct()
    return sets.join(asked, "token").groupBy("set_id").agg(F.countDistinct("token").alias("overlap")).orderBy(F.desc("overlap"), "set_id").limit(k)


def exact_topk_many(sets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``exact_topk`` for each ``query_id`` of ``queries`` (query_id, token): (query_id, set_id, overlap)."""
    asked = queries.select("query_id", "token").where(is_token(F.col("token"))).distinct()
    shared = asked.join(sets.select("set_id", "token").distinct(), "token").groupBy("query_id", "set_id").agg(F.count(F.lit(1)).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "set_id"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def md5_number(c: Column) -> Column:
    """The first eight hexadecimal digits of the md5, as a number."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def permutations(num_perm: int) -> list[tuple[int, int]]:
    """Factor and summand of each permutation of the numbers below ``PRIME``: powers of two generators."""
    return [(pow(48_271, i, PRIME), pow(16_807, i, PRIME)) for i in range(1, num_perm + 1)]


def minhash(sets: DataFrame, num_perm: int = 16, by: str = "set_id", token: str = "token") -> DataFrame:
    """(set_id, signature, size): the least number of the tokens under each permutation, as an array; map-side minima.

    A token is hashed once, to 28 bits, so that products stay within 64 bits; the permutations are arithmetic.
    """
    h = F.conv(F.substring(F.md5(F.col(token)), 1, 7), 16, 10).cast("bigint")
    mins = [F.min((F.col("__h") * F.lit(a) + F.lit(b)) % F.lit(PRIME)).alias(f"h{i}") for i, (a, b) in enumerate(permutations(num_perm))]
    out = sets.select(by, h.alias("__h")).groupBy(by).agg(F.count(F.lit(1)).alias("size"), *mins)
    return out.select(by, F.array(*[f"h{i}" for i in range(num_perm)]).alias("signature"), "size")


def jaccard_estimate(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def merged_signature(a: Column, b: Column) -> Column:
    """The signature of the union of two sets."""
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def containment_estimate(jaccard: Column, n_query: Column, n_set: Column) -> Column:
    """Share of the query inside the set, from their Jaccard similarity and sizes."""
    return F.least(F.lit(1.0), jaccard * (n_query + n_set) / ((1 + jaccard) * n_query))


def best_bands(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) with the least weighted area of false positives below and false negatives above the threshold."""
    best, out = float("inf"), (1, num_perm)
    low, high = np.linspace(0, threshold, 201), np.linspace(threshold, 1, 201)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = np.trapezoid(1 - (1 - low**r) ** b, low)
            fn = np.trapezoid((1 - high**r) ** b, high)
            if fp * fp_weight + fn * fn_weight < best:
                best, out = fp * fp_weight + fn * fn_weight, (b, r)
    return out


def bands(signatures: DataFrame, b: int, r: int, by: str = "set_id") -> DataFrame:
    """(set_id, band, bucket): the hash of each band of a signature."""
    cells = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("signature", i * r + 1, r)).alias("bucket")) for i in range(b)]
    return signatures.select(by, F.explode(F.array(*cells)).alias("c")).select(by, "c.*")


def band_candidates(queries: DataFrame, signatures: DataFrame, b: int, r: int) -> DataFrame:
    """Distinct (query_id, set_id) that meet in a bucket of any band."""
    q = bands(queries, b, r).withColumnRenamed("set_id", "query_id")
    return q.join(bands(signatures, b, r), ["band", "bucket"]).select("query_id", "set_id").where(F.col("query_id") != F.col("set_id")).distinct()


def size_partitions(histogram: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Ranges (low, high) of set sizes for ``n`` partitions that make the expected false positives least.

    A partition of sizes l..u costs the sum over its sets of (u - size) / u; dynamic programme over distinct sizes.
    """
    sizes = sorted(histogram)
    if not sizes:
        return []
    m, n = len(sizes), min(n, len(sizes))
    count = np.cumsum([0, *[c for _, c in sizes]])
    mass = np.cumsum([0, *[s * c for s, c in sizes]])
    cost = lambda a, b: (count[b] - count[a]) - (mass[b] - mass[a]) / sizes[b - 1][0]
    best = np.full((n + 1, m + 1), np.inf)
    cut = np.zeros((n + 1, m + 1), int)
    best[0, 0] = 0
    for k in range(1, n + 1):
        for b in range(k, m + 1):
            for a in range(k - 1, b):
                if best[k - 1, a] + cost(a, b) < best[k, b]:
                    best[k, b], cut[k, b] = best[k - 1, a] + cost(a, b), a
    out, b = [], m
    for k in range(n, 0, -1):
        a = cut[k, b]
        out.append((sizes[a][0], sizes[b - 1][0]))
        b = a
    return out[::-1]


def containing_sets(sets: DataFrame, least: float) -> DataFrame:
    """(query_id, set_id, shared, containment): every pair of sets of which ``set_id`` holds at least ``least`` of ``query_id``.

    Exact. Of n tokens at least m = ceil(n * least) must be shared, so one of the n - m + 1 rarest is; only these heads are
    joined, and the other tokens are counted afterwards for the pairs found. Sets of fewer than m tokens are left out.
    """
    frequency = sets.groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))
    sizes = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("frequency", "token"))
    ranked = sets.join(frequency, "token").withColumn("rank", rank).join(sizes, "set_id").withColumn("needed", F.ceil(F.col("size") * least - 1e-9))
    head = F.col("rank") <= F.col("size") - F.col("needed") + 1
    asked = ranked.select(F.col("set_id").alias("query_id"), "token", F.col("size").alias("n"), "needed", head.alias("head"))
    holders = sets.join(sizes, "set_id")
    met = asked.where("head").join(holders, "token").where((F.col("query_id") != F.col("set_id")) & (F.col("size") >= F.col("needed")))
    met = met.groupBy("query_id", "set_id", "n", "needed").agg(F.count(F.lit(1)).alias("in_head"))
    rest = asked.where(~F.col("head")).select("query_id", "token")
    others = met.select("query_id", "set_id").join(rest, "query_id").join(sets, ["set_id", "token"]).groupBy("query_id", "set_id").agg(F.count(F.lit(1)).alias("others"))
    found = met.join(others, ["query_id", "set_id"], "left").withColumn("shared", F.col("in_head") + F.coalesce("others", F.lit(0)))
    return found.where(F.col("shared") >= F.col("needed")).select("query_id", "set_id", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def containment(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact share of the query's tokens inside the set for each (query_id, set_id)."""
    q = sets.withColumnRenamed("set_id", "query_id")
    n = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    shared = pairs.join(q, "query_id").join(sets, ["set_id", "token"]).groupBy("query_id", "set_id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(n, "query_id").select("query_id", "set_id", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def containment_paths(sets: DataFrame, query_ids: list[str] | Column, least: float = 0.1, top: int = 20) -> DataFrame:
    """(query_id, set_id, shared, containment): sets that hold at least ``least`` of a query set, the ``top`` of each.

    The query sets are those of the ids listed, or those for which a condition on ``set_id`` holds.
    """
    asked = sets.where(query_ids if isinstance(query_ids, Column) else F.col("set_id").isin(query_ids))
    q = asked.withColumnRenamed("set_id", "query_id")
    n = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    shared = q.join(sets, "token").where(F.col("query_id") != F.col("set_id")).groupBy("query_id", "set_id").agg(F.count(F.lit(1)).alias("shared"))
    found = shared.join(n, "query_id").select("query_id", "set_id", "shared", (F.col("shared") / F.col("n")).alias("containment")).where(F.col("containment") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("containment"), "set_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` vectors with the greatest cosine to one query vector, ties to the smaller id: distributed top-n."""
    sim = cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(id_col, sim.alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, block: int = 1024) -> DataFrame:
    """(query_id, id, similarity): the ``k`` vectors with the greatest cosine to each row of ``queries``, ties to the smaller id.

    Vectors are packed into blocks of about ``block``; each query keeps ``k`` of a block, so that no pair but these is
    shuffled and no task holds more than a block and a query. Null vectors and vectors of length 0 have no cosine and are left out.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("length", F.sqrt(dot(F.col("v"), F.col("v")))).where(F.col("length") > 0)
    n = max(1, -(-vectors.count() // block))
    blocks = rows(vectors).groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v", "length")).alias("members"))
    near = F.transform("members", lambda m: F.struct((-dot(m["v"], F.col("q")) / (m["length"] * F.col("q_length"))).alias("far"), m["id"].alias("id")))
    asked = rows(queries).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("length").alias("q_length"))
    pairs = asked.crossJoin(blocks).select("query_id", F.explode(F.slice(F.sort_array(near), 1, k)).alias("c")).select("query_id", "c.id", "c.far")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), (-F.col("far")).alias("similarity"))


def column_text(df: DataFrame, columns: list[str], name: str, values: int = 20, length: int = 128) -> DataFrame:
    """(set_id, text): a column as the text ``<column>: v1, v2, ...`` of its most frequent values."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.substring(F.col(f"`{c}`").cast("string"), 1, length).alias("v")) for c in columns]))
    counts = df.select(cells.alias("c")).select("c.*").where(F.col("v").isNotNull()).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "v"))
    top = counts.withColumn("at", rank).where(F.col("at") <= values)
    listed = top.groupBy("col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), ", ").alias("vs"))
    return listed.select(F.concat(F.lit(f"{name}."), "col").alias("set_id"), F.concat("col", F.lit(": "), "vs").alias("text"))


def hashed_ngrams(text: Column, dimensions: int = 64, n: int = 3) -> Column:
    """A vector of hashed character n-grams: the encoder that needs no model. Any other column of vectors serves as well."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.pmod(F.xxhash64(F.substring(F.lower(text), i, F.lit(n))), F.lit(dimensions)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("double"))


def rank_table_pairs(scores: DataFrame) -> DataFrame:
    """Per pair of tables the mean similarity of matched columns, raised by half where at most two match (joins rather
    than unions): (query_table, table, matched, score)."""
    g = scores.groupBy("query_table", "table").agg(F.count(F.lit(1)).alias("matched"), F.avg("similarity").alias("mean"))
    return g.select("query_table", "table", "matched", (F.col("mean") * F.when(F.col("matched") <= 2, 1.5).otherwise(1.0)).alias("score"))
