"""Texts cut by a field limit or in transfer, and each source's share of them.

A source with a field limit has a spike in the histogram of the lengths of a text column, in characters or in bytes, with
next to nothing above it; a source that cuts at a limit but backs off to a word has a pile just under its greatest length. Texts
at such lengths that don't end like a finished text were cut by the limit (``limit``): there only terminal punctuation and closed structures (code, whole table rows) are finished. A
text cut in transfer has any length; it shows by its end alone: inside a word or sentence, inside an open table row or code
block, with a mark of the cut or a broken character (``transfer``). At other lengths ends that authors leave without a full
stop are finished as well: headings, list items, links, tag lines, signatures.

All of it is JVM expressions; texts aren't shuffled, only lengths and flags are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.sources.shared import materialize

#: Characters at the end of a text that hold every pattern of bounded length; list items, links and tag lines of any length
#: are looked for in the whole last line.
TAIL = 600
#: Lengths on either side of one that say how often it would occur by chance.
NEAR = 40
#: A spike holds at least so many texts, and so many times what its neighbourhood has.
SPIKE_LEAST, SPIKE_TIMES = 5, 8
#: Backing off to a word takes at most so many characters.
BACK_OFF = 16

# Marks of a cut, the second kind in words. A sentence end, then closing quotes or brackets, then emoji.
_FINISHED = r"""[.!?。！？؟।]["'”“’»)\]}*_]*[\s\p{So}\x{200d}\x{fe0f}]*$"""
_MARK = r"""(?:(?:…|\.\.\.)[\])}>"'”’]*|\x{fffd})$"""
_SAID = r"(?i)[\[({<](?:cont(?:inued|d|'d)?|more|cut|snip(?:ped)?|trunc(?:ated)?)\.{0,3}[\])}>]$"
# In the whole last line.
_LIST = r"^[ \t]*(?:[-*+•]|\d+[.)])[ \t]"
_LINK = r"""(?:https?://|www\.)[^\s<>"|]+/[^\s<>"|]*$"""
_TAGS = r"^\p{Lu}[\p{L}]*:[ \t][\p{L}\p{N}_ -]+(?:,[ \t]?[\p{L}\p{N}_ -]+)*$"
_HASHTAGS = r"(?:^|\s)#[\p{L}\p{N}_]+$"
_MARKED_HEADING = r"^#{1,6} [^.!?]{1,100}$"
# In the last characters, ahead of which stands a null character unless they are the whole text.
# A last paragraph of two to four short lines that begin with a capital and have no sentence punctuation.
_SIGNATURE = r"(?:^|\n[ \t]*\n)(?:\p{Lu}[^\n.!?:;]{0,40}\n){1,3}[\p{Lu}-][^\n.!?:;]{0,40}$"
# "Title words: more words 2017", or a text that is nothing but a short line.
_HEADING = r"(?:^|[\s|>])\p{Lu}[^\n.!?:|]{1,60}: [^\n.!?:,|]{1,60}\s\d{4}$|^\p{Lu}[^\n.!?,;]{1,50}$"
_SEPARATOR = r"(?m)^\|(?:[ :]*-+[ :]*\|)+[ \t]*$"


def with_open(df: DataFrame, text: str, name: str = "open", bare: str | None = None) -> DataFrame:
    """``df`` with the flag ``name``: whether the text ends inside a word, a sentence or an open structure.

    The flag ``bare``, if named, is the same without the exemptions for ends that authors leave without a full stop: lists,
    links, tags, signatures and headings. Both are false for null, empty and blank texts. Built in steps, so that each part is
    worked out once a row.
    """
    blank = r"[\s\p{Z}\p{Cc}\p{Cf}]"
    whole, end = F.col(text), F.right(F.col(text), F.lit(4 * TAIL))
    # Most texts end in a visible character. One that ends in thousands of blanks is stripped as a whole.
    stripped = F.regexp_replace(end, f"{blank}+$", "")
    shorter = F.substring(whole, F.lit(1), F.length(whole) - F.length(end) + F.length(stripped))
    stripped = F.when((F.length(stripped) == 0) & (F.length(whole) > 4 * TAIL), F.regexp_replace(whole, f"{blank}+$", "")).otherwise(shorter)
    df = df.withColumn("__body", F.when(F.right(whole, F.lit(1)).rlike(blank), stripped).otherwise(whole))
    # Closing tags that a transfer adds say nothing about what stands before them.
    df = df.withColumn("__blank", F.coalesce(F.length("__body") == 0, F.lit(True)))
    df = df.withColumn("__body", F.when(F.col("__body").endswith(">"), F.regexp_replace("__body", r"(?:\s*+</[A-Za-z]{1,10}>)+$", "")).otherwise(F.col("__body")))
    line = F.substring_index(F.substring_index("__body", "\n", -1), "\r", -1)
    lines = F.replace(F.replace(F.right("__body", F.lit(TAIL)), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    df = df.withColumns({"__line": line, "__tail": F.when(F.length("__body") > TAIL, F.concat(F.lit("\0"), lines)).otherwise(lines)})
    tail, line = F.col("__tail"), F.col("__line")
    fences = (F.length(whole) - F.length(F.replace(whole, F.lit("```"), F.lit("")))) / 3
    bars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    finished = tail.rlike(_FINISHED)
    structured = F.lit(False)
    for pattern in (_LIST, _LINK, _TAGS, _HASHTAGS, _MARKED_HEADING):
        structured = structured | line.rlike(pattern)
    structured = structured | tail.rlike(_SIGNATURE) | tail.rlike(_HEADING)
    certain = (
        F.when(F.col("__blank"), False)
        .when(tail.rlike(_MARK) | tail.rlike(_SAID), True)
        .when(fences % 2 == 1, True)
        .when(tail.endswith("```") | finished, False)
        .when(line.startswith("|") & whole.rlike(_SEPARATOR), ~line.rlike(r"\|[ \t]*$") | (bars(line) < bars(F.regexp_extract(whole, _SEPARATOR, 0))))
    )  # null: only the exemptions can tell
    df = df.withColumn("__certain", certain)
    flags = {name: F.coalesce("__certain", ~structured, F.lit(False))} | ({bare: F.coalesce("__certain", F.lit(True))} if bare else {})
    return df.withColumns(flags).drop("__body", "__blank", "__tail", "__line", "__certain")


def measured(df: DataFrame, id_col: str, text_cols: str | list[str], source_col: str) -> DataFrame:
    """A row for each text: ``id``, ``source``, ``column``, lengths ``n_chars`` and ``n_bytes``, whether it ends ``open`` and ``bare``.

    Blank texts have null lengths. Several columns are read in one scan.
    """
    cols = [text_cols] if isinstance(text_cols, str) else text_cols
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(cols)])
    if len(cols) == 1:
        rows = rows.select("id", "source", F.lit(cols[0]).alias("column"), F.col("t0").alias("t"))
    else:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"t{i}").alias("t")) for i, c in enumerate(cols)]))
        rows = rows.select("id", "source", each.alias("x")).select("id", "source", "x.column", "x.t")
    rows = with_open(rows.withColumn("filled", F.col("t").rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]")), "t", bare="bare")
    lengths = [F.when(F.col("filled"), f("t")).alias(n) for n, f in (("n_chars", F.length), ("n_bytes", F.octet_length))]
    return rows.select("id", "source", "column", *lengths, "open", "bare")


def limits(rows: DataFrame) -> DataFrame:
    """Length limits: ``source``, ``column``, ``unit`` (chars or bytes), ``low``, ``high``: texts cut there have a length between.

    A spike counts as a limit if fewer texts than half of it are longer. A limit in bytes may cut up to three bytes
    early, ahead of a character. A pile counts by the same rule if ``BACK_OFF`` consecutive lengths hold five times what the
    lengths before them would make likely. A histogram has one row for each length, however many texts
    the source has.
    """
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"n_{u}").alias("len")) for u in ("chars", "bytes")])).alias("u")
    hist = rows.where(F.col("n_chars").isNotNull()).select("source", "column", units).groupBy("source", "column", "u.unit", "u.len").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "column", "unit").orderBy("len")
    near = F.sum("n").over(w.rangeBetween(-NEAR, NEAR)) - F.col("n")
    above = F.coalesce(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    pile = F.sum("n").over(w.rangeBetween(1 - BACK_OFF, 0))
    ahead = F.coalesce(F.sum("n").over(w.rangeBetween(-8 * BACK_OFF, -BACK_OFF)), F.lit(0))
    hist = hist.withColumns({"near": near, "above": above, "pile": pile, "ahead": ahead})
    by_chance = F.col("near") / (2 * NEAR) + 0.5
    spikes = hist.where((F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * by_chance) & (2 * F.col("above") < F.col("n")))
    spikes = spikes.select("source", "column", "unit", F.when(F.col("unit") == "bytes", F.col("len") - 3).otherwise(F.col("len")).alias("low"), F.col("len").alias("high"))
    piles = hist.where((F.col("pile") >= 2 * SPIKE_LEAST) & (F.col("pile") >= 5 * (F.col("ahead") / 7 + 0.5)) & (2 * F.col("above") < F.col("pile")))
    piles = piles.select("source", "column", "unit", (F.col("len") - BACK_OFF + 1).alias("low"), F.col("len").alias("high"))
    return spikes.unionByName(piles)


def truncated(df: DataFrame, id_col: str, text_cols: str | list[str], source_col: str) -> DataFrame:
    """Every text with ``how``: ``limit``, ``transfer``, or null for one that wasn't cut.

    Columns: ``id``, ``source``, ``column``, ``n_chars``, ``n_bytes``, ``how``; a row for each row and column of text. A text is
    cut by a ``limit`` if its length is one of those that the histogram of its source and column shows as limits and it
    doesn't end in terminal punctuation or a closed structure; at all other lengths the end alone tells (``transfer``).

    Null, empty and blank texts weren't cut; a null source is a source; copies are judged each. An empty table gives an
    empty one. Other columns are ignored.
    """
    # Written once, without the texts: both the histograms and the judgement read it.
    rows = materialize(measured(df, id_col, text_cols, source_col), "lengths")
    found = limits(rows).groupBy(F.col("source").alias("limited"), F.col("column").alias("in_column")).agg(F.collect_set(F.struct("unit", "low", "high")).alias("limits"))
    at = F.exists("limits", lambda x: F.when(x["unit"] == "chars", F.col("n_chars")).otherwise(F.col("n_bytes")).between(x["low"], x["high"]))
    joined = rows.join(found, F.col("source").eqNullSafe(F.col("limited")) & (F.col("column") == F.col("in_column")), "left")
    how = F.when(F.coalesce(at, F.lit(False)), F.when(F.col("bare"), "limit")).when(F.col("open"), "transfer")
    return joined.select("id", "source", "column", "n_chars", "n_bytes", how.alias("how"))


def by_source(judged: DataFrame) -> DataFrame:
    """Per source and column: texts, cut texts by kind, their share (of texts that aren't blank)."""
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    out = judged.groupBy("source", "column").agg(
        count(F.col("n_chars").isNotNull()).alias("texts"),
        count(F.col("how") == "limit").alias("cut_by_limit"),
        count(F.col("how") == "transfer").alias("cut_in_transfer"),
    )
    return out.withColumn("share", F.round((F.col("cut_by_limit") + F.col("cut_in_transfer")) / F.greatest("texts", F.lit(1)), 6))
