"""One form for texts that look the same but differ in their characters.

Edges say that two strings look the same: a character and its canonical decomposition, its width or no-break variant, its
ligature spelled out, its homoglyphs, an invisible character and nothing. Homoglyphs are those of the public table of
confusable characters of Unicode Technical Standard 39, read from the ICU library that comes with Spark. Union-find makes them
classes, transitively. The representative of a class is its spelling in single characters, each the most frequent of its
own class in the corpus at hand (counted over all rows). A text is decomposed (NFD), rewritten greedily from the left with
the longest member of a class at each place (Aho-Corasick), and composed again (NFC). Since representatives are spelled
out in representatives, equal-looking texts meet in one form, and the form of a form is itself.

Upper and lower case, letters with and without accent, letters and digits, and different visible punctuation stay apart.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.sources.shared import materialize

# Compatibility characters drawn like their decomposition: micro sign, ligatures, Roman numerals.
SPELLED_OUT = [0xB5, *range(0xFB00, 0xFB07), *range(0x2160, 0x2180)]
# Hyphens drawn like the hyphen-minus.
HYPHENS = "‐‑"
# Characters that Unicode lets programs ignore and that aren't of category Cf, as first and last of a range.
IGNORABLE = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]
# Characters of category Cf that are visible.
VISIBLE_FORMATS = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F)]
CODE_POINTS = 0x110000
_PIECE = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


class UnionFind:
    """Classes of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        self.parent[self.find(x)] = self.find(y)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def icu_jar() -> str:
    """The ICU library among the jars of Spark; ``FileNotFoundError`` where there is none."""
    import pyspark

    for home in (os.environ.get("SPARK_HOME"), Path(pyspark.__file__).parent):
        if home and (found := sorted(Path(home, "jars").glob("icu4j-*.jar"))):
            return str(found[-1])
    raise FileNotFoundError("no icu4j-*.jar among the jars of Spark")


@lru_cache(maxsize=2)
def prototypes(jar: str | None = None) -> dict[str, str]:
    """Each confusable character and the string it is confused with, as in the table of ICU.

    The file is big-endian: a header, whose first two bytes are its length; a block of 32-bit numbers, of which those from
    the fourth on are the places and lengths of three lists; the keys, a character and the length of its string less one
    in the top byte; the values, 16 bits each, the string itself where it has one unit, else its place; the strings.
    """
    with zipfile.ZipFile(jar or icu_jar()) as z:
        raw = z.read(next(n for n in z.namelist() if n.endswith("/confusables.cfu")))
    raw = raw[int.from_bytes(raw[:2], "big") :]
    at = [int(x) for x in np.frombuffer(raw, ">i4", 9)[3:]]
    keys, values, strings = (np.frombuffer(raw, kind, at[2 * i + 1], at[2 * i]) for i, kind in enumerate((">u4", ">u2", ">u2")))
    text = strings.tobytes()
    out = {}
    for key, value in zip(keys.tolist(), values.tolist(), strict=True):
        n = (key >> 24) + 1
        units = value.to_bytes(2, "big") if n == 1 else text[2 * value : 2 * (value + n)]
        out[chr(key & 0xFFFFFF)] = units.decode("utf-16-be")
    return out


def _kind(c: str) -> str:
    """Case of a letter, ``digit``, or the category; letters without case have none."""
    kind = unicodedata.category(c)
    return {"Lu": "upper", "Lt": "upper", "Ll": "lower", "Lo": "letter", "Lm": "letter"}.get(kind, "digit" if kind[0] == "N" else kind)


@lru_cache(maxsize=2)
def homoglyphs(jar: str | None = None) -> dict[str, str]:
    """Each letter or digit that looks like others, and the smallest of them.

    Characters look the same if their prototypes are equal and both are upper case, both lower case, or both digits; a
    letter of a script without case is of the case of its prototype. Accented characters are left to their decomposition,
    marks and punctuation stay apart.
    """
    table = prototypes(jar)
    groups: dict[tuple[str, str], list[str]] = {}
    for c in {*table, *(p for p in table.values() if len(p) == 1)}:
        proto, kind = table.get(c, c), _kind(c)
        if kind == "letter" and len(proto) == 1:
            kind = _kind(proto)
        # Conjoining jamo are parts of composed syllables, not letters by themselves.
        whole = unicodedata.decomposition(c).partition(">")[0] in ("", "<font") and not 0x1100 <= ord(c) < 0x1200
        if whole and kind in ("upper", "lower", "letter", "digit"):
            groups.setdefault((proto, kind), []).append(c)
    return {c: min(members) for members in groups.values() if len(members) > 1 for c in members}


def _within(code: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= code <= b for a, b in ranges)


def invisible(code: int) -> bool:
    return _within(code, IGNORABLE) or (unicodedata.category(chr(code)) == "Cf" and not _within(code, VISIBLE_FORMATS))


def edges(code: int) -> Iterator[tuple[str, str]]:
    """What the character looks the same as; decompositions are one step, the union makes them whole."""
    c = chr(code)
    if invisible(code):
        yield c, ""
        return
    if c != " " and unicodedata.category(c) == "Zs":
        yield c, " "
    tag, _, parts = unicodedata.decomposition(c).rpartition("> ")
    if parts and (not tag or tag in ("<wide", "<narrow", "<noBreak") or code in SPELLED_OUT):
        yield c, "".join(chr(int(p, 16)) for p in parts.split())
    if c in HYPHENS:
        yield c, "-"
    if (other := homoglyphs().get(c, c)) != c:
        yield c, other


def fit(counts: dict[int, int]) -> tuple[tuple[str, str], ...]:
    """The rewriting (member, representative) for a corpus with these counts of code points.

    Members are those that occur in the corpus. Ties go to the smaller code point, so ASCII comes first.
    """
    known = UnionFind()
    todo, seen = [c for c in counts if not 0xD800 <= c < 0xE000], set()
    while todo:
        code = todo.pop()
        if code in seen:
            continue
        seen.add(code)
        for a, b in edges(code):
            known.union(a, b)
            todo += map(ord, b)
    single: dict[str, str] = {}
    spelled: list[tuple[list[str], str]] = []
    for members in known.classes():
        whole = [m for m in members if len(m) > 1]
        if "" in members:
            single |= dict.fromkeys((m for m in members if m), "")
        elif whole:
            spelled.append((members, min(whole, key=lambda m: (-len(m), m))))
        else:
            best = min(members, key=lambda m: (-counts.get(ord(m), 0), ord(m)))
            single |= {m: best for m in members if m != best}

    def spell(s: str) -> str:
        """In representatives; a spelling's own characters may have one in turn."""
        out = "".join(single.get(c, c) for c in unicodedata.normalize("NFD", s))
        for members, whole in spelled:
            for m in members:
                if len(m) == 1 and m in out:
                    out = out.replace(m, spell(whole))
        return out

    rules = dict(single)
    for members, whole in spelled:
        rep = spell(whole)
        rules |= {d: rep for m in members if (d := unicodedata.normalize("NFD", m)) != rep}
    return tuple(sorted(rules.items()))


@lru_cache(maxsize=4)
def _automaton(rules: tuple[tuple[str, str], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for member, rep in rules:
        a.add_word(member, (len(member), rep))
    a.make_automaton()
    return a


@lru_cache(maxsize=4)
def _touched(rules: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Whether a code point is one that every match of some rule has, or has it in its decomposition."""
    members = {m for m, _ in rules if len(m) == 1}
    members |= {m[0] for m, _ in rules if members.isdisjoint(m)}
    composed = (c for c in map(chr, range(0xC0, 0x30000)) if (d := unicodedata.decomposition(c)) and d[0] != "<")
    members |= {c for c in composed if not members.isdisjoint(unicodedata.normalize("NFD", c))}
    out = np.zeros(CODE_POINTS, bool)
    out[[ord(c) for c in members]] = True
    return out


def rewriter(rules: tuple[tuple[str, str], ...]) -> Callable[[str], str]:
    """The function that brings a text to its form.

    A composed text without any character that a rule may change is its own form. Of the others only runs of non-ASCII
    characters, each with the character ahead of it, are taken apart, unless a rule has ASCII characters among its members:
    an ASCII character never composes with what stands before it, so nothing crosses the ends of such a piece.
    """
    touched, automaton = _touched(rules), _automaton(rules)
    plain = not touched[:128].any()
    in_pieces = plain and not any(c.isascii() for m, _ in rules for c in m)
    known: dict[str, str] = {}

    def rewritten(text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        out, at = [], 0
        for end, (n, rep) in automaton.iter_long(text) if rules else ():
            out += (text[at : end - n + 1], rep)
            at = end + 1
        return unicodedata.normalize("NFC", "".join((*out, text[at:])))

    def piece(found: re.Match) -> str:
        text = found[0]
        if (form := known.get(text)) is None:
            if len(known) > 1 << 16:
                known.clear()
            form = rewritten(text)
            if len(text) < 64:
                known[text] = form
        return form

    def one_form(text: str) -> str:
        if plain and text.isascii():
            return text
        if in_pieces:
            return _PIECE.sub(piece, text)
        if not touched[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return unicodedata.normalize("NFC", text)
        return rewritten(text)

    one_form.whole = rewritten
    return one_form


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of the column one after the other, and how many each text has; nulls have none."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    if not (raw > 127).any():
        return raw, np.diff(offsets)
    begins = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.diff(begins[offsets - offsets[0]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points of a partition with their counts: one array of as many places as Unicode has."""
    total = np.zeros(CODE_POINTS, np.int64)
    for b in batches:
        seen, sizes = _characters(b.column(0))
        counts = np.bincount(seen, np.repeat(b.column(1).to_numpy(), sizes)).astype(np.int64)
        total[: len(counts)] += counts
    codes = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(total[codes])], names=["code", "n"])


def code_point_counts(columns: list[DataFrame]) -> dict[int, int]:
    """How often each code point occurs in the first column of all tables; at most 1.1 million entries.

    A second column, if there is one, says how many rows a row stands for.
    """
    parts = None
    for df in columns:
        text, *n = df.columns
        rows = df.select(F.col(text).alias("text"), (F.col(n[0]) if n else F.lit(1)).cast("bigint").alias("n")).where(F.col("text").isNotNull())
        part = rows.mapInArrow(_count, "code int, n bigint")
        parts = part if parts is None else parts.unionByName(part)
    return {r["code"]: r["n"] for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def form(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The form of a text column; null stays null, empty stays empty."""

    @F.pandas_udf("string")
    def one_form(s: pd.Series) -> pd.Series:
        f = rewriter(rules)
        return s.map(lambda x: None if x is None else f(x))

    return one_form(text)


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def distinct_texts(df: DataFrame, scope: str, text: str) -> DataFrame:
    """``scope``, ``text`` and how many rows ``n`` have them, written once; null texts and null scopes are passed over."""
    rows = df.select(F.col(scope).alias("scope"), F.col(text).alias("text")).where(F.col("scope").isNotNull() & F.col("text").isNotNull())
    return materialize(rows.groupBy("scope", "text").agg(F.count(F.lit(1)).alias("n")), "texts")


def _with_forms(texts: DataFrame, rules: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame | None]:
    """``texts`` with their ``form``: those that go through Python, and those known to be their own form.

    Where no rule changes an ASCII character, two ASCII texts never meet and an ASCII text is its own form.
    """
    plain = not any(m.isascii() for m, _ in rules)
    other = texts.where(~is_ascii(F.col("text"))) if plain else texts
    # Written once: several branches read it, and conditions on the form would otherwise run it again.
    other = materialize(other.withColumn("form", form(F.col("text"), rules)), "forms")
    return other, texts.where(is_ascii(F.col("text"))).withColumn("form", F.col("text")) if plain else None


def pairs_of(texts: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """``equal_looking`` of ``distinct_texts``."""
    other, ascii_ = _with_forms(texts, rules)
    a, b = (other.select("scope", "form", F.col("text").alias(f"text_{x}")) for x in "ab")
    pairs = a.join(b, ["scope", "form"]).where(F.col("text_a") < F.col("text_b")).select("scope", "text_a", "text_b")
    if ascii_ is not None:
        met = ascii_.select("scope", "form").join(other, ["scope", "form"])
        pairs = pairs.unionByName(met.select("scope", F.least("form", "text").alias("text_a"), F.greatest("form", "text").alias("text_b")))
    return pairs


def classes_of(texts: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """``look_classes`` of ``distinct_texts``."""
    other, ascii_ = _with_forms(texts, rules)
    if ascii_ is not None:  # of the ASCII texts only those that another text looks like
        other = other.unionByName(ascii_.join(other.select("scope", "form").distinct(), ["scope", "form"], "left_semi"))
    best = other.groupBy("scope", "form").agg(F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("best"), F.count(F.lit(1)).alias("size"))
    return other.join(best.where("size > 1"), ["scope", "form"]).select("scope", "text", "n", F.col("best.text").alias("representative"), "size")


def equal_looking(df: DataFrame, scope: str, text: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Pairs ``text_a`` < ``text_b`` (by code points) of different texts of one ``scope`` that have one form.

    Columns: ``scope``, ``text_a``, ``text_b``. Repeated rows count once, null texts and null scopes are passed over, an
    empty text only pairs with texts of invisible characters. Other columns are ignored. An empty table gives no pair.
    A class of m texts gives m (m - 1) / 2 pairs; ``look_classes`` says the same in m rows.
    """
    return pairs_of(distinct_texts(df, scope, text), rules)


def look_classes(df: DataFrame, scope: str, text: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Texts of a ``scope`` that look like another one of it: ``scope``, ``text``, rows ``n``, ``representative``, ``size`` of the class.

    The representative is the most frequent text of the class, of equally frequent ones the smallest. The rules for nulls,
    empty texts and empty tables are those of ``equal_looking``.
    """
    return classes_of(distinct_texts(df, scope, text), rules)
