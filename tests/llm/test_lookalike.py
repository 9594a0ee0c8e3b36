import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeseek.llm import lookalike as L
from lakeseek.llm.leakage import all_rules


def rules_of(*texts):
    return L.fit(Counter(map(ord, "".join(texts))))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Nordhafen", "N‍o﻿rdhafen"), ("Port Imbra", "Ροrt Іmbrа"), ("Région", "Région"), ("QX-0001", "ＱＸ－０００１"), ("K", "K"),
        ("office", "oﬃce"), ("Ångström", "Ångström"), ("a b", "a　b"), ("soft", "so­ft"), ("dose_µg", "dose_μg"), ("ї", "ï"), ("IV", "Ⅳ"), ("x", "⁠x​"),
    ],
)
def test_same_look(a, b):
    f = L.rewriter(rules_of(a, b))
    assert f(a) == f(b)
    g = L.rewriter(all_rules())
    assert g(a) == g(b)


@pytest.mark.parametrize("pair", ["ρp", "υu", "αa", "ιi", "үy", "ҮY", "ԌG", "ɑa", "ɡg", "ᎪA", "ᎷM", "ⲟo", "ꓐB", "ոn", "հh", "ցg", "ıi", "ІI", "ӀI"])
def test_confusable_letters_meet(pair):
    f = L.rewriter(all_rules())
    assert f(pair[0]) == f(pair[1])


@pytest.mark.parametrize("pair", ["lI", "l1", "0O", "’'", "−-", "ǎă", "øo", "Łl", "ßB"])
def test_other_cases_kinds_marks_and_punctuation_stay_apart(pair):
    f = L.rewriter(all_rules())
    assert f(pair[0]) != f(pair[1])


def test_ignorable_characters_vanish_and_visible_formats_stay():
    f = L.rewriter(all_rules())
    assert f("a\U000e0101\u180b\u3164\u2062b") == "ab"
    assert f("\u0600a\ufff9") == "\u0600a\ufff9"


@pytest.mark.parametrize(("a", "b"), [("soil", "soiL"), ("tree", "treé"), ("O12", "012"), ("1l", "ll"), ("a-b", "a_b"), ("Größe", "Grosse"), ("x2", "x²"), ("a.b", "a,b"), ("rn", "m"), ("a  b", "a b")])
def test_different_look(a, b):
    f = L.rewriter(rules_of(a, b))
    assert f(a) != f(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcοеіＡＢ́̈​­ﬁé İß "), st.characters(exclude_categories=["Cs"])), max_size=20))
def test_a_form_is_its_own_form(text):
    f = L.rewriter(all_rules())
    assert f(f(text)) == f(text) == f.whole(text)
    assert f(unicodedata.normalize("NFD", text)) == f(text)


def test_representative_is_the_most_frequent():
    mostly_cyrillic = L.rewriter(L.fit({ord("а"): 10, ord("a"): 2}))
    assert mostly_cyrillic("a") == mostly_cyrillic("а") == "а"
    assert L.rewriter(L.fit({ord("а"): 2, ord("a"): 2}))("а") == "a"


def test_union_find_is_transitive():
    u = L.UnionFind()
    u.union("a", "b")
    u.union("c", "b")
    u.union("x", "y")
    assert sorted(map(sorted, u.classes())) == [["a", "b", "c"], ["x", "y"]]


def brute(rows, f):
    return {(s, a, b) for s, a in rows for t, b in rows if s == t and s is not None and a is not None and b is not None and a < b and f(a) == f(b)}


ROWS = [(1, "Nordhafen"), (1, "N‍ordhafen"), (1, "Νоrdhafen"), (1, "nordhafen"), (2, "Nordhafen"), (2, "N‍ordhafen"), (2, "N‍ordhafen"), (None, "Nordhafen"), (None, "N‍ordhafen"), (3, None), (3, ""), (3, "​"), (3, "é"), (3, "é"), (3, "e"), (4, "x" * 50_000), (4, "x" * 50_000 + "​")]


@pytest.mark.parametrize("heavy", ["", "о" * 400_000])
def test_pairs(spark, heavy):
    # with mostly Cyrillic letters an ASCII letter isn't its own form, and all texts take the general way
    rows = [*ROWS, (9, heavy)] if heavy else ROWS
    df = spark.createDataFrame([(s, t, t, "x") for s, t in rows], "s int, t string, text string, form string")
    rules = L.fit(L.code_point_counts([df.select("t")]))
    got = {(r["scope"], r["text_a"], r["text_b"]) for r in L.equal_looking(df, "s", "t", rules).collect()}
    assert got == brute(set(rows), L.rewriter(rules))
    assert (1, "N‍ordhafen", "Νоrdhafen") in got


def classes(rows, f):
    by = {}
    for s, t in rows:
        if s is not None and t is not None:
            by.setdefault((s, f(t)), Counter())[t] += 1
    return {(s, t, n, min(c, key=lambda x: (-c[x], x)), len(c)) for (s, _), c in by.items() if len(c) > 1 for t, n in c.items()}


@pytest.mark.parametrize("heavy", ["", "о" * 400_000])
def test_classes(spark, heavy):
    rows = [*ROWS, (9, heavy)] if heavy else ROWS
    df = spark.createDataFrame([(s, t, 1, "x") for s, t in rows], "s int, t string, n int, representative string")
    rules = L.fit(L.code_point_counts([df.select("t")]))
    got = {tuple(r) for r in L.look_classes(df, "s", "t", rules).collect()}
    assert got == classes(rows, L.rewriter(rules))


def test_counts_and_form(spark):
    df = spark.createDataFrame([("aab",), (None,), ("",), ("é𝒙",)], "t string")
    assert L.code_point_counts([df, df]) == {97: 4, 98: 2, 233: 2, 0x1D499: 2}
    got = df.select(L.form(df["t"], all_rules()).alias("f")).collect()
    assert [r["f"] for r in got] == ["aab", None, "", "éx"]
    weighted = spark.createDataFrame([("aé", 3), ("\U0001f600a", 2), ("", 9), (None, 4)], "t string, n bigint").repartition(3)
    assert L.code_point_counts([weighted]) == {97: 5, 233: 3, 0x1F600: 2}


def test_empty_table(spark):
    df = spark.createDataFrame([], "s int, t string")
    assert L.code_point_counts([df]) == {}
    assert L.equal_looking(df, "s", "t", ()).count() == 0
    assert L.look_classes(df, "s", "t", ()).count() == 0
