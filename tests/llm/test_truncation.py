import random

import pytest

from lakeseek.llm import truncation as T

WORDS = "the median of rainfall rose after an index keeper joined two tables and kept every distinct key".split()


def sentence(rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(5, 14))).capitalize() + "."


def prose(rnd, n):
    out = sentence(rnd)
    while len(out) < n:
        out += rnd.choice([" ", " ", "\n\n"]) + sentence(rnd)
    return out


OPEN = [
    "A sentence without an end", "Ends inside a wor", "Two clauses, but then,", "With a mark…", "With a mark [...]", "Also (more)", "Over there. (cont.)", "All of it. [Truncated]", "Broken ch�", "Ends in an open tag</p>", "It rose from 5 to 1",
    "Code:\n```\nselect a", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |", "First part is done.\n\nThe oversized rows of", "He said ... (", "Some text ends with and so on ...",
]
FINISHED = [
    "A sentence.", 'He said "so."', "Is it? (Yes.)", "Done! 🙂", "終わり。", "- one: a per b\n- two: c per d", "Notes.\n\nTags: soil, returns", "Text.\nSee https://notes.example/soil/542", "Text.\n```\nselect 1\n```",
    "| a | b |\n|---|---|\n| 1 | 2 |", "Text.\n\nKind regards\nPort Imbra data desk", "Soil extract: key and column overview 2025", "A short heading", "# Heading of a text", "<p>All said.</p>", "A text that ends in blanks.  \n\n",
    "1. first\n2. second", "All done.\n#soil #water", None, "", " \n\t", " ​",
]


def test_open_ends(spark):
    # a short line alone would be a heading, so a sentence stands before each
    texts = ["It rained first. " + t if "\n" not in t else t for t in OPEN]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [t for t, r in zip(texts, T.with_open(df, "t", "o").collect(), strict=True) if not r["o"]] == []


def test_finished_ends(spark):
    df = spark.createDataFrame([(t,) for t in FINISHED], "t string")
    assert [t for t, r in zip(FINISHED, T.with_open(df, "t", "o").collect(), strict=True) if r["o"]] == []


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    rows, cut, k = [], {}, 0
    for source in ("chars", "bytes", "words", "free", None):
        for _ in range(400):
            k += 1
            t = prose(rnd, rnd.randrange(30, 900))
            if source == "bytes":
                t = t.replace("e", "é")
            full = t
            if source == "chars" and len(t) > 500:
                t = t[:500]
            elif source == "bytes" and len(t.encode()) > 600:
                t = t.encode()[:600].decode("utf-8", "ignore")
            elif source == "words" and len(t) > 400:
                t = t[:400].rsplit(" ", 1)[0]
            elif source == "free" and len(t) > 100 and rnd.random() < 0.05:
                t = t[: rnd.randrange(60, len(t) - 2)]  # a short line alone may be a heading
            if t != full and not t.rstrip().endswith("."):
                cut[k] = "transfer" if source == "free" else "limit"
            rows.append((k, t, source))
    return rows, cut


def test_limits_and_kinds(spark, corpus):
    rows, cut = corpus
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "d int, body string, s string, n_chars int, id string")
    got = {r["id"]: r["how"] for r in T.truncated(df, "d", "body", "s").collect()}
    assert len(got) == len(rows)
    assert {k for k, v in got.items() if v} == set(cut)
    assert sum(got[k] == v for k, v in cut.items()) >= 0.97 * len(cut)
    found = {(r["source"], r["unit"], r["high"]) for r in T.limits(T.measured(df, "d", "body", "s")).collect()}
    assert ("chars", "chars", 500) in found
    assert ("bytes", "bytes", 600) in found
    assert not [f for f in found if f[0] in ("free", None)]
    shares = {r["source"]: r for r in T.by_source(T.truncated(df, "d", "body", "s")).collect()}
    assert shares["chars"]["cut_by_limit"] == sum(1 for k, v in cut.items() if rows[k - 1][2] == "chars")
    assert shares[None]["share"] == 0


def test_complete_texts_at_the_limit_are_no_cases(spark, corpus):
    rows = [*corpus[0], *[(10_000 + i, "x" * 499 + ".", "chars") for i in range(30)]]
    got = T.truncated(spark.createDataFrame(rows, "d int, t string, s string"), "d", "t", "s")
    assert got.where("id >= 10000 and how is not null").count() == 0




def test_the_histogram_decides_rows(spark):
    """The same text is cut at a length where its source has a spike, and isn't where it has none."""
    text = "It rained in the port. " * 9 + "\n- one: a per b\n- two: c per"
    rnd = random.Random(4)
    rows = [(i, text, "limited") for i in range(20)] + [(100 + i, prose(rnd, rnd.randrange(20, 150)), "limited") for i in range(50)]
    spread = [(i, text if i == 0 else prose(rnd, rnd.randrange(20, 400)), "limited") for i in range(70)]
    frame = lambda r: spark.createDataFrame(r, "d int, t string, s string")
    how = lambda r: {x["id"]: x["how"] for x in T.truncated(frame(r), "d", "t", "s").collect()}
    assert {k for k, v in how(rows).items() if v} == set(range(20))
    assert not [k for k, v in how(spread).items() if v]


def test_columns_have_limits_of_their_own(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, 500)[:200], prose(rnd, rnd.randrange(20, 400)), "s") for i in range(60)]
    got = T.truncated(spark.createDataFrame(rows, "d int, a string, b string, column string"), "d", ["a", "b"], "column")
    by = {r["column"]: r for r in T.by_source(got).collect()}
    assert set(by) == {"a", "b"} and by["a"]["texts"] == by["b"]["texts"] == 60
    assert by["a"]["cut_by_limit"] > 50 and by["b"]["cut_by_limit"] == by["b"]["cut_in_transfer"] == 0


def test_long_last_lines(spark):
    long = "word " * 400
    finished = ["It rained.\n- " + long + "end", "It rained.\r\n12. " + long, "See https://a.example/" + "x" * 900, "It rained.\nTags: " + "soil, " * 200 + "port"]
    middle = "It rained and " + "- " * 295 + "then it stopp"  # its last 600 characters begin like an item of a list
    texts = [*finished, *("a" * k + middle for k in range(3)), "x" * 700 + " Then it " + "e" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["o"] for r in T.with_open(df, "t", "o").collect()] == [False] * len(finished) + [True] * 4


def test_very_long_and_empty(spark):
    df = spark.createDataFrame([(1, "word " * 200_000, "a"), (2, "word " * 200_000 + "end.", "a")], "d int, t string, s string")
    assert {r["id"]: r["how"] for r in T.truncated(df, "d", "t", "s").collect()} == {1: "transfer", 2: None}
    assert T.truncated(df.limit(0), "d", "t", "s").count() == 0
    assert T.by_source(T.truncated(df.limit(0), "d", "t", "s")).count() == 0
