import random

import pytest

from lakeseek.llm import truncation as T

LIMIT = 300
#: Ends without terminal punctuation that are finished at any other length.
EXEMPT = {
    "list": "\n- one: a per b\n- two: c per", "link": "\nSee https://notes.example/soil/54", "tags": "\nTags: soil, retu", "hashtag": "\nAll done.\n#soi",
    "signature": "\n\nKind regards\nPort Imbra data", "heading": " Soil extract: key and column overview 2025",
}


def padded(end, n):
    start = "It rained in the port. " * 40
    return start[: n - len(end) - 1].rstrip(" .").ljust(n - len(end) - 1, "x") + "." + end


@pytest.mark.parametrize("kind", EXEMPT)
def test_every_text_at_the_limit_is_cut(spark, kind):
    rnd = random.Random(3)
    rows = [(i, padded(EXEMPT[kind], LIMIT), "limited") for i in range(40)]
    rows += [(100 + i, padded("", LIMIT), "limited") for i in range(20)]
    rows += [(200 + i, padded("\n```\nselect 1\n```", LIMIT), "limited") for i in range(20)]
    rows += [(300 + i, padded(EXEMPT[kind], rnd.randrange(120, 240)), "limited") for i in range(60)]
    rows += [(400 + i, padded(EXEMPT[kind], 120 + 3 * i), "free") for i in range(60)]
    df = spark.createDataFrame(rows, "d int, t string, s string")
    got = {r["id"]: r["how"] for r in T.truncated(df, "d", "t", "s").collect()}
    assert {i for i, how in got.items() if how} == set(range(40))
    assert {got[i] for i in range(40)} == {"limit"}
