import os
import random

import pytest

from lakeseek.llm import encode as E

PATH = f"{E.VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabularies")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["Hello world", "  two  blanks ", "it's 12abc34 don't", "<|endoftext|> is text", "漢字かな 🙂 é", "a\r\nb\n\n c\t", "'s", "½②Ⅳ", "​ x", "\x00\x07"]


def test_ids_of_another_library():
    assert [E.encode(t, PATH) for t in TEXTS] == reference(TEXTS)


def test_cut_texts_have_the_same_ids_and_round_trip():
    rnd = random.Random(1)
    letters = list("ab1 2'  sst.,!\n\té漢🙂_-") + ["<|endoftext|>", "don't", "  "]
    for _ in range(500):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randrange(150)))
        whole = E.encoding(PATH).encode_ordinary(s)
        for size in (1, 7, 40):
            assert E.encode(s, PATH, size) == (whole if s else [])
            assert "".join(E.safe_parts(s, size)) == s
        assert E.decode(whole, PATH) == s


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000, "é" * 100_000, "word 12 " * 40_000, "!" * 100_000])
def test_very_long(text):
    ids = E.encode(text, PATH)
    assert E.decode(ids, PATH) == text


def test_table(spark):
    rows = [(1, t) for t in TEXTS] + [(2, None), (3, ""), (None, "x"), (3, "")]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "d bigint, t string, ids string, id int")
    got = E.with_ids(df, "d", "t", PATH)
    assert got.columns == ["d", "ids"]
    assert sorted(((r["d"], list(r["ids"])) for r in got.collect()), key=repr) == sorted(((i, E.encode(t, PATH)) for i, t in rows), key=repr)
    back = E.with_text(got, "d", "ids", PATH)
    assert sorted(((r["d"], r["text"]) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert E.with_ids(df.limit(0), "d", "t", PATH).count() == 0
