import random

import numpy as np
import pytest

from lakeseek.llm import leakage as K
from lakeseek.llm import lookalike

F = lookalike.rewriter(K.all_rules())
VOCAB = [f"word{i}" for i in range(60)]


def brute(docs, items, n):
    ix = {}
    for i, t in items:
        w = K.words(t, F) if t else []
        for k in range(len(w) - n + 1):
            ix.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs if t for w in [K.words(t, F)] for k in range(len(w) - n + 1) for i in ix.get(tuple(w[k : k + n]), ())}


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(VOCAB) for _ in range(n))
    items = [(i, text(rnd.randrange(5, 40))) for i in range(30)] + [(90, None), (91, ""), (92, " ")]
    items.append((93, items[0][1]))  # one passage under two ids
    docs = []
    for d in range(200):
        parts = [text(rnd.randrange(60))]
        if d % 3 == 0:
            w = rnd.choice(items[:30])[1].split()
            n = rnd.randrange(8, 13)
            at = rnd.randrange(max(1, len(w) - n))
            parts.append(" ".join(w[at : at + n]))
        docs.append((d, " ".join([*parts, text(rnd.randrange(20))])))
    w = items[1][1].split()
    docs += [(300, None), (301, ""), (302, "short"), (303, " | ".join(items[0][1].upper().split())), (304, items[0][1].replace("o", "о").replace("d", "​d")), (305, "".join(chr(0xFF00 + ord(c) - 32) if c != " " else "\n" for c in items[0][1])), (306, " ".join(w[::-1])), (0, docs[0][1]), (307, "x " * 100_000 + items[0][1])]
    return docs, items


def frames(spark, tables):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in tables[0]], "d bigint, t string, id string, windows int")
    return docs, spark.createDataFrame([(*r, 2) for r in tables[1]], "i bigint, t string, text int")


@pytest.mark.parametrize(("window", "radius", "chars"), [(10, 3, 1 << 24), (10, 0, 1 << 24), (8, 3, 500), (5, 7, 1 << 24)])
def test_all_exact_passages(spark, tables, window, radius, chars):
    docs, items = frames(spark, tables)
    got = K.leaks(docs, "d", "t", items, "i", "t", window, radius, item_chars=chars)
    assert {(r["doc_id"], r["item_id"]) for r in got.where("same_passage").collect()} == brute(*tables, window)
    assert got.where("similarity < 0.8 or passage_similarity < 0.8").count() == 0


def test_near_windows_inside_the_radius(spark):
    w = [f"term{i}" for i in range(40)]
    changed = [*w[:20], "other", *w[21:]]
    docs = spark.createDataFrame([(1, " ".join(changed))], "d int, t string")
    items = spark.createDataFrame([(7, " ".join(w))], "i int, t string")
    got = K.leaks(docs, "d", "t", items, "i", "t", window=40, radius=12, least=0.7).collect()
    assert [(r["doc_id"], r["item_id"], r["same_passage"]) for r in got] == [(1, 7, False)]
    assert got[0]["passage_similarity"] == pytest.approx(K.similarity(w, changed))


def altered(rnd, words, changes):
    out = list(words)
    for _ in range(changes):
        at = rnd.randrange(len(out))
        kind = rnd.random()
        out[at : at + 1] = [] if kind < 0.2 else [out[at], "added"] if kind < 0.4 else ["changed"]
    return out


def best_passage(doc, item):
    return max(K.similarity(doc[max(p, 0) : p + len(item)], item) for p in range(1 - len(item), len(doc)))


def test_altered_items_are_found_whole(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: text(rnd.randrange(36, 200)) for i in range(40)}
    docs = {}
    for d in range(200):
        i = rnd.randrange(40)
        docs[d] = [*text(rnd.randrange(120)), *altered(rnd, items[i], rnd.randrange(5)), *text(rnd.randrange(120))]
    truth = {(d, i): s for d, w in docs.items() for i, t in items.items() if len({*zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)} & {*zip(t, t[1:], t[2:], t[3:], t[4:], strict=False)}) > 5 and (s := best_passage(w, t)) >= 0.8}
    frame = lambda rows, k: spark.createDataFrame([(a, " ".join(b)) for a, b in rows.items()], f"{k} int, t string")
    got = K.leaks(frame(docs, "d"), "d", "t", frame(items, "i"), "i", "t").where("similarity is not null").collect()
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert len(truth) > 100
    assert all(v >= 0.8 and (k not in truth or v <= truth[k] + 1e-9) for k, v in found.items())
    assert len(set(found) & set(truth)) >= 0.9 * len(truth)


def test_every_aligned_window_pair_is_looked_at():
    texts = [np.arange(n) for n in range(1, 700)]
    for window, members in K.by_length(texts, 10).items():
        for t in members.values():
            # any place of the item in a document has a looked-at window that equals one of the item's
            assert len(t) - window + 1 >= K.stride_of(window)
            assert window >= 0.75 * len(t)
    assert {len(t) for m in K.by_length(texts, 10).values() for t in m.values()} == set(range(10, 700))


def test_an_instruction_shared_by_many_items(spark):
    shared = " ".join(f"instruction{i}" for i in range(12))
    items = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(2000)], "i int, t string")
    docs = spark.createDataFrame([(1, f"a {shared} b {shared} c"), (2, "nothing of it")], "d int, t string")
    got = K.leaks(docs, "d", "t", items, "i", "t").collect()
    assert len(got) == 2000 and {(r["doc_id"], r["same_passage"], r["passages"]) for r in got} == {(1, True, 6)}


def test_blocks_find_every_fingerprint_in_the_radius():
    rnd = np.random.default_rng(0)
    words = K.Words()
    index = K.Passages([words.numbers([f"w{i}" for i in range(300)])], words, 10, 3).blocks
    flips = [sum(1 << int(b) for b in rnd.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4)]
    asked = np.array([int(index.prints[17]) ^ f for f in flips], np.uint64)
    a, b = index.near(asked)
    assert {int(x) for x, y in zip(a, b, strict=True) if y == 17} >= {0, 1, 2, 3}
    bits = np.bitwise_count(asked[:, None] ^ index.prints[None])
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(int(x), int(y)) for x, y in zip(*np.where(bits <= 3), strict=True)}


@pytest.mark.parametrize("window", [1, 2, 5, 8, 10, 13, 50, 255, 256, 300])
def test_fingerprint_is_the_majority_of_bits(window):
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, window + 20, dtype=np.uint64)
    got = K.fingerprints(h, window)
    assert len(got) == 21
    for k in range(21):
        want = 0
        for bit in range(64):
            if 2 * sum((int(x) >> bit) & 1 for x in h[k : k + window]) > window:
                want |= 1 << bit
        assert int(got[k]) == want
    assert len(K.fingerprints(h[: window - 1], window)) == 0


def test_portions():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 0, 5_000_000, 3, 4_000_000, 200_000, 7)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = [p.column(0).to_pylist() for p in K._portions(b)]
    assert [i for p in parts for i in p] == list(range(8))
    assert parts == [[0, 1], [2], [3, 4], [5, 6, 7]]


def test_empty_tables(spark, tables):
    docs, items = frames(spark, tables)
    assert K.leaks(docs.limit(0), "d", "t", items, "i", "t").count() == 0
    assert K.leaks(docs, "d", "t", items.limit(0), "i", "t").count() == 0
