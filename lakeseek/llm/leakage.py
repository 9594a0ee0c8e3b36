"""Passages of held-out items inside a corpus, whole or in part, exact or altered.

Windows of a document and of the items get a 64-bit SimHash of their words, in two layers. *Item-sized* windows find an
item that occurs as a whole, also with words changed: windows of nearly the item's length, in classes of lengths, at every
``stride``-th word of the document and at as many neighbouring words of the item, so that one pair is aligned. *Passage*
windows of ``window`` words, at every word, find a part of an item.

The fingerprints of the items are indexed by radius + 1 blocks of bits: two fingerprints that differ in at most radius
bits agree in at least one block, so looking up each block finds all of them. A pair inside the radius is then verified
exactly, on its words: by the weighted similarity of shingles of five words (a shingle weighs as often as it occurs), of the
whole item for the first layer and of the window for the second. Words are runs of letters or digits of the text's
look-alike form, without regard to case.

Documents are scanned where they lie, without a shuffle. The items go to every worker, in blocks of bounded size: one
block for an ordinary evaluation set, more passes over the corpus for a larger one. Equal texts of items and equal windows of
different items are held and compared once.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm import lookalike

_WORD = re.compile(r"[^\W_]+")
#: Characters of item text that a worker holds at once.
ITEM_CHARS = 1 << 23
#: Words whose bits are summed together.
CHUNK = 1 << 15
#: Bytes of text whose words are held together.
PORTION = 1 << 22
SHINGLE = 5
#: Bits in which item-sized windows of an altered item may differ; see README for the recall it gives.
ITEM_RADIUS = 10
#: A class of lengths is so many times the one before it; a document is looked at every length / STRIDES words.
LENGTH_STEP, STRIDES = 1.12, 12


@lru_cache(maxsize=1)
def all_rules() -> tuple[tuple[str, str], ...]:
    """Look-alike rules for every character; without a corpus the smallest code point represents a class."""
    return lookalike.fit(dict.fromkeys(range(lookalike.CODE_POINTS), 0))


def words(text: str, one_form) -> list[str]:
    return _WORD.findall(one_form(text).casefold())


class Words(dict):
    """Numbers of words from 0, and their 64-bit hashes."""

    def __init__(self) -> None:
        self.hashes, self.fixed = array("Q"), None

    def __missing__(self, word: str) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        self[word] = len(self)
        return len(self) - 1

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.hashes, np.uint64)[numbers] if len(numbers) else np.zeros(0, np.uint64)

    def fix(self) -> None:
        """What is known now stays; what comes later is forgotten when there is much of it."""
        self.fixed = len(self)

    def forget(self) -> None:
        if len(self) - self.fixed > 1 << 20:
            for w in [w for w, n in self.items() if n >= self.fixed]:
                del self[w]
            del self.hashes[self.fixed :]


def run_sums(hashes: np.ndarray, window: int) -> np.ndarray:
    """Row i: how often each bit is set in the window at i, for windows below 256; runs of doubled lengths are added up."""
    runs = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    n, sums, at = len(hashes) - window + 1, None, 0
    for k in range(window.bit_length()):
        if window >> k & 1:
            part = runs[at : at + n]
            sums = part.copy() if sums is None else np.add(sums, part, out=sums)
            at += 1 << k
        runs = runs[: -(1 << k)] + runs[1 << k :] if len(runs) > 1 << k else runs[:0]
    return sums


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Row i: how often each bit is set among the first i hashes."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return sums


def prints_at(sums: np.ndarray, first: int, count: int, window: int, stride: int = 1) -> np.ndarray:
    """SimHash of ``count`` windows from ``first`` on: a bit is set where more than half of the words have it."""
    last = first + (count - 1) * stride + 1
    set_ = 2 * (sums[first + window : last + window : stride] - sums[first:last:stride]) > window
    return np.packbits(set_, axis=1).view(np.uint64).ravel()


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every run of ``window`` word hashes."""
    n = len(hashes) - window + 1
    if n > 0 and window < 256:
        return np.packbits(run_sums(hashes, window) > window // 2, axis=1).view(np.uint64).ravel()
    return prints_at(bit_sums(hashes), 0, n, window) if n > 0 else np.zeros(0, np.uint64)


def majority(words: Words, rows: np.ndarray) -> np.ndarray:
    """SimHash of each row of word numbers."""
    sums = np.zeros((len(rows), 64), np.int32)
    for column in rows.T:
        sums += np.unpackbits(words.of(column).view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * sums > rows.shape[1], axis=1).view(np.uint64).ravel()


class Blocks:
    """Fingerprints by radius + 1 blocks of their bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.blocks = prints, radius, []
        edges = [round(64 * b / (radius + 1)) for b in range(radius + 2)]
        for low, high in zip(edges, edges[1:], strict=False):
            mask = np.uint64((1 << (high - low)) - 1)
            values = (prints >> np.uint64(low)) & mask
            order = np.argsort(values, kind="stable")
            values = values[order]
            # Where each value of a narrow block begins, in place of a search.
            begins = np.searchsorted(values, np.arange((1 << (high - low)) + 1, dtype=np.uint64)) if high - low <= 20 else None
            self.blocks.append((np.uint64(low), mask, values, order, begins))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in ``prints``, own place) whose fingerprints differ in at most ``radius`` bits."""
        left, right = [], []
        for low, mask, values, order, begins in self.blocks:
            asked = (prints >> low) & mask
            if begins is None:
                first, last = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
            else:
                asked = asked.astype(np.int64)
                first, last = begins[asked], begins[asked + 1]
            size = last - first
            hit = np.flatnonzero(size)
            for some in np.array_split(hit, max(1, int(size[hit].sum() >> 20))):
                n = size[some]
                a = np.repeat(some, n)
                b = order[np.arange(len(a)) + np.repeat(first[some] - np.cumsum(n) + n, n)]
                close = np.flatnonzero(np.bitwise_count(prints[a] ^ self.prints[b]) <= self.radius)
                left.append(a[close])
                right.append(b[close])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0) if left else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def _concatenated(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Passages:
    """All windows of ``window`` words of the items, equal ones folded into one, and the items that hold each."""

    stride = 1

    def __init__(self, texts: list[np.ndarray], words: Words, window: int, radius: int):
        self.window = window
        held = [np.lib.stride_tricks.sliding_window_view(t, window) for t in texts if len(t) >= window]
        of = _concatenated([np.full(len(t) - window + 1, i) for i, t in enumerate(texts) if len(t) >= window])
        rows = np.concatenate(held) if held else np.zeros((0, window), np.int64)
        self.rows, of_class = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([of_class.reshape(-1), of], axis=1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.items, self.begins = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.blocks = Blocks(_concatenated([majority(words, self.rows[i : i + CHUNK]) for i in range(0, len(self.rows), CHUNK)], np.uint64), radius)

    def verified(self, flat: np.ndarray, place: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Similarity of each pair, and whether it is the same passage."""
        same = np.ones(len(place), bool)
        for k in range(self.window):
            same &= flat[place + k] == self.rows[own, k]
        s = same.astype(float)
        for i in np.flatnonzero(~same):
            s[i] = similarity(flat[place[i] : place[i] + self.window].tolist(), self.rows[own[i]].tolist())
        return s, same


class Sized:
    """Windows of nearly the length of their item, for items of one class of lengths."""

    def __init__(self, texts: dict[int, np.ndarray], words: Words, window: int, radius: int):
        self.window, self.stride = window, stride_of(window)
        prints = {i: fingerprints(words.of(t), window) for i, t in texts.items()}
        self.item = _concatenated([np.full(len(p), i) for i, p in prints.items()])
        self.at = _concatenated([np.arange(len(p)) for p in prints.values()])
        self.blocks = Blocks(_concatenated([*prints.values()], np.uint64), radius)


def stride_of(window: int) -> int:
    return max(1, window // STRIDES)


def by_length(texts: list[np.ndarray], least: int) -> dict[int, dict[int, np.ndarray]]:
    """Window length of each class of lengths, and the items in it; items of fewer than ``least`` words are in none."""
    out: dict[int, dict[int, np.ndarray]] = {}
    longest = max(map(len, texts), default=0)
    lengths = [least]
    while lengths[-1] < longest:
        lengths.append(ceil(lengths[-1] * LENGTH_STEP))
    for i, t in enumerate(texts):
        fits = [n for n in lengths if n + stride_of(n) - 1 <= len(t)]
        if fits:
            out.setdefault(fits[-1], {})[i] = t
    return out


def similarity(a: list, b: list) -> float:
    """Weighted Jaccard similarity of the shingles of two word lists."""
    count = lambda t: Counter(tuple(t[i : i + SHINGLE]) for i in range(max(1, len(t) - SHINGLE + 1)))
    x, y = count(a), count(b)
    return (x & y).total() / (x | y).total()


class Index:
    """The items of a block in both layers."""

    def __init__(self, texts: list[list[str]], window: int, radius: int, least: float, item_radius: int | None):
        self.words, self.least = Words(), least
        self.texts = [self.words.numbers(t) for t in texts]
        self.words.fix()
        self.passages = Passages(self.texts, self.words, window, radius)
        self.sized = [] if item_radius is None else [Sized(t, self.words, n, item_radius) for n, t in by_length(self.texts, window).items()]
        self.longest = max([window, *(x.window for x in self.sized)])

    def pairs(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
        """(layer, document, place, own place) of the window pairs inside the radius; ``ends``: where documents end in ``flat``."""
        hashes = self.words.of(flat)
        step = max(CHUNK, 4 * self.longest)
        for at in range(0, len(flat), step):
            part = hashes[at : at + step + self.longest - 1]
            sums = bit_sums(part) if self.sized else None
            for layer in (self.passages, *self.sized):
                first = -at % layer.stride
                count = (min(len(part) - layer.window, step - 1) - first) // layer.stride + 1
                if count < 1 or not len(layer.blocks.prints):
                    continue
                if layer is self.passages:
                    prints = fingerprints(part[: step + layer.window - 1], layer.window)
                else:
                    prints = prints_at(sums, first, count, layer.window, layer.stride)
                place, own = layer.blocks.near(prints)
                place = at + first + place * layer.stride
                doc = np.searchsorted(ends, place, "right")
                inside = place + layer.window <= ends[doc]
                yield layer, doc[inside], place[inside], own[inside]

    def match(self, texts: list[list[str]]) -> Iterator[tuple[int, int, float | None, float | None, bool, int]]:
        """(document, item, item similarity, passage similarity, same passage, passages) of some documents."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat, ends = self.words.numbers([x for t in texts for x in t]), np.cumsum(sizes)
        hits, whole = [], {}
        for layer, doc, place, own in self.pairs(flat, ends):
            if layer is self.passages:
                s, same = layer.verified(flat, place, own, self.least)
                ok = s >= self.least
                hits.append(np.stack([doc[ok], own[ok], s[ok], same[ok]], axis=1))
                continue
            begin = place - layer.at[own]
            for d, i, p in set(zip(doc.tolist(), layer.item[own].tolist(), begin.tolist(), strict=True)):
                if whole.get((d, i), 0.0) < 1.0:
                    low, high = ends[d] - sizes[d], ends[d]
                    s = similarity(flat[max(p, low) : min(p + len(self.texts[i]), high)].tolist(), self.texts[i].tolist())
                    if s >= self.least:
                        whole[d, i] = max(s, whole.get((d, i), 0.0))
        self.words.forget()
        yield from self._rows(np.concatenate(hits) if hits else np.zeros((0, 4)), whole)

    def _rows(self, hits: np.ndarray, whole: dict[tuple[int, int], float]) -> Iterator[tuple]:
        # Places are summed by (document, window) before a window's items come in.
        keys, at, places = np.unique(hits[:, :2].astype(np.int64), axis=0, return_inverse=True, return_counts=True)
        best, same = np.zeros(len(keys)), np.zeros(len(keys), bool)
        np.maximum.at(best, at.reshape(-1), hits[:, 2])
        np.logical_or.at(same, at.reshape(-1), hits[:, 3] > 0)
        first = self.passages.begins[keys[:, 1]]
        n = self.passages.begins[keys[:, 1] + 1] - first
        item = self.passages.items[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
        pairs, of = np.unique(np.stack([np.repeat(keys[:, 0], n), item], axis=1), axis=0, return_inverse=True)
        of = of.reshape(-1)
        s, exact, windows = np.zeros(len(pairs)), np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        np.maximum.at(s, of, np.repeat(best, n))
        np.logical_or.at(exact, of, np.repeat(same, n))
        np.add.at(windows, of, np.repeat(places, n))
        for (d, i), x, e, w in zip(pairs.tolist(), s.tolist(), exact.tolist(), windows.tolist(), strict=True):
            yield d, i, whole.pop((d, i), None), x, e, w
        for (d, i), x in whole.items():
            yield d, i, x, None, False, 0


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``PORTION`` bytes of text, as words take many times the room; a longer text is a portion alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PORTION, "right")))
        yield batch.slice(at, end - at)
        at = end


NAMES = ["similarity", "passage_similarity", "same_passage", "passages"]


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, window: int = 10, radius: int = 3, least: float = 0.8, item_radius: int | None = ITEM_RADIUS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """Documents with item-sized passages, or windows of ``window`` words, like those of an item.

    Columns: ``doc_id``, ``item_id``; ``similarity``, of the whole item and the passage of the document that is most like
    it, null below ``least``; ``passage_similarity`` (best of the verified windows, null without one), ``same_passage``
    (whether the document holds ``window`` consecutive words of the item exactly) and ``passages`` (verified pairs of windows).

    All passage windows inside ``radius`` are verified, so every exact one is found; item-sized windows inside
    ``item_radius`` are, so altered items are found as far as their fingerprints lie inside it. ``item_radius=None``
    leaves the item-sized layer out.

    One row a document row and item row; documents and items written twice give equal rows. Null and empty texts and items of
    fewer than ``window`` words leak nothing; null ids are kept. Empty tables give no row. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    texts = asked.select("text").distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / item_chars))
    rules, kind = all_rules(), to_arrow_type(rows.schema["id"].dataType)
    out = None
    for k in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        listed = [r["text"] for r in part.collect()]  # bounded by item_chars
        held = docs.sparkSession.sparkContext.broadcast(listed)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            one_form = lookalike.rewriter(rules)
            index = Index([words(t, one_form) for t in held.value], window, radius, least, item_radius)
            for part in (p for b in batches for p in _portions(b)):
                got = list(index.match([words(t.as_py(), one_form) for t in part.column(1)]))
                if got:
                    d, i, *found = (pa.array(x) for x in zip(*got, strict=True))
                    kinds = (pa.float64(), pa.float64(), pa.bool_(), pa.int64())
                    found = [x.cast(t) for x, t in zip(found, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(d).cast(kind), i, *found], names=["doc_id", "__item", *NAMES])

        got = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['id']}, __item bigint, similarity double, passage_similarity double, same_passage boolean, passages bigint")
        numbered = docs.sparkSession.createDataFrame([*enumerate(listed)], "__item bigint, text string").join(asked, "text").select("__item", "item_id")
        got = got.join(numbered, "__item").select("doc_id", "item_id", *NAMES)
        out = got if out is None else out.unionByName(got)
    return out
