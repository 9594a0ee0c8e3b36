"""Token ids of a corpus by a public byte-level BPE given as a local rank file, and the way back.

Texts go to Python in Arrow batches and come back as arrays of integers; nothing is shuffled. A worker loads the rank
file once. A very long text is cut before it is encoded, at places where no token can cross: the pattern that splits a
text into pieces never joins across them, so the ids are those of the whole text, while the pieces stay short.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; the same path on every machine.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: how byte-level BPE splits a text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters are cut.
LONG = 1 << 16
#: A place ahead of one space between two visible characters, or between a letter and a digit: a piece always ends there.
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    """The tiktoken encoding of a rank file: base64 of the bytes and the rank on each line; no special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> list[str]:
    """The text in parts of about ``size`` characters, cut only at safe places; a text without any stays whole."""
    if len(text) <= size:
        return [text]
    cuts, at = [0], 0
    while at + size < len(text) and (m := _SAFE.search(text, at + size)):
        at = m.start()
        cuts.append(at)
    return [text[a:b] for a, b in pairwise([*cuts, len(text)])]


def encode(text: str | None, path: str, size: int = LONG) -> list[int]:
    """Ids of one text; null and empty give none. Strings of special tokens are ordinary text."""
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, size) for i in enc.encode_ordinary(part)]


def decode(ids: list[int] | None, path: str) -> str:
    """The text of the ids: their bytes are joined first, as one character may be spread over several ids."""
    enc = encoding(path)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids or []).decode("utf-8", "replace")


def with_ids(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``id_col`` and ``ids`` (array of integers) of every row; null and empty texts have an empty array.

    One row per row, repeated ones too; null ids of rows are kept. An empty table gives an empty one. Other columns are
    ignored and don't reach Python.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A slice at a time, as ids take several times the room of their text.
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = pa.array([encode(t.as_py(), path) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def with_text(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """``id_col`` and ``text`` of every row, decoded from its ids; null and empty arrays give an empty text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([decode(i.as_py(), path) for i in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
