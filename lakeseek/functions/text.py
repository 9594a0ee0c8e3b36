"""Text expressions: key normalisation, column names, tokens. All are JVM expressions but the exact Unicode variant."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Longest key that is stored as it is; a longer one is stored as its beginning and a hash of the whole.
KEY_LENGTH = 335
_HASH_LENGTH = 64
#: Feature suffixes in the order in which a column's features stand.
SUFFIXES = ("mean", "median", "max", "min", "nunique", "share")


def _plain(code: int) -> str:
    return unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()


# Characters that one ASCII letter or digit stands for: Latin letters with marks, width forms; derived, not listed.
_FOLDED = {chr(c): _plain(c) for r in (range(0xAA, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F)) for c in r if len(_plain(c)) == 1}


def normalize_key(c: Column, strict: bool = False) -> Column:
    """A key as it is compared: without ``.0``, in lower case, accents folded, letters and digits of ASCII only.

    ``strict`` removes ``.0`` only at the end; otherwise it goes wherever it stands, so 1.05 and 15 meet. A null stays
    null; a text without letters and digits gives an empty one. Characters that fold to several letters are dropped;
    ``normalize_key_exact`` spells them out.
    """
    c = c.cast("string")
    c = F.regexp_replace(c, r"\.0$", "") if strict else F.replace(c, F.lit(".0"), F.lit(""))
    folded = F.translate(F.lower(c), "".join(_FOLDED), "".join(_FOLDED.values()))
    return F.regexp_replace(F.lower(folded) if any(v.isupper() for v in _FOLDED.values()) else folded, "[^a-z0-9]", "")


def stored_key(c: Column) -> Column:
    """The normalised key in at most ``KEY_LENGTH`` characters; different keys stay different."""
    key = normalize_key(c)
    short = F.concat(F.substring(key, 1, KEY_LENGTH - _HASH_LENGTH), F.sha2(key, 256))
    return F.when(F.length(key) > KEY_LENGTH, short).otherwise(key)


def normalize_text(s: str) -> str:
    """The same for one string, spelling out compatibility characters."""
    s = unicodedata.normalize("NFKD", s.replace(".0", "").lower()).encode("ascii", "ignore").decode()
    return "".join(ch for ch in s if ch.isalnum())


@F.pandas_udf(StringType())  # a type object, as text would need a session on import
def normalize_key_exact(s: pd.Series) -> pd.Series:
    """``normalize_key`` with every compatibility character spelled out; goes through Python."""
    return s.map(lambda x: None if x is None else normalize_text(x))


def column_names(names: list[str]) -> list[str]:
    """Normalised column names; the second and further ones of a name get their position and ``v2``."""
    out: list[str] = []
    for at, name in enumerate(map(normalize_text, names)):
        out.append(f"{name}{at}v2" if name in out else name)
    return out


def base_column(feature: Column) -> Column:
    """The column that a feature was made from: without the suffix of its aggregate; powers keep theirs."""
    return F.regexp_replace(feature, f"_(?:{'|'.join(SUFFIXES)})(?=$|\\^)", "")


def base_name(feature: str) -> str:
    return re.sub(f"_(?:{'|'.join(SUFFIXES)})(?=$|\\^)", "", feature)


def snake_case(c: Column) -> Column:
    """camelCase and anything else to lower case words joined by underscores."""
    split = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.trim(F.lower(F.regexp_replace(split, r"[^A-Za-z0-9]+", "_")), F.lit("_"))


# Words without content, as they are written in lower case.
STOP_WORDS = "a the of on in an and is at are as be but by for it no not or such that their there these to was with they will v ve d".split()


def clean_text(c: Column) -> Column:
    """The ASCII words of a text without stop words, one blank between them; other characters vanish, case stays."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9]+", " ")
    words = F.filter(F.split(F.trim(plain), " +"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.array_join(words, " ")


def is_token(c: Column) -> Column:
    """Whether a value may take part in set overlap: not null, not blank, not digits alone."""
    return c.isNotNull() & (F.trim(c) != "") & ~c.rlike("^[0-9]+$")
