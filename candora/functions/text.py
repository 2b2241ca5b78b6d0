"""Text expressions: accent folding and tokens."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"


PLAIN = r"[^\x{0}-\x{bb}\x{bf}-\x{131}]"  # nothing outside this class folds to several characters
_MERGE_GAP = 64  # neighbouring ranges this close become one: fewer, coarser regex ranges


def _is_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str]:
    """Characters folding to one character, their targets, and a regex class covering those folding to several.

    Derived from the Unicode data of the interpreter: compatibility decomposition without combining marks.
    Combining marks come last in the first string, without a target, so ``translate`` deletes them. Characters
    that neither are nor fold to word characters only separate tokens and are left out of the class.
    """
    single, target, marks, ranges = [], [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if 0xD800 <= point <= 0xDFFF:
            continue
        if unicodedata.combining(char):
            marks.append(char)
            continue
        folded = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        if len(folded) == 1:
            if folded[0] != char:
                single.append(char)
                target.append(folded[0])
        elif _is_word(char) or any(map(_is_word, folded)):
            if ranges and point - ranges[-1][1] <= (_MERGE_GAP if point > 0x590 else 1):
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    several = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
    return "".join(single + marks), "".join(target), several


def strip_accents(text: Column) -> Column:
    """Drop combining marks after compatibility decomposition, as far as word tokens are concerned.

    Characters that fold to one character are translated in the JVM. Only texts holding one that folds to
    several (ligatures, Hangul, fractions) take the vectorised Python path; all others send it a null.
    """
    single, target, several = _folding()

    @F.pandas_udf("string")
    def decompose(values: pd.Series) -> pd.Series:
        import unicodedata as u

        def fold(value):
            if value is None:
                return None
            return "".join(c for c in u.normalize("NFKD", value) if not u.combining(c))

        return values.map(fold)

    rare = F.when(text.rlike(PLAIN) & text.rlike(several), text)
    return F.coalesce(decompose(rare), F.translate(text, single, target))


def tokens(text: Column) -> Column:
    """Lower-cased, accent-free word tokens of two or more word characters, in order."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of the token array for n in [low, high], shorter ones first, joined by one space."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(words)
            continue
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        grams = F.transform(starts, _joined_slice(words, n))
        parts.append(F.coalesce(grams, F.array().cast("array<string>")))
    return F.concat(*parts)


def _joined_slice(words: Column, n: int):
    def at(start: Column) -> Column:
        return F.concat_ws(" ", F.slice(words, start, n))

    return at
