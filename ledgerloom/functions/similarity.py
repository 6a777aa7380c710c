"""Edit distances, match flags and vector products."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ledgerloom.functions import text


def error_rate(a: Column, b: Column) -> Column:
    """F16: edit distance over the longer length; two empty texts have 0, a null gives null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def exact_match(a: Column, b: Column, normal_form: bool = False) -> Column:
    same = text.normalise_string(a, normal_form) == text.normalise_string(b, normal_form)
    return F.coalesce(same, F.lit(False))


def char_error_rate(a: Column, b: Column, normal_form: bool = False) -> Column:
    """On normalised strings."""
    return error_rate(text.normalise_string(a, normal_form), text.normalise_string(b, normal_form))


def fuzzy_match(a: Column, b: Column, least: float = 0.9) -> Column:
    return F.coalesce(1 - char_error_rate(a, b) >= least, F.lit(False))


def numeric_match(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """F17"""
    return F.coalesce(F.abs(text.parse_number_flexible(a) - text.parse_number_flexible(b)) <= tolerance, F.lit(False))


def date_match(a: Column, b: Column) -> Column:
    """F17"""
    return F.coalesce(text.parse_date_flexible(a) == text.parse_date_flexible(b), F.lit(False))


def edit_distance(a: list[str], b: list[str], block: int = 8192) -> int:
    """Least number of units to insert, delete or replace. What both begin or end with is left out. Of the rest's table,
    ``a`` downwards and ``b`` across, the steps down a column lie in the bits of two whole numbers, ``block`` units of ``a`` at
    once; a block hands the next one the steps along its last row, so memory grows with the lengths, not with their product."""
    if len(a) > len(b):
        a, b = b, a
    start, end = 0, len(a)
    while start < end and a[start] == b[start]:
        start += 1
    over = len(b) - len(a)
    while start < end and a[end - 1] == b[end + over - 1]:
        end -= 1
    a, b = a[start:end], b[start : end + over]
    up, down = bytearray(b"\1") * len(b), bytearray(len(b))  # steps along the row above the block
    for at in range(0, len(a), block):
        part = a[at : at + block]
        places: dict[str, int] = {}
        for k, u in enumerate(part):
            places[u] = places.get(u, 0) | 1 << k
        full, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
        more, less = full, 0
        for j, v in enumerate(b):
            same = places.get(v, 0)
            level = same | less
            same |= down[j]
            cross = (((same & more) + more) ^ more) | same
            rise, fall = less | (full & ~(cross | more)), more & cross
            first_up, first_down = up[j], down[j]
            up[j], down[j] = rise & last != 0, fall & last != 0
            rise, fall = rise << 1 | first_up, fall << 1 | first_down
            more, less = (fall | ~(level | rise)) & full, rise & level & full
    return len(a) + sum(up) - sum(down)


def words_of(x: str, separators: str | None = None) -> list[str]:
    """What stands between white space, or between the given characters."""
    if not separators:
        return x.split()
    for c in separators[1:]:
        x = x.replace(c, separators[0])
    return list(filter(None, x.split(separators[0])))


@pandas_udf(T.DoubleType())
def word_error_rate(a: pd.Series, b: pd.Series, separators: pd.Series = None) -> pd.Series:
    """Edit distance with words as units, over the longer word count. Words end at white space, or at the characters of
    ``separators`` alone."""

    def rate(x: str | None, y: str | None, s: str | None = None) -> float | None:
        if x is None or y is None:
            return None
        p, q = words_of(x, s), words_of(y, s)
        return edit_distance(p, q) / max(len(p), len(q)) if p or q else 0.0

    return pd.Series([rate(*row) for row in (zip(a, b, strict=True) if separators is None else zip(a, b, separators, strict=True))], dtype="float64")


def sorted_words(c: Column | str) -> Column:
    """The words in order, joined by one blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), " ")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 columns and more at once in the bits of a whole number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the share of characters that insertions and deletions leave, of both texts together; 100 for two empty ones."""
    rows = [None if x is None or y is None else 100.0 if not x and not y else 200.0 * common_subsequence(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series(rows, dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """:func:`indel_ratio` of the texts with their words in order."""
    return indel_ratio(sorted_words(a), sorted_words(b))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in doubles."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column | str) -> Column:
    """divided by its length; a zero vector stays."""
    a = F.col(a) if isinstance(a, str) else a
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))
