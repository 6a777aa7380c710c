"""Functions that SQL may call once :func:`register` has run (section 2.11): F11, F12, F15 and A25."""

from __future__ import annotations

import random
import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ledgerloom.functions import similarity
from ledgerloom.session import ship_package


@pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("point", "lower", "upper")]))
def bootstrap_interval(values: pd.Series) -> pd.DataFrame:
    """A25 over arrays of numbers: the mean's percentile interval, 2000 resamples, seed 42; nulls are left out."""
    from ledgerloom.operators.evaluate import bootstrap_values

    rows = []
    for own in values:
        kept = sorted(float(x) for x in own if x is not None and x == x) if own is not None else []
        rows.append(bootstrap_values(kept, random.Random(42)) if kept else (None, None, None))
    return pd.DataFrame(rows, columns=["point", "lower", "upper"], dtype="float64")


#: What ``\\s`` matches and what ``trim`` takes off in the SQL form, the latter Unicode's space separators.
SQL_BLANK = re.compile("[\t\n\f\r ]+")
SQL_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def lower_letters(x: str) -> str:
    """Lower case of each letter by itself, one for one: no final sigma, a dotted capital I becomes i."""
    return x.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()


def normalise_text(x: str, form: str | None = None) -> str:
    if form == "sql":
        return lower_letters(SQL_BLANK.sub(" ", x).strip(SQL_SPACES))
    return " ".join(unicodedata.normalize("NFC", x).split()).lower()


def fold_text(x: str, form: str | None = None) -> str:
    if form == "sql":
        bare = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c)[0] != "M")
        return lower_letters(unicodedata.normalize("NFC", bare))
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()


def _each(f, values: pd.Series, forms: pd.Series | None) -> pd.Series:
    rows = zip(values, [None] * len(values) if forms is None else forms, strict=True)
    return pd.Series([None if x is None else f(x, form) for x, form in rows], dtype="object")


@pandas_udf(T.StringType())
def normalise(values: pd.Series, forms: pd.Series = None) -> pd.Series:
    """NFC, trimmed, runs of white space as one blank, lower case. Of the form 'sql' is what ``lower(trim(regexp_replace(x,
    '\\s+', ' ', 'g')))`` gives in the oracle: code points as they are, only ASCII white space runs together."""
    return _each(normalise_text, values, forms)


@pandas_udf(T.StringType())
def fold(values: pd.Series, forms: pd.Series = None) -> pd.Series:
    """decomposed, without combining marks, lower case. Of the form 'sql' is what ``lower(strip_accents(x))`` gives in the
    oracle: canonical decompositions alone (a ligature stays one), and marks that take up space go too."""
    return _each(fold_text, values, forms)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names."""
    ship_package(spark)
    own = {"normalise_string": normalise, "fold_accents": fold, "word_error_rate": similarity.word_error_rate, "indel_ratio": similarity.indel_ratio, "bootstrap_interval": bootstrap_interval}
    for name, f in own.items():
        spark.udf.register(name, f)
    return sorted(own)
