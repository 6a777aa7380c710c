"""Column functions for locale-specific numbers, dates, identifiers and strings.

Everything is a built-in expression (no Python per row) except the two Unicode normal forms, which Spark lacks; those are
Arrow UDFs. Expressions never raise under ANSI: unparsable input gives null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

BLANK = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Without any white space, no-break spaces included."""
    return F.regexp_replace(_col(c), BLANK, "")


def clean_number(c: Column | str) -> Column:
    """F1: '1 200,50', '1.200,50', '1200.50' -> 1200.5. A comma makes dots thousands separators, and so do groups of three
    digits after each dot; anything that is not a plain number then is null."""
    raw = squeeze(_col(c).cast("string"))
    dotted = raw.rlike(r"^-?\d{1,3}(\.\d{3})+$")
    plain = F.when(F.instr(raw, ",") > 0, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(dotted, F.replace(raw, F.lit("."), F.lit(""))).otherwise(raw)
    return F.when(plain.rlike(r"^-?\d+\.?\d*$"), plain.try_cast("double"))


def required_number(df: DataFrame, c: str, name: str = "number") -> tuple[DataFrame, DataFrame]:
    """the rows whose text is a number, with it as ``name``, and the rejected others with the reason."""
    own = df.withColumn(name, clean_number(c))
    rejected = own.filter(F.col(name).isNull()).withColumn("reason", F.concat(F.lit("not a number: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    return own.filter(F.col(name).isNotNull()), rejected.drop(name)


def parse_number_flexible(c: Column | str) -> Column:
    """The evaluation twin of F1: 'none' and 'null' are missing."""
    raw = F.trim(_col(c).cast("string"))
    return F.when(~F.lower(raw).isin("none", "null", ""), clean_number(raw))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _by_pattern(s: Column, pattern: str, order: str) -> Column:
    part = {k: F.regexp_extract(s, pattern, order.index(k) + 1) for k in "dmy"}
    year = part["y"]
    year = F.when(F.length(year) == 2, F.concat(F.when(year < "80", "20").otherwise("19"), year)).otherwise(year)
    return F.when(s.rlike(pattern), _date(year, part["m"], part["d"]))


def parse_date(c: Column | str) -> Column:
    """D.M.YYYY, D.M.YY (below 80: 20YY) or YYYY.M.D, with '/' and '-' as dots and blanks after dots; else null."""
    s = F.regexp_replace(F.translate(F.trim(_col(c).cast("string")), "/-", ".."), r"\.(?U)\s+", ".")
    return F.coalesce(_by_pattern(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "dmy"), _by_pattern(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$", "dmy"), _by_pattern(s, r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", "ymd"))


def parse_date_flexible(c: Column | str) -> Column:
    """ISO with '-' or '.' first, then D.M.YYYY and D.M.YY with dots or slashes; D-M-YYYY is not accepted."""
    raw = F.trim(_col(c).cast("string"))
    s = F.replace(F.regexp_replace(raw, r"\.(?U)\s+", "."), F.lit("/"), F.lit("."))
    found = F.coalesce(
        _by_pattern(raw, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ymd"), _by_pattern(raw, r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", "ymd"),
        _by_pattern(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "dmy"), _by_pattern(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$", "dmy"),
    )
    return F.when(~F.lower(raw).isin("none", "null", ""), found)


def safe_iso_date(c: Column | str) -> Column:
    """strict YYYY-MM-DD."""
    s = F.trim(_col(c).cast("string"))
    return _by_pattern(s, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ymd")


def safe_float(c: Column | str) -> Column:
    """comma as decimal point; null where it is no number."""
    return F.replace(F.trim(_col(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def clean_point_code(c: Column | str) -> Column:
    """letters and digits only; nothing left is null."""
    return F.nullif(F.regexp_replace(_col(c).cast("string"), "[^A-Za-z0-9]", ""), F.lit(""))


def clean_tax_id(c: Column | str) -> Column:
    """digits, padded to eight; none or more than eight are null."""
    digits = F.regexp_replace(_col(c).cast("string"), "[^0-9]", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 8), F.lpad(digits, 8, "0"))


def valid_ean(c: Column | str) -> Column:
    """eighteen digits that begin with 859."""
    return F.trim(_col(c).cast("string")).rlike(r"^859\d{15}$")


def valid_eic(c: Column | str) -> Column:
    """sixteen letters or digits that begin with 27ZG, in either case."""
    return F.upper(F.trim(_col(c).cast("string"))).rlike("^27ZG[A-Z0-9]{12}$")


def parse_is_correction(c: Column | str) -> Column:
    """F8: true, 1, yes or y, or anything with 'oprav'; null is false."""
    s = F.lower(F.trim(_col(c).cast("string")))
    return F.coalesce(s.isin("true", "1", "yes", "y") | s.contains("oprav"), F.lit(False))


def invoice_type(is_correction: Column, is_transitional: Column) -> Column:
    """a correction comes before a transitional invoice."""
    return F.when(F.coalesce(is_correction, F.lit(False)), "opravna").when(F.coalesce(is_transitional, F.lit(False)), "prechodova").otherwise("bezna")


def is_cross_year(start: Column, end: Column) -> Column:
    """the two ends lie in different years."""
    return F.coalesce(F.year(start) != F.year(end), F.lit(False))


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """decomposed, without combining marks, lower case."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())


def normalise_string(c: Column | str, normal_form: bool = True) -> Column:
    """NFC, trimmed, runs of white space as one blank, lower case."""
    s = nfc(_col(c)) if normal_form else _col(c)
    return F.lower(F.trim(F.regexp_replace(s, BLANK, " ")))


def file_stem(c: Column | str) -> Column:
    """The last part of a path without its extension."""
    name = F.regexp_extract(_col(c), r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def normalise_stem(c: Column | str) -> Column:
    """a file stem without the scan suffix, folded."""
    return fold_accents(F.regexp_replace(file_stem(c), r"__scan_q\d+_\d+$", ""))


def normalise_value(c: Column | str, kind: str) -> Column:
    """canonical text of an extracted value, by the registry's type."""
    raw = F.trim(_col(c).cast("string"))
    if kind == "float":
        bare = F.regexp_replace(squeeze(raw), "(?i)Kč|Kc|CZK", "")
        grouped = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        number = F.regexp_replace(F.when(bare.rlike(r"^\d{1,3}(\.\d{3})+,\d{2}$"), grouped).otherwise(F.replace(bare, F.lit(","), F.lit("."))), "[^0-9.-]", "")
        value = number.try_cast("double")
        return F.when(value.isNotNull(), F.format_string("%.2f", value)).otherwise(raw)
    if kind == "date":
        found = F.coalesce(_by_pattern(raw, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ymd"), _by_pattern(raw, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "dmy"), _by_pattern(raw, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "dmy"))
        return F.coalesce(F.date_format(found, "yyyy-MM-dd"), raw)
    return F.lower(squeeze(raw))


def format_amount(c: Column | str) -> Column:
    """two decimals, no separators."""
    return F.when(_col(c).isNotNull(), F.format_string("%.2f", _col(c).cast("double")))


def format_local_number(c: Column | str) -> Column:
    """no-break spaces between thousands, a decimal comma."""
    return F.translate(F.format_number(_col(c), 2), ",.", " ,")


def is_zero(c: Column | str) -> Column:
    """reads as a number equal to zero."""
    return F.coalesce(_col(c).try_cast("double") == 0, F.lit(False))


def truthy(c: Column | str, kind: str = "string") -> Column:
    """Null, empty text and (for numbers) zero count as missing."""
    c = _col(c)
    return F.coalesce(c != (0 if kind == "number" else ""), F.lit(False))


def present(c: Column | str) -> Column:
    """An extracted text that is neither empty nor a written-out null."""
    return F.coalesce(~_col(c).isin("", "None", "null"), F.lit(False))


def path_segment_after(c: Column | str, marker: str) -> Column:
    """the path segment that follows ``marker``; null if there is none."""
    parts = F.split(_col(c), r"[\\/]")
    at = F.array_position(parts, marker)
    return F.when(at > 0, F.try_element_at(parts, at.cast("int") + 1))


def shannon_entropy(c: Column | str) -> Column:
    """bits per character; empty text has 0. The characters are sorted, then their runs are counted in one pass."""
    chars = F.array_sort(F.filter(F.split(_col(c), ""), lambda x: x != ""))
    bits = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        same = s["last"] == x
        return F.struct(x.alias("last"), F.when(same, s["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + bits(s["run"])).alias("sum"), (s["n"] + 1.0).alias("n"))

    return F.aggregate(chars, start, step, lambda s: F.when(s["n"] > 0, F.log2(s["n"]) - (s["sum"] + bits(s["run"])) / s["n"]).otherwise(0.0))


def valid_code_point(c: Column | str) -> Column:
    """inside Unicode and no surrogate."""
    c = _col(c)
    return c.between(0, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)


#: What marks a font as invisible, by classifier generation.
INVISIBLE_MARKS = {"v2": ("unknown", "gid", "arial", "tdsr", "t1_0", "\x00"), "hybrid": ("unknown", "gid", "tdsr", "t1_0")}


def invisible_font(c: Column | str, generation: str = "v2") -> Column:
    """a marker in the name; for v2 also names of under three characters, or with a digit and under ten."""
    name = F.lower(_col(c))
    marked = F.lit(False)
    for m in INVISIBLE_MARKS[generation]:
        marked = marked | name.contains(m)
    if generation == "v2":
        marked = marked | (F.length(name) < 3) | (name.rlike(r"\d") & (F.length(name) < 10))
    return F.coalesce(name.isNull() | (name == "") | marked, F.lit(True))


def first_match(c: Column | str, patterns: list[str], group: int = 1) -> Column:
    """the trimmed group of the first pattern that matches, case-insensitive and multi-line; else null."""
    found = [F.btrim(F.regexp_extract(_col(c), f"(?iumU){p}", group), F.lit(" \t\r\n\u00a0")) for p in patterns]
    return F.coalesce(*[F.try_element_at(F.filter(F.array(m), lambda x: x != ""), F.lit(1)) for m in found])  # each pattern runs once


def all_matches(c: Column | str, patterns: list[str], group: int = 1) -> Column:
    """the groups of all matches, pattern after pattern."""
    return F.concat(*[F.regexp_extract_all(_col(c), F.lit(f"(?iumU){p}"), F.lit(group)) for p in patterns])


def json_object(c: Column | str, schema: str) -> Column:
    """the text as JSON, else from its first brace to its last; all null if neither parses."""
    inner = F.regexp_extract(_col(c), r"(?s)(\{.*\})", 1)
    whole = F.from_json(_col(c), schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(_col(c)).isNotNull(), whole).otherwise(F.from_json(inner, schema, {"mode": "PERMISSIVE"}))


def mean_of_map(c: Column | str) -> Column:
    """mean of the values that are not null, to four decimals; null if there are none."""
    values = F.filter(F.map_values(_col(c)), lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) > 0, F.round(total / F.size(values), 4))


def mean_logprob(tokens: Column | str) -> Column:
    """mean log-probability over value tokens, an array of (token, logprob); punctuation and blanks are structure."""
    own = F.filter(_col(tokens), lambda t: ~t["token"].rlike(r"^[\s{}\[\]\",:]*$"))
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, t: s + t["logprob"]) / F.size(own))


def token_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """prices are per million tokens."""
    return (prompt * price_in + completion * price_out) / 1e6


#: Fixed value: the constant exchange rate of the published evaluation.
USD_TO_CZK = 23.5


def usd_to_czk(c: Column | str) -> Column:
    """F24"""
    return _col(c) * USD_TO_CZK


def example_line(commodity: Column, fields: dict[str, Column]) -> Column:
    """'[commodity] name=value, ...' without empty values."""
    shown = [F.when(~F.lower(F.trim(v)).isin("", "nan", "none"), F.concat(F.lit(f"{k}="), v)) for k, v in fields.items()]
    return F.concat(F.lit("["), commodity, F.lit("] "), F.concat_ws(", ", *shown))


def digests(c: Column | str) -> dict[str, Column]:
    """MD5, SHA-1 and SHA-256 of a text or bytes, as lower-case hex."""
    return {"md5": F.md5(_col(c)), "sha1": F.sha1(_col(c)), "sha256": F.sha2(_col(c), 256)}


#: F35, fixed values: how many characters of a text each use takes.
CAPS = {"embedding": 1500, "entropy": 10_000, "prompt": 24_000, "reason": 80}


def capped(c: Column | str, use: str) -> Column:
    return F.substring(_col(c), 1, CAPS[use])
