import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fields, similarity, text


def values(spark, rows, *columns):
    """Each row's results, in order, for a text column ``x``."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("k", *columns).orderBy("k").collect()]


def test_numbers(spark):
    raw = ["1 200,50", "1.200,50", "1200.50", "0,99", "42", "3.14", None, "", "1.200", "1.20", "12,", "-1.234.567", "1 200,5", "abc", "1.2.3"]
    assert values(spark, raw, text.clean_number("x")) == [1200.5, 1200.5, 1200.5, 0.99, 42.0, 3.14, None, None, 1200.0, 1.2, 12.0, -1234567.0, 1200.5, None, None]
    assert values(spark, ["None", "null", " 5 "], text.parse_number_flexible("x")) == [None, None, 5.0]


def test_dates(spark):
    raw = ["24.12.2023", "24. 12. 2023", "1/2/24", "1-2-85", "2023-12-24", "31.2.2024", "soon", None, ""]
    day = dt.date
    assert values(spark, raw, text.parse_date("x")) == [day(2023, 12, 24), day(2023, 12, 24), day(2024, 2, 1), day(1985, 2, 1), day(2023, 12, 24), None, None, None, None]
    assert values(spark, ["2023-12-24", "2023.12.24", "24/12/2023", "24-12-2023", "none"], text.parse_date_flexible("x")) == [day(2023, 12, 24)] * 3 + [None, None]


def test_identifiers(spark):
    assert values(spark, ["CZ 123", "12345678", "123456789", "none", None], text.clean_tax_id("x")) == ["00000123", "12345678", None, None, None]
    assert values(spark, ["a-1 b", "--", None], text.clean_point_code("x")) == ["a1b", None, None]
    assert values(spark, ["859182400000000001", "85918240000000000", "27zg123456789012"], text.valid_ean("x"), text.valid_eic("x")) == [(True, False), (False, False), (False, True)]


def test_strings(spark):
    assert values(spark, ["  Čau   Světe ", "é"], text.normalise_string("x")) == ["čau světe", "é"]
    assert values(spark, ["Plzeň", "ŽLUŤ"], text.fold_accents("x")) == ["plzen", "zlut"]
    assert values(spark, ["a/Fakturá__scan_q2_17.pdf", "x__scan_q1_2.png"], text.normalise_stem("x")) == ["faktura", "x"]
    assert values(spark, ["1 200,50 Kč", "1.200,50", "x", None], text.normalise_value("x", "float")) == ["1200.50", "1200.50", "x", None]
    assert values(spark, ["5.1.2024", "2024-01-05", "x"], text.normalise_value("x", "date")) == ["2024-01-05", "2024-01-05", "x"]
    assert values(spark, ["", "aa", "ab"], F.round(text.shannon_entropy("x"), 6)) == [0.0, 0.0, 1.0]
    assert values(spark, ["UnknownFont", "GID+7", "Arial", "", "F1", "Helvetica-Bold"], text.invisible_font("x"), text.invisible_font("x", "hybrid")) == [
        (True, True), (True, True), (True, False), (True, True), (True, False), (False, False)]


def test_json_repair(spark):
    got = values(spark, ['{"a": "1"}', 'sure: {"a": "2"} end', "none", None], text.json_object("x", "a string").getField("a"))
    assert got == ["1", "2", None, None]


def test_similarity(spark):
    df = spark.createDataFrame([("Faktura 1", "faktura  1", 1), ("abc", "abd", 2), ("", "", 3), (None, "x", 4)], "a string, b string, k int")
    rows = df.select(similarity.exact_match(F.col("a"), F.col("b")), F.round(similarity.char_error_rate(F.col("a"), F.col("b")), 4), similarity.word_error_rate("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(True, 0.0, 0.5), (False, 0.3333, 1.0), (True, 0.0, 0.0), (False, None, None)]


def _plain_distance(p, q):
    row = list(range(len(q) + 1))
    for i, u in enumerate(p, 1):
        diagonal, row[0] = row[0], i
        for j, v in enumerate(q, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (u != v))
    return row[-1]


def test_edit_distance_is_that_of_the_plain_table():
    r = random.Random(5)
    for _ in range(600):
        p, q = ([str(r.randrange(4)) for _ in range(r.randint(0, 20))] for _ in range(2))
        near = [x for x in p if r.random() > 0.1] + ["9"] * r.randint(0, 2)
        assert [similarity.edit_distance(p, x, b) for x in (q, near) for b in (1, 3, 8192)] == [_plain_distance(p, x) for x in (q, near) for _ in range(3)]


def test_word_error_rate_of_long_texts():
    """Texts of 30,000 words: the last one changed, the first one missing, every one another, turned round. The whole table would be filled for minutes."""
    words = [str(k) for k in range(30_000)]
    others = [[*words[:-1], "#"], words[1:], ["x"] * 30_000, words[::-1]]
    began = time.perf_counter()
    got = similarity.word_error_rate.func(pd.Series([" ".join(words)] * 4), pd.Series([" ".join(x) for x in others]))
    assert list(got) == [1 / 30_000, 1 / 30_000, 1.0, 1.0] and time.perf_counter() - began < 30


@pytest.mark.parametrize(("commodity", "n"), [("elektrina_nn", 14), ("elektrina_vn", 26), ("plyn_MO", 25), ("plyn_vo", 25), ("teplo", 17), ("voda", 15), ("other", 11)])
def test_registry(commodity, n):
    assert len(fields.fields_of(commodity)) == n
    assert len(fields.json_schema(commodity)["required"]) == n + 1
