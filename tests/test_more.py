import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import io_queries
from ledgerloom.functions import fields, registered, similarity, text
from ledgerloom.operators import classify, evaluate, layout, retrieve, stats
from ledgerloom.queries import ORACLES
from ledgerloom.sources import readers, sinks


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == lcs(a, b)


@pytest.mark.parametrize("least", [80.0, 90.0])
def test_canonical_names_equal_all_pairs(spark, least):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 24))) for _ in range(60)] + ["ČEZ Prodej", "E.ON Energie", "ab", "a b c", "aaaaaaaaaaaa", "abababababab"]
    names = []
    for n in base:
        for _ in range(4):
            own = list(n)
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(own))
                own[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "b "])
            names.append("".join(own))
    names += ["", None, "cez  PRODEJ", "aaaaaaaa"]
    key = lambda s: " ".join(sorted("".join(c for c in __import__("unicodedata").normalize("NFKD", s) if not __import__("unicodedata").combining(c)).lower().split()))
    got = {r.id: (r.best, r.score) for r in retrieve.canonical_names(spark.createDataFrame(list(enumerate(names)), "id int, n string"), spark.createDataFrame([(b,) for b in base], "r string"), "n", "r", "id", least).collect()}
    for k, n in enumerate(names):
        scored = []
        for r in base if n else ():
            a, b = key(n), key(r)
            score = 100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b))
            if r and score >= least:
                scored.append((-score, r))
        expected = min(scored) if scored else None
        assert got[k][0] == (expected[1] if expected else None), (n, got[k], expected)
        assert expected is None or got[k][1] == pytest.approx(-expected[0])


def test_neighbours_do_not_hang_on_blocks(spark):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)], "vec_id long, embedding array<double>")
    whole = sorted(retrieve.top_neighbours(vectors.filter("vec_id < 30"), vectors, 3).collect())
    assert sorted(retrieve.top_neighbours(vectors.filter("vec_id < 30"), vectors, 3, block=7).collect()) == whole and len(whole) == 90


def test_exact_quantiles_and_medians(spark, monkeypatch):
    monkeypatch.setattr(stats, "LAST", 5)
    monkeypatch.setattr(stats, "CELLS", 3)
    rng = random.Random(4)
    for values in ([rng.gauss(0, 100) for _ in range(500)], [5.0] * 40, [1.0, 2.0], [rng.randrange(4) * 1.0 for _ in range(99)], [1e300, -1e300, 0.0] * 7, []):
        df = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values)] + [(0, None), (1, float("nan"))], "g int, v double")
        ordered = sorted(values)
        for share in (0, 1 / 3, 0.5, 0.99, 1):
            place = share * (len(ordered) - 1)
            low = int(place)
            expected = None if not ordered else ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (place - low)
            got = stats.quantiles(df, "v", [share])[0]
            assert got == (expected if expected is None else pytest.approx(expected)), (share, values[:3])
        for r in stats.medians(df.filter("NOT isnan(v)"), ["g"], "v").collect():
            own = sorted(v for k, v in enumerate(values) if k % 2 == r.g)
            assert r.median == pytest.approx((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)


def test_line_passes_agree(spark):
    rng = random.Random(5)
    rows = [(d, p, f"w{rng.randrange(99)}", rng.randrange(500), rng.randrange(200), rng.randrange(5, 60), rng.randrange(0, 14)) for d in range(6) for p in range(3) for _ in range(rng.randrange(1, 60))]
    words = spark.createDataFrame(rows, layout.WORDS).repartition(5)
    one = sorted(layout.column_lines(words).select("doc_id", "page", "line", "text", F.size("segments").alias("n")).collect())
    two = sorted(layout.line_segments(layout.group_lines(words)).select("doc_id", "page", "line", "text", F.size("segments").alias("n")).collect())
    assert one == two and len(one) > 18
    assert layout.column_lines(words.limit(0)).count() == 0 and layout.json_light(layout.column_lines(words.limit(0))).count() == 0


def test_entropy(spark):
    got = [r[0] for r in spark.createDataFrame([("aabb",), ("",), (None,), ("aaaa",), ("abcdefgh",)], "t string").select(F.round(text.shannon_entropy("t"), 9)).collect()]
    assert got == [1.0, 0.0, None, 0.0, 3.0]


def test_votes():
    with pytest.raises(ValueError, match="unknown strategy"):
        classify.vote("other", *[F.lit("x")] * 4)


def test_registered_functions(spark):
    assert registered.register(spark) == ["bootstrap_interval", "fold_accents", "indel_ratio", "normalise_string", "word_error_rate"]
    row = spark.sql("SELECT normalise_string(' Á  b') AS n, fold_accents('Žluť') AS f, word_error_rate('a b', 'a c') AS w, indel_ratio('ab', 'abcd') AS r, bootstrap_interval(array(1D, 2D, 3D, NULL)) AS i").first()
    assert (row.n, row.f, row.w) == ("á b", "zlut", 0.5) and row.r == pytest.approx(200 / 3)
    point, low, high = evaluate.bootstrap_values([1.0, 2.0, 3.0], random.Random(42))
    assert tuple(row.i) == (point, low, high)


def test_sql_functions_equal_their_sql_on_odd_texts(spark, tmp_path):
    """Last words that already are '#', other white space than blanks and line feeds, no words, no text, decomposed letters, marks, ligatures."""
    rng = random.Random(6)
    odd = {
        "a b #\n": ("a b #", "a b #\n", 0.333333333), "#": ("#", "#", 1.0), "a\tb c\r\n": ("a b c", "a\tb c\r\n", 0.5), "": ("", "", None), " \n": ("", " \n", 1.0), None: (None, None, None),
        "\u00a0A\u00a0b\u2028": ("a\u00a0b\u2028", "\u00a0a\u00a0b\u2028", 1.0), "e\u0301 \ufb01 \u00bd": ("e\u0301 \ufb01 \u00bd", "e \ufb01 \u00bd", 0.333333333), "\u039f\u03a3 \u0130": ("\u03bf\u03c3 i", "\u03bf\u03c3 i", 0.5), "x" * 200_000: ("x" * 200, "x" * 200, 1.0),
    }
    texts = [*odd, *("".join(rng.choice("aB# \n\t\r\x0b\u00a0\u2028\u0301\u00c9\u03a3\u0130\ufb01\u0903") for _ in range(rng.randrange(12))) for _ in range(2000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in io_queries.sql_functions(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert [r[1:] for r in got[: len(odd)]] == list(odd.values())
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as oracle:
        oracle.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == oracle.execute(f"{ORACLES['sql_functions']} ORDER BY doc_id").fetchall()


def test_truth_record_of_every_commodity(spark):
    truth = spark.createDataFrame([("x", " 7 ", "1,5", None)], "pdf string, invoice_number string, total_amount_ex_vat string, due_date string")
    for c in fields.COMMODITIES:
        row = fields.truth_record(truth, c, "pdf").first().asDict()
        assert list(row)[1:] == [n for n, _, _ in fields.fields_of(c)]
        assert row["invoice_number"] == "7" and row.get("amount_ex_vat", "1.50") == "1.50" and row["due_date"] == ""


def test_jdbc_round_trip(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(k, f"n{k}") for k in range(20)], "id int, name string").repartition(1)
    readers.write_jdbc(df, url, "things", **options)
    readers.write_jdbc(df.withColumn("id", F.col("id") + 20), url, "things", **options)
    read = readers.jdbc_table(spark, url, "things", partitionColumn="id", lowerBound="0", upperBound="40", numPartitions="3", **options)
    assert read.rdd.getNumPartitions() == 3 and read.count() == 40


def test_text_reports(spark):
    own = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 3)], "field_name string, f1 double, n int")
    assert sinks.field_report(own, "F").split("\n")[2].split() == ["b", "0.2500", "3"]
    effects = spark.createDataFrame([("a", "b", 0.1, "small"), ("a", "c", -0.9, "large")], "group_a string, group_b string, d double, effect string")
    assert sinks.effect_report(effects).split("\n")[1].split() == ["a", "c", "-0.9000", "large"]
    intervals = spark.createDataFrame([("g", 1.0, 0.5, 1.5, 9)], "g string, point double, lower double, upper double, n long")
    assert "1.0000 [0.5000, 1.5000]" in sinks.interval_report(intervals, "g")


def test_surfaces():
    from ledgerloom.plans import surfaces

    assert surfaces.implementation("classifier", "v1") is classify.classify_v1
    with pytest.raises(KeyError, match="available: .*regex"):
        surfaces.implementation("strategy", "none")
    with pytest.raises(KeyError, match="available: .*ingestor"):
        surfaces.implementation("none", "x")
    surfaces.register("classifier", "own", len)
    assert surfaces.implementation("classifier", "own") is len
    del surfaces.SURFACES["classifier"]["own"]
