"""Sources: document folders, all-text CSV, JSON lines, tax-band files, tables, adapters."""

from __future__ import annotations

import csv
import datetime as dt
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import store

#: Accepted suffixes with their MIME types; size limit of an upload.
MIME = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tiff": "image/tiff", ".bmp": "image/bmp"}
UPLOAD_LIMIT = 50 << 20


def documents_in(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length, content, suffix, mime_type) of supported files, in any letter case; unreadable files are
    left out. A binary-file scan: paths are listed once, contents are read in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").load(folder)
    return supported(files)


def supported(files: DataFrame) -> DataFrame:
    """Files of an accepted suffix, with it and the MIME type."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    types = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return files.withColumn("suffix", suffix).withColumn("mime_type", F.try_element_at(types, F.col("suffix"))).filter("mime_type IS NOT NULL")


def judged_uploads(files: DataFrame, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Every file with a status: 202 taken, 415 wrong type, 413 too large."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumn("status", F.when(~suffix.isin(*MIME), 415).when(F.col("length") > limit, 413).otherwise(202))


def pending_transactions(files: DataFrame, at: str) -> DataFrame:
    """Rows to append to the transactions table for stored files."""
    return files.select(
        store.stored_name().alias("filename"), F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes"), "mime_type", F.lit("pending").alias("status"), F.lit(at).cast("timestamp").alias("created_at"),
    )


def csv_texts(spark: SparkSession, paths: str | list[str], sep: str | None = None) -> DataFrame:
    """Every column a text, names trimmed and lower-cased, ``_source_csv`` the file; copies (' copy' in the name)
    are left out. Without ``sep`` the header line of the first file decides between ; , tab and |."""
    if sep is None:
        first = spark.read.text(paths).limit(1).collect()
        header = first[0][0] if first else ""
        sep = max(";,\t|", key=header.count)
    df = spark.read.option("header", "true").option("inferSchema", "false").option("sep", sep).option("encoding", "UTF-8").csv(paths)
    named = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns]).withColumn("_source_csv", F.input_file_name())
    return named.filter(~F.col("_source_csv").contains("%20copy") & ~F.col("_source_csv").contains(" copy"))


def tagged_sets(sets: list[tuple[str, DataFrame]]) -> DataFrame:
    """United data sets, each with its name and the commodity from the file's stem."""
    from ledgerloom.operators.stats import union_by_name

    stem = F.regexp_extract("_source_csv", r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    return union_by_name([df.withColumns({"_dataset": F.lit(name), "_commodity": F.lower(F.regexp_replace(stem, "^ground_truth_", ""))}) for name, df in sets])


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S9"""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_file(spark: SparkSession, path: str) -> DataFrame:
    """A whole file of one document or an array."""
    return spark.read.option("multiLine", "true").json(path)


#: Names of commodities in tax-band files.
BAND_NAMES = {"elektrina nn": "elektrina_nn", "elektřina nn": "elektrina_nn", "elektrina vn": "elektrina_vn", "elektřina vn": "elektrina_vn", "plyn mo": "plyn_mo", "plyn vo": "plyn_vo", "teplo": "teplo", "voda": "voda"}


def bands_from_csv(content: str, names: dict[str, str] = BAND_NAMES) -> dict[str, list[tuple]] | None:
    """Two mirrored blocks, rows named by commodity and rows of (from, to, rate) in the same order; None if the
    blocks disagree. Only commodities whose bands leave no gap are meant to replace the built-in ones."""

    def day(s: str) -> dt.date | None:
        try:
            return dt.date.fromisoformat(s.strip())
        except ValueError:
            return None

    rows = [r for r in csv.reader(io.StringIO(content.lstrip("﻿")), delimiter=";") if any(c.strip() for c in r)]
    counts: dict[str, int] = {}
    triples = []
    for r in rows[1:]:
        if len(r) < 5:
            continue
        label = r[2].strip()
        if (commodity := names.get(label.lower())) is not None:
            counts[commodity] = counts.get(commodity, 0) + 1
        elif not label or day(label):
            try:
                triples.append((day(r[2]) or dt.date(2013, 1, 1), day(r[3]), float(r[4])))
            except ValueError:
                continue
    if not counts or sum(counts.values()) != len(triples):
        return None
    out, at = {}, 0
    for commodity, n in counts.items():
        out[commodity], at = triples[at : at + n], at + n
    return out


def gapless(bands: list[tuple]) -> bool:
    """W10 for one commodity: no day left out, only the last band open."""
    ordered = sorted(bands, key=lambda b: b[0])
    inner = all(a[1] is not None and b[0] <= a[1] + dt.timedelta(days=1) for a, b in zip(ordered, ordered[1:], strict=False))
    return bool(ordered) and inner and ordered[-1][1] is None


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational database, read in parallel if the options name a partition column."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    """Rows to a table of a relational database. Each task writes its rows in one transaction and rolls it back when it
    fails; connections are one per task, so their number is that of the partitions."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=name, batchsize=str(batch), isolationLevel="READ_COMMITTED", **options).save()


def from_bytes(spark: SparkSession, uploads: list[tuple[str, bytes]]) -> DataFrame:
    """Uploads held in memory (name, content) as rows of a binary scan; for single requests, not for bulk."""
    files = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in uploads], "path string, length long, content binary")
    return supported(files)


def render_adapter(files: DataFrame, render=None, schema: str = "path string, page int, image binary") -> DataFrame:
    """Pages as images by a caller's renderer over Arrow batches; without one, no pages (nothing here can draw)."""
    if render is None:
        return files.sparkSession.createDataFrame([], schema)
    return files.select("path", "content").mapInPandas(render, schema)


def text_layer(files: DataFrame, read=None) -> DataFrame:
    """(path, text, confidence, engine) from a caller's reader of text layers; confidence is 1 wherever it reads
    something. Without one, plain text files are decoded as UTF-8."""
    own = files.select("path", "content").mapInPandas(read, "path string, text string") if read else files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return own.withColumns({"confidence": F.when(F.length("text") > 0, 1.0).otherwise(0.0), "engine": F.lit("native")})


def suppliers_fixture(spark: SparkSession, seed: int = 42) -> DataFrame:
    """18 suppliers x 3 tiers x 3 customers of invoices that depend on the seed and the key alone."""
    base = spark.range(18).select(F.col("id").alias("supplier")).crossJoin(spark.range(3).select(F.col("id").alias("tier"))).crossJoin(spark.range(3).select(F.col("id").alias("customer")))  # 162 rows
    commodity = F.element_at(F.array(*map(F.lit, ("elektrina_nn", "elektrina_vn", "plyn_mo", "plyn_vo", "teplo", "voda"))), (F.col("supplier") % 6 + 1).cast("int"))
    own = base.select(F.format_string("SYN-%02d-%d-%d", "supplier", "tier", "customer").alias("invoice_number"), commodity.alias("commodity"), F.concat(F.lit("Q"), (F.col("tier") + 1).cast("string")).alias("quality"))
    start = F.date_add(F.lit("2023-01-01").cast("date"), F.floor(drawn("start", "invoice_number", seed) * 700 / 10_000).cast("int"))
    return own.withColumn("period_from", start).withColumn("period_to", F.date_add("period_from", F.floor(30 + drawn("days", "invoice_number", seed) * 335 / 10_000).cast("int")))


def drawn(what: str, key: str, seed: int) -> Column:
    """A number from 0 to 9,999 that seed, purpose and key alone decide."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000


#: Least and largest consumption and unit price by commodity, and the rate of tax in percent.
AMOUNT_RANGES = {
    "elektrina_nn": (1500, 12_000, 4.5, 6.5, 21),
    "elektrina_vn": (30_000, 180_000, 1.8, 5.5, 21),
    "plyn_mo": (2000, 30_000, 1.8, 3.2, 21),
    "plyn_vo": (50_000, 400_000, 1.2, 2.0, 21),
    "teplo": (10, 80, 450.0, 750.0, 21),
    "voda": (80, 600, 68.0, 95.0, 12),
}


def with_amounts(invoices: DataFrame, key: str = "invoice_number", seed: int = 42) -> DataFrame:
    """Synthetic invoices with consumption, unit price, amounts, advances (in hundreds) and balance, drawn from the
    commodity's ranges by :func:`drawn`."""
    spark = invoices.sparkSession
    ranges = spark.createDataFrame([(c, *r) for c, r in AMOUNT_RANGES.items()], "commodity string, _low int, _high int, _least double, _most double, vat_rate int")

    draw = lambda what: drawn(what, key, seed)
    own = invoices.join(F.broadcast(ranges), "commodity")
    # whole numbers up to the last step: prices in ten-thousandths, amounts in hundredths, halves rounded up
    own = own.withColumn("consumption", (F.col("_low") + F.floor((F.col("_high") - F.col("_low")) * draw("consumption") / 10_000)).cast("long"))
    own = own.withColumn("_price", F.round(F.col("_least") * 10_000).cast("long") + F.floor(F.round((F.col("_most") - F.col("_least")) * 10_000).cast("long") * draw("price") / 10_000))
    own = own.withColumn("_ex", F.floor((F.col("consumption") * F.col("_price") + 50) / 100)).withColumn("_vat", F.floor((F.col("_ex") * F.col("vat_rate") + 50) / 100))
    own = own.withColumn("_advances", F.floor((F.col("_ex") + F.col("_vat")) * (7000 + F.floor(draw("advances") * 6 / 10)) / 100_000_000) * 10_000)
    money = {"unit_price": F.col("_price") / 10_000, "amount_ex_vat": F.col("_ex") / 100, "vat_amount": F.col("_vat") / 100, "amount_inc_vat": (F.col("_ex") + F.col("_vat")) / 100, "advances": F.col("_advances") / 100, "balance": (F.col("_ex") + F.col("_vat") - F.col("_advances")) / 100}
    return own.withColumns(money).drop("_low", "_high", "_least", "_most", "_price", "_ex", "_vat", "_advances")
