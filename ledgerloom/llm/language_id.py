"""Language ID (1): Bayesian evidence fusion of text, declared markup language, address suffix and host prior.

log P(l | all) = log P(l) + w * log P(text | l) + sum over pages (log P(l | host) / P(l) + log P(declared | l)) + const

Text likelihoods are multinomials over hashed byte n-grams, tempered to a fixed number of effective n-grams since
neighbouring ones are not independent. P(declared | l) is a smoothed table; the host prior is smoothed towards its parent
domain, that towards the address suffix, that towards the corpus, so each part of an address counts once; of an address
with nothing but a suffix, the suffix's own prior counts. All of these come from one grouped aggregation each over every
document's text posterior; labels train the text model and are no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import bounded, lean, small_batches, stash
from ledgerloom.llm.grams import class_counts, gram_buckets

GRAM, BITS = 3, 14
#: Labelled documents per language that the text model is fitted on: those with the least hashed ids.
PER_LANGUAGE = 2_000
#: What each bucket is counted in addition, in grams.
SMOOTHING = 0.1
#: Model entries that a task gathers at once; sampled ids up to which they are broadcast, and joined by shuffle beyond.
ENTRIES, BROADCAST_IDS = 2_000_000, 200_000
EFFECTIVE = 40.0
#: Weight of a parent's distribution in a host's prior, in documents; of uniform counts in the evidence tables.
PARENT_WEIGHT, TABLE_WEIGHT = 20.0, 1.0
#: Documents whose best language has less posterior than this are rejected.
CONFIDENT = 0.5
KINDS = ("declared", "host", "suffix")
#: The first <html> tag with a ``lang`` attribute, wherever it is. Possessive, and no tag crosses a "<": linear in the text.
HTML_LANG = r"""(?i)<html(?=\s)(?:[^<>"'\s]++|"[^"<]*+"|'[^'<]*+'|\s++(?!lang\s*+=))*+\s++lang\s*+=\s*+["']?([a-z]++)"""
#: Evidence terms are broadcast up to so many numbers, and joined by shuffle beyond.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class TextModel:
    """log P(bucket | language) of any number of languages: ``base`` of each language for buckets that its sample lacks, and
    by bucket (``starts``) the languages that have it with what that adds."""

    base: np.ndarray
    starts: np.ndarray
    classes: np.ndarray
    extra: np.ndarray

    @staticmethod
    def of(counts: pa.Table, languages: list[str]) -> TextModel:
        """``counts``: rows of class, bucket, n."""
        names = counts["class"].combine_chunks().dictionary_encode()
        place = {c: k for k, c in enumerate(languages)}
        classes = np.array([place[c] for c in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()] if len(names) else np.zeros(0, np.int32)
        buckets, n = counts["bucket"].to_numpy(), counts["n"].to_numpy().astype(float)
        base = np.log(SMOOTHING) - np.log(np.bincount(classes, n, len(languages)) + SMOOTHING * (1 << BITS))
        order = np.lexsort((classes, buckets))
        starts = np.concatenate(([0], np.cumsum(np.bincount(buckets, minlength=1 << BITS))))
        return TextModel(base, starts, classes[order], np.log((n + SMOOTHING) / SMOOTHING)[order])

    def sums(self, text: bytes) -> tuple[np.ndarray, int]:
        """log P(text | language) of each language, and the number of grams."""
        times = np.zeros(1 << BITS, np.int64) if len(text) > 1 << BITS else None
        if times is None:
            grams = [*gram_buckets(text, GRAM, BITS)]
            found, times = np.unique(grams[0], return_counts=True) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        else:
            for buckets in gram_buckets(text, GRAM, BITS):
                times += np.bincount(buckets, minlength=1 << BITS)
            found = np.flatnonzero(times)
            times = times[found]
        total, n = np.zeros(len(self.base)), int(times.sum())
        step = max(1, ENTRIES // len(self.base))  # entries that are gathered at once
        for k in range(0, len(found), step):
            first = self.starts[found[k : k + step]]
            sizes = self.starts[found[k : k + step] + 1] - first
            at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            total += np.bincount(self.classes[at], np.repeat(times[k : k + step], sizes) * self.extra[at], len(total))
        return total + n * self.base, n


def fit_text(docs: DataFrame, label_col: str, id_col: str, text_col: str) -> tuple[list[str], TextModel]:
    """All labels in order, and the text model from a bounded labelled sample of each."""
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.trim(label_col)).alias("class"), F.col(text_col).alias("text"))
    rows = rows.filter("_id IS NOT NULL AND class IS NOT NULL AND class <> '' AND class <> 'und' AND text IS NOT NULL")
    # The bin of hashes in which a label's sample is full, from counts per bin: only rows up to it are ranked.
    cell = F.shiftright(F.xxhash64("_id"), 52).alias("cell")
    cells = rows.groupBy("class", cell).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("cell")) - F.col("n")  # at most 4,096 rows per label
    last = stash(cells.withColumn("before", before).filter(F.col("before") < PER_LANGUAGE).groupBy("class").agg(F.max("cell").alias("last"), F.sum("n").alias("n")), "language-cells")
    languages = sorted(r["class"] for r in last.select("class").collect())
    if not languages:
        return ["und"], TextModel(np.zeros(1), np.zeros((1 << BITS) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0))
    near = rows.select("_id", "class", cell).join(F.broadcast(last.select("class", "last")), "class").filter("cell <= last")  # one row per label
    least = Window.partitionBy("class").orderBy(F.xxhash64("_id"), "_id")
    picked = near.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= PER_LANGUAGE).select("_id", "class").distinct()
    if last.agg(F.sum("n")).first()[0] <= BROADCAST_IDS:
        picked = F.broadcast(picked)
    counts = class_counts(rows.join(picked, ["_id", "class"]).select("class", "text"), GRAM, BITS).toArrow()
    return languages, TextModel.of(counts, languages)


def _log_shares(scores: np.ndarray) -> np.ndarray:
    scores = scores - scores.max()
    return scores - np.log(np.exp(scores).sum())


def _summed(rows: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """The arrays of ``column`` added up per group, element by element, with ``n`` as weight; summed before the shuffle."""
    each = rows.select(*by, "n", F.posexplode(column).alias("k", "x")).groupBy(*by, "k").agg(F.sum(F.col("x") * F.col("n")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias(out))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def _plus(a: Column, b: Column) -> Column:
    """The sum of two arrays; one that is null counts as zeros."""
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def _evidence(*columns: Column | None) -> list[Column]:
    return [F.lower(F.trim(c)).cast("string") if c is not None else F.lit(None).cast("string") for c in columns]


def _digest(declared: Column | None, host: Column | None, suffix: Column | None, text_col: str) -> Column:
    """A hash of the text and the evidence of a row, which also tells where nulls are."""
    parts = [F.col(text_col).cast("string"), *_evidence(declared, host, suffix)]
    return F.xxhash64(*parts, *[c.isNull() for c in parts])


def identify(
    docs: DataFrame, label_col: str = "lang", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
    pages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False,
) -> DataFrame:
    """One row per document: doc_id, language, confidence, text_language, n_grams, accepted; ``with_digest`` adds the
    digest of what the row is judged by (:func:`_digest`).

    ``label_col`` trains the text model; ``declared``, ``host`` and ``suffix`` are columns of evidence (null where there is
    none: that factor is left out); ``pages`` (see :func:`named_pages`) overrides them where it has a value: every page of
    a document adds its terms and counts for its host. Documents without text (null, empty or blank) get language 'und',
    confidence 0 and are rejected, as are those below CONFIDENT. Repeated rows are judged alike, null ids are allowed,
    other columns are ignored, no rows give no rows; without labels the only language is 'und'.
    """
    spark = docs.sparkSession
    small_batches(spark)
    languages, fitted = fit_text(docs, label_col, id_col, text_col)
    model = spark.sparkContext.broadcast(fitted)  # one number per language and bucket that its sample has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [f" {t} " if t and t.strip() else "" for t in b.column(1).to_pylist()]  # a gram for the shortest word
            sums = [model.value.sums(t.encode()) for t in texts]
            scores = [_log_shares(s * (min(n, EFFECTIVE) / n)) if n else np.zeros(len(s)) for s, n in sums]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.list_(pa.float64())), pa.array([n for _, n in sums], pa.int64()), *b.columns[2:]], ["doc_id", "scores", "n_grams", *KINDS, "digest"])

    given = dict(zip(KINDS, (declared, host, suffix), strict=True))
    evidence = [c.alias(n) for c, n in zip(_evidence(declared, host, suffix), KINDS, strict=True)]
    if host is not None and suffix is not None:  # a host's prior holds its suffix's
        evidence[2] = F.when(_evidence(host)[0].isNull(), _evidence(suffix)[0]).alias("suffix")
    digest = _digest(declared, host, suffix, text_col) if with_digest else F.lit(None).cast("long")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *evidence, digest.alias("digest"))
    scored = stash(picked.mapInArrow(lean(run), "doc_id long, scores array<double>, n_grams long, declared string, host string, suffix string, digest long"), "language-scores")
    base = scored
    paged = None
    if pages is not None:
        named = named_pages(pages).withColumn("suffix", F.when(F.col("host").isNull(), F.col("suffix")))
        found = named.select("doc_id", F.explode(F.create_map(*[x for c in KINDS for x in (F.lit(c), F.lower(c))])).alias("kind", "value"))
        paged = stash(found.filter("value IS NOT NULL").groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n")), "page-evidence")
        told = paged.groupBy("doc_id").agg(*[F.max(F.col("kind") == c).alias(f"page_{c}") for c in KINDS])
        base = scored.join(told, "doc_id", "left").withColumns({c: F.when(~F.coalesce(f"page_{c}", F.lit(False)), F.col(c)) for c in KINDS})

    shares = F.transform("scores", F.exp).alias("t")
    own = base.filter("n_grams > 0").select(F.explode(F.create_map(*[x for c in KINDS for x in (F.lit(c), F.col(c))])).alias("kind", "value"), F.lit(1).alias("n"), shares).filter("value IS NOT NULL")
    if paged is not None:
        own = own.unionByName(scored.filter("n_grams > 0").join(paged, "doc_id").select("kind", "value", "n", shares))
    counts = stash(_summed(own, ["kind", "value"], "t", "sums"), "language-counts")
    every = scored.filter("n_grams > 0").select(F.posexplode(shares).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    seen = np.zeros(len(languages))
    for r in every.collect():
        seen[r.k] = r.x
    corpus = (seen + 1) / (seen.sum() + len(languages))
    prior, log_prior = (F.array(*[F.lit(float(x)) for x in c]) for c in (corpus, np.log(corpus)))

    def smoothed(own: Column, above: Column) -> Column:
        total = _total(own)
        return F.zip_with(own, above, lambda n, a: (n + PARENT_WEIGHT * a) / (total + PARENT_WEIGHT))

    bare = F.regexp_replace("value", r":\d*$", "")
    hosts = counts.filter("kind = 'host'").select(
        F.col("value").alias("host"), F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1).alias("parent"), F.regexp_extract(bare, r"\.([^.]+)$", 1).alias("top"), F.lit(1).alias("n"), "sums"
    )
    alone = counts.filter("kind = 'suffix'").select(F.col("value").alias("top"), F.lit(1).alias("n"), "sums")
    tops = _summed(hosts.select("top", "n", "sums").unionByName(alone), ["top"], "sums", "s").select("top", smoothed(F.col("s"), prior).alias("s"))
    parents = _summed(hosts, ["top", "parent"], "sums", "p").join(tops, "top").select("top", "parent", smoothed(F.col("p"), F.col("s")).alias("p"))
    priors = hosts.join(parents, ["top", "parent"]).select(F.lit("host").alias("kind"), F.col("host").alias("value"), F.zip_with(smoothed(F.col("sums"), F.col("p")), log_prior, lambda h, c: F.log(h) - c).alias("term"))

    # log P(value | language) with the count of one more value, smoothed
    others = counts.filter("kind = 'declared'")
    totals = _summed(others.withColumn("n", F.lit(1)), ["kind"], "sums", "a").join(others.groupBy("kind").agg(F.count("*").alias("v")), "kind")  # one row
    likelihoods = others.join(F.broadcast(totals), "kind").select("kind", "value", F.zip_with("sums", "a", lambda n, a: F.log((n + TABLE_WEIGHT) / (a + TABLE_WEIGHT * (F.col("v") + 1)))).alias("term"))
    suffixes = tops.filter("top <> ''").select(F.lit("suffix").alias("kind"), F.col("top").alias("value"), F.zip_with("s", log_prior, lambda h, c: F.log(h) - c).alias("term"))
    terms = stash(priors.unionByName(likelihoods).unionByName(suffixes), "language-terms")
    if terms.count() * len(languages) <= BROADCAST_TERMS:
        terms = F.broadcast(terms)

    fused, joined = _plus(F.col("scores"), log_prior), base
    for c in KINDS:
        if given[c] is not None:
            joined = joined.join(terms.filter(F.col("kind") == c).select(F.col("value").alias(c), F.col("term").alias(f"{c}_term")), c, "left")
            fused = _plus(fused, F.col(f"{c}_term"))
    if paged is not None:
        joined = joined.join(_summed(paged.join(terms, ["kind", "value"]), ["doc_id"], "term", "page_term"), "doc_id", "left")
        fused = _plus(fused, F.col("page_term"))
    judged = joined.select("doc_id", "digest", "n_grams", "scores", fused.alias("q")).withColumn("top", F.array_max("q"))
    names, some = F.array(*[F.lit(x) for x in languages]), F.col("n_grams") > 0

    def best(scores: str, top: Column) -> Column:
        return F.when(some, F.element_at(names, F.array_position(scores, top).cast("int"))).otherwise("und")

    out = judged.select(
        "doc_id", best("q", F.col("top")).alias("language"),
        F.when(some, 1 / _total(F.transform("q", lambda x: F.exp(x - F.col("top"))))).otherwise(0.0).alias("confidence"),
        best("scores", F.array_max("scores")).alias("text_language"), "n_grams", *(["digest"] if with_digest else []),
    )
    return out.withColumn("accepted", (F.col("language") != "und") & (F.col("confidence") >= CONFIDENT))


def named_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, declared, host, suffix) of every page whose address names a document: its ``lang`` attribute and host."""
    doc = F.regexp_extract("url", r"://[^/?#]*/(?:[a-z]+/)?(\d{1,18})", 1)
    markup = F.regexp_extract("html", HTML_LANG, 1)
    found = pages.filter("url IS NOT NULL").select("page_id", doc.alias("doc"), F.nullif(markup, F.lit("")).alias("declared"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"))
    return found.filter("doc <> ''").select(F.col("doc").cast("long").alias("doc_id"), "page_id", "declared", "host", F.regexp_extract("host", r"([^.:]+)(?::\d+)?$", 1).alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, host, suffix) of the first of a document's pages."""
    first = named_pages(pages).groupBy("doc_id").agg(F.min(F.struct("page_id", "declared", "host", "suffix")).alias("p"))
    return first.select("doc_id", "p.declared", "p.host", "p.suffix")


def drop_rejected(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None,
    suffix: Column | None = None, **others,
) -> DataFrame:
    """The rows of ``docs`` whose language is accepted; of rows that share an id (or have none) each is judged by itself.
    Texts are not shuffled while the rejected rows can be broadcast."""
    own = {"declared": declared, "host": host, "suffix": suffix, "text_col": text_col}
    judged = identify(docs, id_col=id_col, with_digest=True, **own, **others).filter("NOT accepted")
    gone = judged.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("digest").alias("_digest")).distinct()
    number = F.col(id_col).cast("long")
    rows = docs.withColumns({"_id": F.coalesce(number, F.lit(0)), "_none": number.isNull(), "_digest": _digest(**own)})
    return rows.join(bounded(stash(gone, "rejected")), ["_id", "_none", "_digest"], "left_anti").select(*docs.columns)
