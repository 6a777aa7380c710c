"""MinHash near-dedup (9): many universal hash minima, banding, signature verification, connected components.

1. One pass over the texts gives each document its shingle set's size, digest, minima and band keys. Documents with
   equal sets form a class (folded map-side), so exact copies never meet in a bucket.
2. Classes that share a band key meet in buckets; signatures that agree well enough are linked by a spanning forest, so
   a bucket of near copies gives one link per member, not all pairs. Large buckets are split into cells of block pairs.
3. Components of those candidate links are split the same way; there full shingle sets confirm or refute links until
   all pairs are connected or compared, again leaving a spanning forest. Components of these links are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import CACHES, bounded, by_group, lean, small_batches, stash
from ledgerloom.llm.components import components

#: Members of a bucket whose signatures meet in one task, and of a candidate component whose sets do.
BUCKET_CELL, SET_CELL = 2048, 512
WORDS_CACHED = 200_000
#: Chance to miss a pair at the threshold; minima that a document may cost for it.
MISS, MINIMA = 1e-5, 256


@dataclass(frozen=True)
class Banding:
    """``bands * per_band`` minima; two sets with similarity s share a band with probability 1 - (1 - s ** per_band) ** bands."""

    percent: int
    bands: int
    per_band: int
    seed: int = 20

    @staticmethod
    def for_percent(percent: int) -> Banding:
        """At the threshold itself a pair is missed with a chance below MISS: the longest bands for which no more than MINIMA
        minima do that, or bands of one."""
        s = percent / 100
        for per_band in range(12, 0, -1):
            bands = math.ceil(math.log(MISS) / math.log1p(-min(s, 0.999999) ** per_band))
            if bands * per_band <= MINIMA or per_band == 1:
                return Banding(percent, bands, per_band)
        raise AssertionError

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.per_band
        return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)

    @property
    def agreeing(self) -> int:
        """Minima that must agree for a candidate: five standard deviations below the threshold."""
        n, s = self.bands * self.per_band, self.percent / 100
        return max(1, int(n * s - 5 * (n * s * (1 - s)) ** 0.5))


_words: dict[bytes, int] = {}
CACHES["words"] = _words.clear


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, by way of a bounded cache."""
    import xxhash

    if len(_words) > WORDS_CACHED:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence if it is shorter."""
    size = min(size, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ ids[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text's words (A-Z lower-cased, split at ASCII white space)."""
    words = text.encode().lower().split()
    return np.unique(window_hashes(word_hashes(words), size)) if words else np.empty(0, np.uint64)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function a * x + b over the set, in blocks that fit the cache."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, (a[:, None] * x[None, k : k + 512] + b[:, None]).min(axis=1), out=out)
    return out


def band_keys(minimum: np.ndarray, bands: int) -> np.ndarray:
    rows = minimum.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1: ``linked(k, rest)`` says which of ``rest`` are linked with ``k``.

    Members found linked leave the rest at once, so a group of near copies costs about one comparison each.
    """
    rest, found, queue = np.arange(n), [], []
    while len(rest) or queue:
        if queue:
            k = queue.pop()
        else:
            k, rest = int(rest[0]), rest[1:]
        if not len(rest):
            break
        hit = linked(k, rest)
        new = rest[hit].tolist()
        found += [(k, x) for x in new]
        queue += new
        rest = rest[~hit]
    return found


def cells(df: DataFrame, group: str, members: str, member: str, most: int) -> DataFrame:
    """``df`` with a long column ``cell``: groups of up to ``most`` members are one cell, larger ones a cell for each
    pair of blocks, so that every two members of a group meet in some cell of bounded size."""
    blocks = F.ceil(F.col(members) / most)
    own = F.pmod(F.xxhash64(F.lit(7), member), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    split = df.withColumns({"_blocks": blocks, "_own": own}).withColumn("_other", other)
    ends = [F.least("_own", "_other"), F.greatest("_own", "_other")]
    return split.withColumn("cell", F.when(F.col("_blocks") == 1, F.xxhash64(group)).otherwise(F.xxhash64(group, *ends))).drop("_blocks", "_own", "_other")


def _links(docs: pa.Array, pairs: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not pairs:
        return None
    ids = docs.to_numpy()
    a, b = np.array(pairs).T
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def signatures(docs: DataFrame, banding: Banding, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest, minima, bands): digest, minima and bands are null for documents without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = banding.coefficients()
        for batch in batches:
            n, digest, least, bands = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t or "", size)
                n.append(len(s))
                if not len(s):
                    digest.append(None), least.append(None), bands.append(None)
                    continue
                m = minima(s, a, b)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                least.append((m & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                bands.append(band_keys(m, banding.bands))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(least, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "minima", "bands"],
            )

    schema = "doc_id long, n long, digest binary, minima binary, bands array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(lean(run, "words"), schema)


def candidate_links(classes: DataFrame, banding: Banding) -> DataFrame:
    """(a, b): a spanning forest of agreeing signatures in every bucket of a shared band key."""
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = stash(keys.join(shared, "key"), "buckets").join(classes.select("rep", "minima"), "rep")
    agreeing = banding.agreeing

    def compare(_: int, rows: pa.Table) -> pa.RecordBatch | None:
        sign = np.frombuffer(b"".join(rows["minima"].to_pylist()), np.uint16).reshape(rows.num_rows, -1)
        return _links(rows["rep"].combine_chunks(), forest(len(sign), lambda k, rest: (sign[rest] == sign[k]).sum(axis=1) >= agreeing))

    return by_group(cells(met, "key", "members", "rep", BUCKET_CELL).select("cell", "rep", "minima"), "cell", compare, "a long, b long")


def confirmed_links(docs: DataFrame, groups: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): a spanning forest of the links that full shingle sets confirm in each candidate component."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = groups.join(sizes, "component").withColumnRenamed("node", "doc_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(members.hint("merge"), "doc_id")  # alike at every size

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or "", size).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], ["doc_id", "component", "members", "sets"])

    sets = texts.select("doc_id", "component", "members", "text").mapInArrow(lean(as_sets, "words"), "doc_id long, component long, members long, sets binary")

    def compare(_: int, rows: pa.Table) -> pa.RecordBatch | None:
        own = [np.frombuffer(s, np.uint64) for s in rows["sets"].to_pylist()]
        lengths = np.array([len(s) for s in own])
        values, column = np.unique(np.concatenate(own), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        spans = [column[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        mark = np.zeros(len(values), np.int64)

        def linked(k: int, rest: np.ndarray) -> np.ndarray:
            close = 100 * np.minimum(lengths[rest], lengths[k]) >= percent * np.maximum(lengths[rest], lengths[k])
            hit = np.zeros(len(rest), bool)
            if close.any():
                mark[spans[k]] = 1
                near = rest[close]
                heads = np.concatenate(([0], np.cumsum(lengths[near])[:-1]))
                common = np.add.reduceat(mark[np.concatenate([spans[x] for x in near])], heads)
                hit[close] = 100 * common >= percent * (lengths[k] + lengths[near] - common)
                mark[spans[k]] = 0
            return hit

        return _links(rows["doc_id"].combine_chunks(), forest(len(own), linked))

    return by_group(cells(sets, "component", "members", "doc_id", SET_CELL).select("cell", "doc_id", "sets"), "cell", compare, "a long, b long")


def near_dedup(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; a component's id is its smallest
    document id and that document is kept. Fewer words than a shingle form one shingle; null, empty or wordless texts
    have no shingles, are linked with nothing and are kept. Rows of one id and equal shingles share a component; ids are
    the nodes of the links, so a further text of a repeated id may get the component of the other one's near copies
    (:func:`drop_near_copies` numbers such rows first). Null ids link with nothing (component null, not kept). Other
    columns are ignored; no rows give no rows.
    """
    banding = Banding.for_percent(percent)
    signed = stash(signatures(docs, banding, size, id_col, text_col), "signatures")
    with_words = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = stash(with_words.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("minima").alias("minima"), F.first("bands").alias("bands")), "classes")
    groups = components(candidate_links(classes, banding))
    linked = components(confirmed_links(docs, groups, percent, size, id_col, text_col))
    labels = classes.select("digest", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(labels, "digest", "left")
    found = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), found).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without(rows: DataFrame, id_col: str, judged: DataFrame) -> DataFrame:
    """The rows that are kept; texts are not shuffled while the ids to drop can be broadcast."""
    gone = stash(judged.filter("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")
    return rows.join(bounded(gone), id_col, "left_anti").select(*rows.columns)


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group.

    Rows without an id and further texts of a repeated id are documents of their own, which come after all ids: they
    stay unless they are near copies of another one.
    """
    digest = F.xxhash64(F.coalesce(text_col, F.lit("")))
    ids = docs.select(F.col(id_col).alias("_id"), digest.alias("_digest")).groupBy("_id").agg(F.min("_digest").alias("_first"), F.max("_digest").alias("_last"))
    odd = stash(ids.filter("_id IS NULL OR _first <> _last").select("_id", "_first"), "odd-ids")
    if odd.isEmpty():
        return without(docs, id_col, near_dedup(docs, percent, id_col=id_col, text_col=text_col))
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("_id", F.lit(0)), F.col("_id").isNull(), digest), 2)
    rows = docs.withColumn("_id", F.col(id_col)).join(odd.filter("_id IS NOT NULL"), "_id", "left")
    rows = stash(rows.withColumn("_row", F.when(F.col("_id").isNull() | (F.coalesce("_first", digest) != digest), late).otherwise(F.col("_id").cast("long"))), "numbered")
    return without(rows, "_row", near_dedup(rows, percent, id_col="_row", text_col=text_col)).select(*docs.columns)
