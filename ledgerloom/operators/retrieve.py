"""Nearest neighbours and fuzzy matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import similarity, text
from ledgerloom.session import materialise, ship_package

#: Vectors of either side that are held in a worker at once.
BLOCK = 20_000


def top_neighbours(queries: DataFrame, index: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, neighbour_id, score, rank) by cosine, ties by the smaller id; the query's own id is left out.

    Both sides are dealt into blocks of bounded size; each pair of blocks is a matrix product in one worker, which keeps the
    best k per query, and the pairs' candidates are merged by window. No side is broadcast, and a worker holds two blocks,
    whatever the number of queries or vectors.
    """
    ship_package(queries.sparkSession)
    across, down = (max(1, -(-df.count() // block)) for df in (queries, index))

    def dealt(df: DataFrame, name: str, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        rows = df.select(F.col(id_col).cast("long").alias(name), F.col(vector).cast("array<double>").alias("vector"), F.pmod(F.xxhash64(id_col), F.lit(own)).cast("long").alias(mine))
        return rows.withColumn(theirs, spread)

    left, right = dealt(queries, "query_id", across, down, "q", "x"), dealt(index, "id", down, across, "x", "q")

    def unit(rows: pa.Table) -> np.ndarray:
        out = np.array(rows["vector"].to_pylist(), dtype=np.float64)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1.0)

    def best(q: pa.Table, x: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "neighbour_id": [], "score": []}
        if q.num_rows and x.num_rows:
            ids, asked, vectors = x["id"].to_numpy(), q["query_id"].to_numpy(), unit(x)
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            every = unit(q)
            for a in range(0, len(asked), 1024):
                scores = np.round(every[a : a + 1024] @ vectors.T, 9)
                if exclude_self:
                    scores[asked[a : a + 1024, None] == ids[None, :]] = -2.0
                keep = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                for r, cols in enumerate(keep):
                    for c in cols[scores[r, cols] > -2.0]:
                        out["query_id"].append(int(asked[a + r])), out["neighbour_id"].append(int(ids[c])), out["score"].append(float(scores[r, c]))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "neighbour_id": pa.array(out["neighbour_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = left.groupBy("q", "x").cogroup(right.groupBy("q", "x")).applyInArrow(best, "query_id long, neighbour_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def few_shot_block(neighbours: DataFrame, examples: DataFrame, key: str = "query_id") -> DataFrame:
    """the neighbours' example lines in order of rank, under one heading."""
    own = neighbours.join(examples, neighbours["neighbour_id"] == examples["id"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return own.select(key, F.concat(F.lit("Similar examples:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))


def prefix_grams(names: DataFrame, column: str, frequency: DataFrame, least: float) -> DataFrame:
    """``names`` with each of the gram keys of which two names share one if their ratio reaches ``least``.

    With s = least / 100 a pair of lengths m and n has a common subsequence of s * (m + n) / 2, and so at least
    (1.5 * s - 1) * (m + n) - 1 common bigrams; then they share one even among their rarest bigrams, all but that many
    (less one). Short names, of which that says nothing, share their key with all short ones.
    """
    s = least / 100
    length, bigrams = F.length(column), F.greatest(F.length(column) - 1, F.lit(0))
    # of equal bigrams the first, the second, ... count as different ones
    listed = F.transform(F.sequence(F.lit(1), F.greatest(bigrams, F.lit(1))), lambda k: F.substring(F.col(column), k, F.lit(2)))
    counted = F.transform(listed, lambda g, k: F.concat(g, F.size(F.filter(F.slice(listed, F.lit(1), k + 1), lambda x: x == g)).cast("string")))
    common = F.floor((1.5 * s - 1) * (1 + s / (2 - s)) * length - 1)
    rows = names.withColumns({"_grams": counted, "_common": common}).withColumn("_short", F.col("_common") < 1)
    each = rows.filter("NOT _short").select(column, "_common", F.explode("_grams").alias("gram")).join(frequency, "gram", "left")
    ranked = each.groupBy(column, "_common").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    keys = ranked.select(column, F.explode(F.slice("g", F.lit(1), (F.size("g") - F.col("_common") + 1).cast("int"))).alias("x")).select(column, F.col("x.gram").alias("key"))
    longest = (2 / s - 1) * 2 / ((1.5 * s - 1) * (1 + s / (2 - s)))  # partners of the names for which the bound is below 1
    return keys.unionByName(names.filter(length <= longest).select(column, F.lit("").alias("key")))


def bigrams_of(names: DataFrame, column: str) -> DataFrame:
    listed = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - 1, F.lit(1))), lambda k: F.substring(F.col(column), k, F.lit(2)))
    counted = F.transform(listed, lambda g, k: F.concat(g, F.size(F.filter(F.slice(listed, F.lit(1), k + 1), lambda x: x == g)).cast("string")))
    return names.select(F.explode(counted).alias("gram"))


def canonical_names(names: DataFrame, reference: DataFrame, name: str, ref: str, key: str, least: float = 80.0) -> DataFrame:
    """(key, name, best, score, canonical): the most similar reference by the ratio of sorted words, accents folded; it
    replaces the name from a score of ``least`` (above 67) on. Empty names stay; the first reference in order wins ties.

    Names are compared once per distinct spelling. Those equal to a reference need no comparison; the others meet the
    references that share one of their rarest bigrams, which every pair of that score does (:func:`prefix_grams`).
    """
    ship_package(names.sparkSession)
    spelt = names.select(F.col(name).alias("_n")).filter(text.truthy("_n")).distinct().withColumn("_a", similarity.sorted_words(text.fold_accents(F.col("_n"))))
    refs = reference.select(F.col(ref).alias("_r")).filter(text.truthy("_r")).distinct().withColumn("_b", similarity.sorted_words(text.fold_accents(F.col("_r"))))
    spelt, refs = materialise(spelt, "spellings"), materialise(refs.groupBy("_b").agg(F.min("_r").alias("_r")), "references")
    equal = spelt.join(refs, spelt["_a"] == refs["_b"]).select("_n", "_r", F.lit(100.0).alias("_s"))
    rest = materialise(spelt.join(refs, spelt["_a"] == refs["_b"], "left_anti"), "other-spellings")
    own = rest.select("_a").distinct()
    frequency = materialise(bigrams_of(refs, "_b").unionByName(bigrams_of(own, "_a")).groupBy("gram").agg(F.count("*").alias("n")), "bigrams")
    pairs = prefix_grams(own, "_a", frequency, least).join(prefix_grams(refs.select("_b"), "_b", frequency, least), "key").select("_a", "_b").distinct()
    alike = pairs.withColumn("_s", similarity.indel_ratio("_a", "_b")).filter(F.col("_s") >= least)
    close = alike.join(refs, "_b").groupBy("_a").agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col("_r").alias("r"))).alias("m"))
    best = equal.unionByName(rest.join(close, "_a").select("_n", F.col("m.r").alias("_r"), (-F.col("m.s")).alias("_s")))
    out = names.join(best, names[name] == best["_n"], "left")
    return out.select(F.col(key), F.col(name), F.col("_r").alias("best"), F.col("_s").alias("score"), F.coalesce("_r", F.col(name)).alias("canonical"))


def without_leakage(index: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    """Index rows whose key is not evaluated."""
    return index.join(evaluated.select(key).distinct(), key, "left_anti")


def embed_stub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Embedding adapter boundary: a deterministic stand-in, hashed character trigrams of (id, text)."""
    for b in batches:
        out = []
        for t in b.column(1).to_pylist():
            v = np.zeros(64)
            t = (t or "")[:1500]
            for k in range(len(t) - 2):
                v[sum(ord(c) * (31**i) for i, c in enumerate(t[k : k + 3])) % 64] += 1
            out.append(v.tolist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "embedding"])


def cosine(a: Column, b: Column) -> Column:
    """Of two array columns; null for a zero vector."""
    return similarity.dot(a, b) / F.nullif(F.sqrt(similarity.dot(a, a)) * F.sqrt(similarity.dot(b, b)), F.lit(0.0))
