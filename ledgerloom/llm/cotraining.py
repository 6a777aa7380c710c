"""Quality classifier (3): co-training of a text view and a metadata view.

Two logistic models start from the same labelled documents. In each round each one labels the unlabelled documents it
is surest of for the other, then both are fitted again. A held-out part of the labels calibrates each view and weighs the
two; the combination scores every document. The labelled sample is bounded; each round scores the whole unlabelled corpus
in a distributed pass and takes the surest of all documents, as the final scoring is one more pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean, small_batches, stash
from ledgerloom.llm.grams import gram_buckets

GRAM, TEXT_BITS, META_BITS = 3, 10, 8
#: Labelled documents that the models are fitted on, those with the least hashed ids; they reach the driver as features.
LABELLED = 4_000
#: Labelled ids are broadcast up to so many, and joined by shuffle (with scores, not texts) beyond.
BROADCAST_IDS = 200_000
#: Documents are called bad only below this probability: losing a good one costs four times keeping a bad one.
LEAST = 0.2
ROUNDS, PER_ROUND, SURE = 4, 200, 0.9
SURE_LOGIT = float(np.log(SURE / (1 - SURE)))


def text_features(text: str) -> np.ndarray:
    """Hashed byte n-grams: square roots of their shares, so every text has length one; a constant last."""
    counts = np.zeros(1 << TEXT_BITS, np.int64)
    for buckets in gram_buckets(text.encode(), GRAM, TEXT_BITS):
        counts += np.bincount(buckets, minlength=1 << TEXT_BITS)
    out = np.ones((1 << TEXT_BITS) + 1, np.float32)
    out[:-1] = np.sqrt(counts / max(1, counts.sum()))
    return out


def meta_features(values: dict[str, object]) -> np.ndarray:
    """Hashed ``name=value`` indicators; numbers by order of magnitude; a constant last."""
    import xxhash

    out = np.zeros((1 << META_BITS) + 1, np.float32)
    out[-1] = 1
    for name, value in values.items():
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            value = round(float(np.log2(1 + abs(value))) * 2)
        out[xxhash.xxh3_64_intdigest(f"{name}={value}") >> (64 - META_BITS)] += 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 400) -> np.ndarray:
    """Weights by Nesterov's gradient descent; classes weigh the same."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1], np.float32)
        w[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    share = y.mean()
    sample = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    y = y.astype(np.float32)
    rate = np.float32(4.0 / float((x * x).sum(axis=1).max()))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50)))
        new = ahead - rate * (((p - y) * sample) @ x + np.float32(ridge) * ahead)
        w, ahead = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


@dataclass(frozen=True)
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    combine: np.ndarray  # weights of the text score, the metadata score and a constant

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = np.stack([text @ self.text, meta @ self.meta, np.ones(len(text))], axis=1)
        return np.stack([z[:, 0], z[:, 1], 1 / (1 + np.exp(-np.clip(z @ self.combine, -50, 50)))], axis=1)


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt scaling of both views at once: the weights by which their scores add up to a log-odds, none below zero."""
    if not len(y) or y.min() == y.max():
        return np.array([0.5, 0.5, 0.0])
    scale = z[:, :2].std(axis=0) + 1e-6
    x = np.concatenate([z[:, :2] / scale, np.ones((len(z), 1))], axis=1)
    w = np.zeros(3)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([max(w[0], 0.0) / scale[0], max(w[1], 0.0) / scale[1], w[2]])


#: In a round: per view the text features, the metadata features and the labels of the documents that it is surest of.
Picks = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> CoTrained:
    """:func:`exchange` over a pool held as arrays."""
    pools, free = (pool_text, pool_meta), np.ones(len(pool_text), bool)

    def choose(weights: list[np.ndarray]) -> Picks:
        out = []
        for own in (0, 1):
            z = pools[own] @ weights[own]
            sure = []
            for side in (z, -z):
                found = np.flatnonzero(free & (side >= SURE_LOGIT))
                sure.append(found[np.argsort(-side[found], kind="stable")][:PER_ROUND])
            picked = np.concatenate(sure)
            free[picked] = False
            out.append((pool_text[picked], pool_meta[picked], np.repeat([1.0, 0.0], [len(sure[0]), len(sure[1])])))
        return out

    return exchange(text, meta, y, choose)


def exchange(text: np.ndarray, meta: np.ndarray, y: np.ndarray, choose: Callable[[list[np.ndarray]], Picks]) -> CoTrained:
    """Rounds of exchanged pseudo-labels; every third labelled row only calibrates."""
    held = np.arange(len(y)) % 3 == 2
    train = [(text[~held], y[~held]), (meta[~held], y[~held])]
    weights = [fit_logistic(x, labels) for x, labels in train]
    for _ in range(ROUNDS):
        for own, (*features, labels) in enumerate(choose(weights)):
            other = 1 - own
            train[other] = (np.concatenate([train[other][0], features[other]]), np.concatenate([train[other][1], labels]))
        weights = [fit_logistic(x, labels) for x, labels in train]
    z = np.stack([text[held] @ weights[0], meta[held] @ weights[1]], axis=1)
    return CoTrained(weights[0], weights[1], calibrate(z, y[held]))


def _features(docs: DataFrame, meta: tuple[str, ...], text_col: str, extra: list[str]) -> DataFrame:
    """``extra`` columns with the two views' features as packed floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [c.to_pylist() for c in b.columns[len(extra) + 1 :]]
            texts = b.column(len(extra)).to_pylist()
            own = [text_features(t or "").tobytes() for t in texts]
            other = [meta_features({m: v[k] for m, v in zip(meta, values, strict=True)}).tobytes() for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(extra)], pa.array(own, pa.binary()), pa.array(other, pa.binary())], [*extra, "own", "other"])

    picked = docs.select(*extra, F.col(text_col).cast("string").alias("text"), *[F.col(m).alias(f"meta{k}") for k, m in enumerate(meta)])
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(lean(run), ", ".join(f"{c} {kinds[c]}" for c in extra) + ", own binary, other binary")


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(p) for p in packed), np.float32).reshape(-1, width) if packed else np.zeros((0, width), np.float32)


WIDTHS = (1 << TEXT_BITS) + 1, (1 << META_BITS) + 1


def surest(docs: DataFrame, named: DataFrame, weights: list[np.ndarray], taken: set[int], meta: tuple[str, ...]) -> list[list[tuple[int, float]]]:
    """(key, label) of the documents of ``docs`` (_id, _key, text, metadata) that each view is surest of, none of them
    ``taken`` or with an id in ``named``.

    One pass over the texts, then only ids and scores move. The text view chooses first, so the other one has as many more
    candidates as may be taken from it.
    """
    told = docs.sparkSession.sparkContext.broadcast((weights, taken))
    most = PER_ROUND, 3 * PER_ROUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (by_text, by_meta), gone = told.value
        for b in batches:
            values = [c.to_pylist() for c in b.columns[3:]]
            z = np.zeros((b.num_rows, 2))
            keys = b.column(1).to_pylist()
            for k, t in enumerate(b.column(2).to_pylist()):
                if keys[k] not in gone:
                    z[k] = text_features(t or "") @ by_text, meta_features({m: v[k] for m, v in zip(meta, values, strict=True)}) @ by_meta
            sure = pa.array((np.abs(z) >= SURE_LOGIT).any(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z[:, 0]), pa.array(z[:, 1])], ["_id", "_key", "z0", "z1"]).filter(sure)

    found = docs.mapInArrow(lean(run), f"_id {dict(docs.dtypes)['_id']}, _key long, z0 double, z1 double")
    found = stash(found.join(named, "_id", "left_anti").drop("_id"), "view-scores")
    sides = [(-F.col(f"z{side // 2}") if side % 2 else F.col(f"z{side // 2}")).alias("sure") for side in range(4)]  # text view: good, bad; metadata view: good, bad

    def tops(scores: DataFrame) -> list:
        each = [scores.select(F.lit(side).alias("side"), F.col("_key").alias("key"), sure).filter(F.col("sure") >= SURE_LOGIT).orderBy(F.desc("sure"), "key").limit(most[side // 2]) for side, sure in enumerate(sides)]
        return reduce(DataFrame.unionByName, each).collect()  # at most 8 * PER_ROUND

    rows = tops(found)
    if len({(r.side, r.key) for r in rows}) < len(rows):  # equal rows took places of others
        rows = tops(found.dropDuplicates(["_key"]))
    ranked: list[list[int]] = [[] for _ in range(4)]
    for r in sorted(rows, key=lambda r: (-r.sure, r.key)):
        ranked[r.side].append(r.key)
    out, gone = [], set()
    for own in (0, 1):
        sure = [[k for k in ranked[2 * own + side] if k not in gone][:PER_ROUND] for side in (0, 1)]
        out.append([(k, label) for keys, label in zip(sure, (1.0, 0.0), strict=True) for k in keys])
        gone.update(*sure)
    return out


def fit(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...], label_col: str, id_col: str, text_col: str) -> CoTrained:
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL")
    named = named.groupBy("_id").agg(F.min("_label").alias("_label"))
    sample = named.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    docs = docs.select(*{c: F.col(c) for c in (id_col, text_col, *meta)}.values())  # other columns' names cannot clash
    chosen = docs.withColumn("_id", F.col(id_col)).join(F.broadcast(sample), "_id").distinct()  # at most LABELLED ids; equal rows are one
    known = sorted(_features(chosen, meta, text_col, ["_id", "_label"]).collect(), key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"], r["own"]))
    y = np.array([min(1, r["_label"]) for r in known], np.float64)
    text, other = (_matrix([r[c] for r in known], w) for c, w in zip(("own", "other"), WIDTHS, strict=True))
    if not len(y):
        return exchange(text, other, y, lambda weights: [])

    # Equal rows are one document; rows without an id are unlabelled too.
    keyed = docs.withColumn("_id", F.col(id_col)).withColumn("_key", F.xxhash64("_id", F.col(text_col).cast("string"), *meta))
    named = stash(named.select("_id"), "labelled")
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    pool = keyed.select("_id", "_key", F.col(text_col).cast("string").alias("text"), *[F.col(m).alias(f"meta{k}") for k, m in enumerate(meta)])
    taken: set[int] = set()

    def choose(weights: list[np.ndarray]) -> Picks:
        picks = surest(pool, named, weights, taken, meta)
        keys = [k for view in picks for k, _ in view]
        taken.update(keys)
        rows = {}
        if keys:
            wanted = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in keys], "_key long"))  # at most 4 * PER_ROUND keys
            rows = {r["_key"]: r for r in _features(keyed.join(wanted, "_key").dropDuplicates(["_key"]), meta, text_col, ["_key"]).collect()}
        return [(*(_matrix([rows[k][c] for k, _ in view], w) for c, w in zip(("own", "other"), WIDTHS, strict=True)), np.array([label for _, label in view])) for view in picks]

    return exchange(text, other, y, choose)


def score_quality(
    docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = ("source", "lang", "n_chars"), label_col: str = "quality",
    id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
) -> DataFrame:
    """One row per document: doc_id, text_score and meta_score (log-odds of each view), score (combined probability), good.

    ``labels``: ids with 0 or 1 (null labels are left out; of several the least counts). Null or empty text has the
    features of an empty text, null metadata is a value like any other; repeated rows score alike; null ids are allowed;
    other columns are ignored; without labels every score is 0.5; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, meta, label_col, id_col, text_col))  # three small vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [c.to_pylist() for c in b.columns[2:]]
            texts = b.column(1).to_pylist()
            scores = np.zeros((len(texts), 3))
            for k, t in enumerate(texts):
                own, other = text_features(t or ""), meta_features({m: v[k] for m, v in zip(meta, values, strict=True)})
                scores[k] = model.value.scores(own[None], other[None])[0]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(scores[:, k]) for k in range(3)]], ["doc_id", "text_score", "meta_score", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(m).alias(f"meta{k}") for k, m in enumerate(meta)])
    return picked.mapInArrow(lean(run), "doc_id long, text_score double, meta_score double, score double").withColumn("good", F.col("score") >= least)
