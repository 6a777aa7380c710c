import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, minhash
from tests.llm.helpers import AWKWARD, DOCS, documents, prose


def brute(texts, percent):
    def own(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [own(t) for t in texts]
    label = list(range(len(texts)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def edited(text, changes, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def corpus():
    base = [prose(k, 60 + 17 * k) for k in range(12)]
    near = [edited(t, c, 31 * k + c) for k, t in enumerate(base) for c in (1, 1, 2, 3, 4, 6, 9)]
    chain = [prose(99, 200)]
    for k in range(25):
        chain.append(edited(chain[-1], 2, k))
    passage = prose(500, 80)
    shared = [passage + " " + prose(600 + k, 60) for k in range(30)]
    short = ["one two three", "One TWO three", "one two", "one\ttwo\vthree", "a b c d e", "a b c d e"]
    return AWKWARD + base + near + chain + shared + short + base[:4] + [prose(0, 60).upper()]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_equals_brute_force(spark, percent):
    texts = corpus()
    random.Random(0).shuffle(texts)
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(documents(spark, texts), percent).collect()}
    assert rows == {k: (n, c, c == k) for k, (n, c) in enumerate(brute(texts, percent))}


def test_large_groups_are_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_CELL", 6)
    monkeypatch.setattr(minhash, "SET_CELL", 4)
    texts = corpus()
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(documents(spark, texts), 85).collect()}
    assert rows == dict(enumerate(brute(texts, 85)))


def test_edges(spark):
    assert minhash.near_dedup(spark.createDataFrame([], DOCS)).count() == 0
    docs = documents(spark, ["a b", "a b", "a b", None, "x"], ids=[5, 5, None, None, 1])
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 5, True), (5, 5, True), (None, None, False), (None, None, False), (1, 1, True)], key=str)
    x, y = prose(31, 40), prose(32, 40)
    mixed = minhash.near_dedup(documents(spark, [x, x, y, "w " * 300_000, "w " * 300_000 + "z"], ids=[1, 5, 5, 8, 9]).withColumns({"digest": F.lit(1), "rep": F.lit(2), "members": F.lit(3)})).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in mixed) == [(1, 36, 1), (5, 36, 1), (5, 36, 5), (8, 1, 8), (9, 2, 9)]
    assert minhash.drop_near_copies(documents(spark, ["q w e r t y", "q w e r t y", "z"])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(40)] + [(3, 3)]
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: label[x] for p in pairs if p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [1, 20, 40, 50, 60, 70, 80, 85, 95, 99, 100])
def test_bands_miss_hardly_any_pair(percent):
    own = minhash.Banding.for_percent(percent)
    assert (1 - (percent / 100) ** own.per_band) ** own.bands <= 1.01e-5
    assert own.bands * own.per_band <= 256 or own.per_band == 1


@pytest.mark.parametrize("percent", [30, 60])
def test_low_thresholds_equal_brute_force(spark, percent):
    texts = corpus()
    rows = {r.doc_id: r.component_id for r in minhash.near_dedup(documents(spark, texts), percent).collect()}
    assert rows == {k: c for k, (_, c) in enumerate(brute(texts, percent))}


def test_minima_estimate_similarity():
    banding = minhash.Banding.for_percent(85)
    a, b = banding.coefficients()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    y = np.concatenate([x[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    agree = (minhash.minima(x, a, b) == minhash.minima(y, a, b)).mean()
    assert abs(agree - 900 / 1100) < 0.12
