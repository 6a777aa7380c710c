import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import suffix_dedup
from tests.llm.helpers import AWKWARD, DOCS, documents, prose


def brute(texts, ids, length=50):
    """Whole windows by dictionary: (n_bytes, n_removed, n_spans, kept digest) of each text."""
    own = [(t or "").encode() for t in texts]
    least = {}
    for t, i in zip(own, ids, strict=True):
        for k in range(len(t) - length + 1):
            least[t[k : k + length]] = min(i, least.get(t[k : k + length], i))
    out = []
    for t, i in zip(own, ids, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        starts = int((gone[:-1] & ~np.concatenate(([False], gone[:-1]))[: len(t)]).sum())
        out.append((len(t), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(2)
    base = [prose(k, 120) for k in range(15)]
    texts = AWKWARD + base
    for k in range(40):  # cuts of others, with edits, in any order
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randrange(len(a) - 150), rng.randrange(len(b) - 150)
        texts.append(prose(1000 + k, 10) + a[x : x + rng.randrange(40, 150)] + prose(2000 + k, 3) + b[y : y + rng.randrange(45, 120)])
    texts += ["ab" * 200, "x" * 400, "ab" * 30 + "c" + "ab" * 80, "y" * 49, "z" * 50, "z" * 51, "\x00" * 120, "q\x00" * 60, "é" * 100, "e" + "é" * 100]
    texts += base[:5] + ["prefix " + base[0], base[1] + " suffix", base[2][: len(base[2]) // 2]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("small", "hot"), [(False, False), (True, False), (False, True), (True, True)])
def test_equals_brute_force(spark, monkeypatch, small, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
        monkeypatch.setattr(suffix_dedup, "MANY", 2)
    if small:
        monkeypatch.setattr(suffix_dedup, "SORTED_WINDOWS", 50)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2000)
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts, range(len(texts)))))


def test_long_document(spark):
    long = prose(9, 60_000)
    texts = [prose(8, 100) + long[1000:1400], long, "tail " + long[-700:]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts, range(3))))


def test_ties_nulls_and_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    t = prose(1, 60)
    docs = documents(spark, [t, t, t, None, ""], ids=[4, 4, None, 9, None]).withColumns({"chunk": F.lit("x"), "row": F.lit(1), "kept": F.lit(2)})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    n = len(t.encode())
    assert got == [(False, 4, n, 0), (False, 4, n, 0), (False, 9, 0, 0), (True, 0, 0, 0), (True, 0, n, n)]
    left = {(r.doc_id, r.text, r.n_chars, r.chunk, r.row, r.kept) for r in suffix_dedup.drop_repeats(docs).collect()}
    assert left == {(4, t, len(t), "x", 1, 2), (None, "", 0, "x", 1, 2), (9, "", 0, "x", 1, 2)}


def test_maximal_repeats_with_all_occurrences():
    rng = random.Random(6)
    for _ in range(150):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        expected = {}
        for k, s in enumerate(segments):
            for a in range(len(s)):
                for b in range(a + 4, len(s) + 1):
                    expected.setdefault(s[a:b], set()).add((k, a))

        def maximal(string, places):
            lefts = {(segments[k][a - 1 : a] if a else (k,)) for k, a in places}
            rights = {(segments[k][a + len(string) : a + len(string) + 1] or (k, a)) for k, a in places}
            return len(places) > 1 and len(lefts) > 1 and len(rights) > 1

        expected = {(s, frozenset(p)) for s, p in expected.items() if maximal(s, p)}
        got = [(segments[r.segments[0]][r.offsets[0] : r.offsets[0] + r.length], frozenset(zip(r.segments.tolist(), r.offsets.tolist(), strict=True))) for r in suffix_dedup.maximal_repeats(segments, 4)]
        assert len(got) == len(set(got)) and set(got) == expected


def test_key_ranges_are_even():
    own = suffix_dedup.spans_of([prose(k, 400).encode() for k in range(60)])
    sizes = np.bincount(suffix_dedup._bucket(np.unique(own.anchor), 16), minlength=16)
    assert sizes.max() < 1.3 * sizes.mean()


def test_common_phrase_with_many_contexts(spark, monkeypatch):
    """Some anchors hot, others not; the phrase's own windows are shared by all documents, its edges by a few."""
    monkeypatch.setattr(suffix_dedup, "HOT", 40)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 20_000)
    names, stash = [], suffix_dedup.stash
    monkeypatch.setattr(suffix_dedup, "stash", lambda df, name: names.append(name) or stash(df, name))
    phrase = prose(5, 12)
    texts = [f"{prose(100 + k, 20)} {phrase} {prose(200 + k, 20)}" for k in range(120)]
    texts += [f"{prose(100 + k, 20)[-30:]} {phrase} {prose(900 + k, 9)}" for k in range(0, 120, 7)] + [prose(100, 20) + phrase[:30]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(documents(spark, texts, parts=5)).collect()}
    assert got == dict(enumerate(brute(texts, range(len(texts)))))
    assert "window-bits" in names
