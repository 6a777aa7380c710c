import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import cotraining, grams, language_id, quality_rules
from tests.llm.helpers import AWKWARD, DOCS, documents, prose

TONGUES = {"aa": ["the", "and", "re", "tion"], "bb": ["und", "ß", "en", "chz"], "cc": ["ña", "ción", "os", "que"]}


def spoken(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    truth = [sorted(TONGUES)[k % 3] for k in range(240)]
    known = [t if k < 120 else None for k, t in enumerate(truth)]  # half is unlabelled
    docs = documents(spark, [spoken(t, k) for k, t in enumerate(truth)] + AWKWARD, langs=known + [None] * len(AWKWARD))
    rows = {r.doc_id: r for r in language_id.identify(docs, host=F.col("source")).collect()}
    assert len(rows) == 240 + len(AWKWARD)
    assert all(rows[k].language == t and rows[k].accepted for k, t in enumerate(truth))
    blank = [240 + k for k, t in enumerate(AWKWARD) if not (t or "").strip()]
    assert [(rows[k].language, rows[k].confidence, rows[k].accepted) for k in blank] == [("und", 0.0, False)] * len(blank)


def test_evidence_decides_where_the_text_does_not(spark):
    texts = [spoken("aa", k) for k in range(60)] + [spoken("bb", k) for k in range(60)] + ["x"] * 6
    langs = ["aa"] * 60 + ["bb"] * 60 + [None] * 6
    hosts = ["a.one.net"] * 60 + ["b.two.org"] * 60 + ["a.one.net", "b.two.org", "new.one.net", "new.two.org", None, None]
    declared = langs[:120] + [None, None, None, None, "aa", "bb"]
    rows = [(k, t, lang, h, d, h and h.rpartition(".")[2]) for k, (t, lang, h, d) in enumerate(zip(texts, langs, hosts, declared, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, declared string, suffix string")
    got = {r.doc_id: r.language for r in language_id.identify(docs, declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix")).collect()}
    assert [got[k] for k in range(120, 126)] == ["aa", "bb", "aa", "bb", "aa", "bb"]


def test_host_prior_is_smoothed_towards_its_parents(spark):
    docs = documents(spark, [spoken("aa", 1), spoken("bb", 2)], langs=["aa", "bb"], sources=["x.y.z", None])
    rows = language_id.identify(docs, host=F.col("source")).collect()
    assert {r.language for r in rows} == {"aa", "bb"} and all(0.9 < r.confidence <= 1 for r in rows)


def test_language_edges(spark):
    assert language_id.identify(spark.createDataFrame([], DOCS)).count() == 0
    docs = documents(spark, ["a b", "a b", None], ids=[1, 1, None], langs=[None, None, None]).withColumns({"scores": F.lit(1), "t0": F.lit("x"), "page_id": F.lit(1)})
    assert {(r.doc_id, r.language, r.accepted) for r in language_id.identify(docs).collect()} == {(1, "und", False), (None, "und", False)}
    kept = language_id.drop_rejected(documents(spark, [spoken("aa", 1), None]))
    assert [(r.doc_id, r.lang) for r in kept.collect()] == [(0, "en")]


def test_fusion_equals_plain_python(spark):
    """Posteriors worked out document by document: each page's declared language and host, each part of a host once."""
    texts = [spoken(sorted(TONGUES)[k % 3], k, 6 + k % 5) for k in range(90)] + ["the ción", "und", "zz", ""]
    langs = [sorted(TONGUES)[k % 3] if k < 60 else None for k in range(94)]
    docs = documents(spark, texts, langs=langs)
    hosts = ["a.one.net", "b.one.net", "c.two.net:80", "d.three.org", "local"]
    rows = [(k, f"http://{hosts[(k * 7 + j) % 5]}/{k}", f"<html lang='{sorted(TONGUES)[(k + j) % 3]}'>" if (k + j) % 4 else "<p>") for k in range(94) for j in range(k % 3)]
    pages = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.doc_id: r for r in language_id.identify(docs, pages=pages).collect()}

    names, model = language_id.fit_text(docs, "lang", "doc_id", "text")
    scores = []
    for t in texts:
        s, n = model.sums(f" {t} ".encode() if t else b"")
        scores.append(language_id._log_shares(s * (min(n, language_id.EFFECTIVE) / n)) if n else None)
    shares = [None if s is None else np.exp(s) for s in scores]
    seen = sum(s for s in shares if s is not None)
    corpus = (seen + 1) / (seen.sum() + len(names))
    told = {k: [] for k in range(94)}
    host_counts, declared_counts = {}, {}
    for k, url, html in rows:
        host, tag = url.split("/")[2], html[12:14] if "lang" in html else None
        told[k].append((host, tag))
        if shares[k] is not None:
            host_counts[host] = host_counts.get(host, 0) + shares[k]
            if tag:
                declared_counts[tag] = declared_counts.get(tag, 0) + shares[k]
    top = lambda h: h.split(":")[0].rpartition(".")[2] if "." in h else ""
    parent = lambda h: ".".join(h.split(":")[0].split(".")[-2:]) if "." in h else ""

    def smoothed(counts, above):
        return (counts + language_id.PARENT_WEIGHT * above) / (counts.sum() + language_id.PARENT_WEIGHT)

    def prior(host):
        own = lambda same: sum(c for h, c in host_counts.items() if same(h))
        by_top = smoothed(own(lambda h: top(h) == top(host)), corpus)
        return smoothed(host_counts[host], smoothed(own(lambda h: (top(h), parent(h)) == (top(host), parent(host))), by_top))

    every = sum(declared_counts.values())
    for k, t in enumerate(texts):
        if scores[k] is None:
            assert (got[k].language, got[k].accepted) == ("und", False)
            continue
        q = scores[k] + np.log(corpus)
        for host, tag in told[k]:
            q = q + np.log(prior(host) / corpus)
            if tag:
                q = q + np.log((declared_counts[tag] + 1) / (every + len(declared_counts) + 1))
        p = np.exp(language_id._log_shares(q))
        assert got[k].language == names[int(p.argmax())] and got[k].confidence == pytest.approx(p.max(), abs=1e-9), (k, t)


def test_page_evidence(spark):
    pages = spark.createDataFrame(
        [(2, "https://b.c.org/en/7?x=1", "<!DOCTYPE html><HTML class=a lang='DE'><p>"), (1, "http://h.net:80/7/", "<p>no markup"), (3, None, "x"), (4, "http://a.b/none", None), (5, "http://a.b/8#t", None)],
        "page_id long, url string, html string",
    )
    got = {r.doc_id: (r.declared, r.host, r.suffix) for r in language_id.page_evidence(pages).collect()}
    assert got == {7: (None, "h.net:80", "net"), 8: (None, "a.b", "b")}


def test_every_label_is_a_language(spark):
    def word(k, j):
        return "".join(chr(0x4E00 + 40 * k + random.Random(f"{k} {j} {i}").randrange(40)) for i in range(30))

    texts = [word(k, j) for k in range(70) for j in range(2 + (k < 64))] + [word(k, 9) for k in range(70)]
    langs = [f"l{k:02}" for k in range(70) for _ in range(2 + (k < 64))] + [None] * 70
    docs = documents(spark, texts, langs=langs)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    known = len(texts) - 70
    assert all(got[known + k].language == f"l{k:02}" and got[known + k].accepted for k in range(70))
    languages, model = language_id.fit_text(docs, "lang", "doc_id", "text")
    counts = np.stack([sum(grams.gram_counts(t.encode(), 3, 14) for t, lang in zip(texts, langs, strict=True) if lang == c) for c in languages]) + 0.1
    for text in ["", "ab", word(3, 9), word(69, 9) * 300]:
        expected, n = grams.gram_sums(text.encode(), 3, 14, np.log(counts / counts.sum(axis=1, keepdims=True)))
        assert model.sums(text.encode())[1] == n and np.allclose(model.sums(text.encode())[0], expected)


def test_label_sample_is_of_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 5)
    docs = documents(spark, [f"{chr(97 + k % 26)}{k:03}" for k in range(300)], langs=["aa" if k % 4 else "bb" for k in range(300)])
    languages, model = language_id.fit_text(docs, "lang", "doc_id", "text")
    texts = {c: [r.text for r in docs.filter(F.col("lang") == c).orderBy(F.xxhash64("doc_id")).limit(5).collect()] for c in languages}
    counts = np.stack([sum(grams.gram_counts(t.encode(), 3, 14) for t in texts[c]) for c in languages]) + 0.1
    assert languages == ["aa", "bb"]
    expected = grams.gram_sums(b"a104 b105", 3, 14, np.log(counts / counts.sum(axis=1, keepdims=True)))[0]
    assert np.allclose(model.sums(b"a104 b105")[0], expected)


def test_declared_markup_language_of_whole_pages(spark):
    html = [
        "<?xml version='1.0'?>\n<!-- " + "licence " * 100_000 + "--><html lang=de>", "<!--[if IE]><html class=ie><![endif]-->" + " " * 600 + "<HTML\n  Lang = 'fr-CA'>",
        f'<html data-a="{"x > y " * 200}" xml:lang="zz" lang="es">', "<html lang=''><body lang=en>", "<htmlx lang=en>", "<html a lang=it" * 2, "<html " + "a='b' c " * 50_000 + 'lang="nl">',
        "<html " * 200_000, "<html \"" * 100_000, "<html" + " " * 1_000_000, "", None,
    ]
    pages = spark.createDataFrame([(k, f"http://a.b/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.doc_id: r.declared for r in language_id.named_pages(pages).collect()}
    assert [got[k] for k in range(len(html))] == ["de", "fr", "es", None, None, "it", "nl"] + [None] * 5


def test_every_page_of_a_document_counts(spark):
    texts = [spoken("aa", k) for k in range(60)] + [spoken("bb", k) for k in range(60)] + ["x", "x"]
    docs = documents(spark, texts, langs=["aa"] * 60 + ["bb"] * 60 + [None] * 2)
    page = "<html lang={}>".format
    rows = [(f"http://{'a.one.net' if k < 60 else 'b.two.org'}/{k}", page("aa" if k < 60 else "bb")) for k in range(120)]
    rows += [("http://a.one.net/120", page("aa")), *[(f"http://b.two.org/120?{k}", page("bb")) for k in range(3)]]  # the first page against three
    rows += [("http://new.info/121", "<html>"), ("http://new.info/121", page("bb"))]  # the first one declares nothing
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.doc_id: r for r in language_id.identify(docs, pages=pages).collect()}
    assert len(got) == 122
    assert [got[k].language for k in (120, 121)] == ["bb", "bb"] and got[120].confidence > 0.9


def brute_base(text):
    space = " \t\n\x0b\x0c\r"
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, windows = {}, [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    for k, w in enumerate(windows):
        seen.setdefault(w, []).append(k)
    hit = {p for places in seen.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if x.strip(space)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_counts():
    texts = [t or "" for t in AWKWARD] + [prose(k, 90) for k in range(4)]
    texts += ["a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", "x\nx \nx\n\n \ny\nx", "# | <a> 100% $5 & *" * 4, "w " * 30, prose(1, 30) + "\n" + prose(2, 30) + "\n" + prose(1, 30)]
    for t in texts:
        assert quality_rules.base_counts(t) == brute_base(t), t[:60]


def test_quality_rules(spark):
    good, bad = [prose(k, 60) for k in range(60)], [" ".join(w.upper() + "!!" for w in prose(100 + k, 60).split()) for k in range(20)]
    docs = documents(spark, good + bad + AWKWARD)
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, docs.filter("doc_id < 30")).collect()}
    texts = [*good, *bad, *AWKWARD]
    target, raw = (sum(grams.gram_counts((t or "").encode(), 4, 14) for t in part) + 0.5 for part in (good[:30], texts))
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for k, t in enumerate(texts):
        counts = grams.gram_counts((t or "").encode(), 4, 14)
        base = brute_base(t or "")
        score = float(ratio @ counts / counts.sum()) if counts.sum() else None
        assert tuple(rows[k][1:6]) == base
        assert rows[k].base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert rows[k].score == (None if score is None else pytest.approx(score))
        assert rows[k].kept == (not rows[k].base_failed and score >= quality_rules.THRESHOLD)
    assert all(rows[k].kept for k in range(60)) and not any(rows[k].kept for k in range(60, 80))
    assert quality_rules.quality_rules(docs.limit(0), docs).count() == 0
    assert {r.score for r in quality_rules.quality_rules(documents(spark, ["abcd " * 30]), docs.limit(0)).collect()} == {0.0}


def test_co_training_held_out_accuracy(spark):
    good, bad = [prose(k, 50) for k in range(150)], [" ".join(w + "%%" for w in prose(500 + k, 50).split()) for k in range(150)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair]
    docs = documents(spark, texts + AWKWARD, sources=[["g", "b"][k % 2] if k % 5 else "mixed" for k in range(300)] + [None] * len(AWKWARD))
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(90)] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in cotraining.score_quality(docs, labels).collect()}
    assert len(rows) == len(texts) + len(AWKWARD)
    right = sum((rows[k].score >= 0.5) == (k % 2 == 0) for k in range(90, 300))
    assert right >= 200
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_co_training_exchanges_labels():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.5).astype(float)
    one, two = (np.concatenate([y[:, None] * 2 - 1 + rng.normal(0, s, (3000, 5)), np.ones((3000, 1))], axis=1).astype(np.float32) for s in (0.8, 1.5))
    few = slice(0, 24)
    model = cotraining.co_train(one[few], two[few], y[few], one[24:2000], two[24:2000])
    scores = model.scores(one[2000:], two[2000:])
    assert ((scores[:, 2] >= 0.5) == (y[2000:] > 0)).mean() > 0.93


def test_co_training_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cotraining.score_quality(documents(spark, ["a", None, "a"], ids=[1, None, 1]), none).collect()} == {0.5}
    assert cotraining.score_quality(spark.createDataFrame([], DOCS), none).count() == 0
    clash = documents(spark, ["good " * 20, "bad %% " * 200_000, "good x", "good " * 20], ids=[1, 2, 3, 1]).withColumns({c: F.lit("x") for c in ("_label", "_key", "_id", "own", "quality")})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = cotraining.score_quality(clash, labels).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2, 3] and len({r.score for r in rows if r.doc_id == 1}) == 1
    text_ids = clash.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert cotraining.score_quality(text_ids, labels.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 4


def test_co_training_chooses_from_all_unlabelled_documents(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "PER_ROUND", 5)
    docs = documents(spark, [f"{prose(k, 2)} {k}" for k in range(2600)] + ["sure " * 9, "sure " * 9, "null id"], ids=[*range(2600), 7, 7, None])
    pool = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_key"), "text", F.col("n_chars").alias("meta0"))
    named = pool.filter("_id % 5 = 0").select("_id").distinct()
    rows = pool.filter("_id IS NULL OR _id % 5 <> 0").distinct().collect()
    rng = np.random.default_rng(1)
    weights = [rng.normal(0, 20, w).astype(np.float32) for w in cotraining.WIDTHS]
    features = [np.stack([cotraining.text_features(r.text) for r in rows]), np.stack([cotraining.meta_features({"n_chars": r.meta0}) for r in rows])]
    taken, free = {rows[k]["_key"] for k in range(0, len(rows), 3)}, None
    free = [k for k in range(len(rows)) if rows[k]["_key"] not in taken]
    expected = []
    for own in (0, 1):
        z = {k: float(features[own][k] @ weights[own]) for k in free}
        view = []
        for sign, label in ((1, 1.0), (-1, 0.0)):
            sure = sorted((k for k in free if sign * z[k] >= cotraining.SURE_LOGIT), key=lambda k: (-sign * z[k], rows[k]["_key"]))[:5]
            view += [(rows[k]["_key"], label) for k in sure]
        free = [k for k in free if rows[k]["_key"] not in dict(view)]
        expected.append(view)
    assert cotraining.surest(pool, named, weights, taken, ("n_chars",)) == expected
    assert len(expected[0]) == 10 and expected[1]


def test_co_training_uses_every_unlabelled_row(spark, monkeypatch):
    pools, inner = [], cotraining.surest
    monkeypatch.setattr(cotraining, "surest", lambda pool, *a: pools.append(pool.count()) or inner(pool, *a))
    monkeypatch.setattr(cotraining, "ROUNDS", 1)
    docs = documents(spark, [f"w{k}" for k in range(2300)] + ["null id"], ids=[*range(2300), None])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    assert cotraining.score_quality(docs, labels).count() == 2301
    assert pools == [2301]  # all rows are scored, labelled ones are left out of the choice
