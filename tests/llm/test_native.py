import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, sharding, url_filters
from ledgerloom.llm.common import ASCII_UPPER
from tests.llm.helpers import AWKWARD, DOCS, documents, prose

LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())


def texts():
    base = [prose(k, 30) for k in range(60)]
    return AWKWARD + base + base[:20] + [t.upper() for t in base[:10]] + ["hot copy"] * 50 + ["HOT copy", None, ""]


@pytest.mark.parametrize("capacity", [100_000, 5])
def test_exact_dedup(spark, capacity):
    own = texts()
    norm = [(t or "").translate(LOWER) for t in own]
    rows = exact_dedup.exact_dedup(documents(spark, own), capacity=capacity).collect()
    assert len(rows) == len(own)
    for r in rows:
        same = [k for k, t in enumerate(norm) if t == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
    if capacity == 5:
        assert len({r.bucket for r in rows}) > 8


def test_directory_doubles_only_overfull_buckets(spark):
    keys = [k << 40 for k in range(64)] + [(1 << 62) + 5]
    got = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity=64).collect()
    assert {(r.bits, r.depth) for r in got} == {(16, 2)}  # two doublings part the one key from the others


@pytest.mark.parametrize("shift", [0, 40])
def test_directory_is_as_deep_as_it_must_be(spark, shift):
    """Held against plain splitting; keys that share their leading bits need slots of more bits."""
    rng = random.Random(2)
    keys = [rng.getrandbits(64 - shift) - (0 if shift else 1 << 63) for _ in range(400)] + [7] * 90

    def split(own, depth):
        if len(own) <= 20 or len(set(own)) == 1:
            return {k: depth for k in own}
        bit = 63 - depth
        return {k: d for side in (0, 1) for k, d in split([k for k in own if (k >> bit & 1) == side], depth + 1).items()}

    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    got = exact_dedup.with_bucket(rows, exact_dedup.directory(rows, 20)).collect()
    expected = split(keys, 0)
    prefix = lambda k: (k % (1 << 64)) >> (64 - expected[k]) if expected[k] else 0
    assert {(r.key, r.bucket) for r in got} == {(k, f"{expected[k]}/{prefix(k):X}") for k in keys}


def test_colliding_keys_are_chained_and_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 4)
    own = texts()
    norm = [(t or "").translate(LOWER) for t in own]
    rows = exact_dedup.exact_dedup(documents(spark, own), capacity=3, key=lambda c: F.pmod(F.xxhash64(c), F.lit(5))).collect()
    assert len(rows) == len(own)
    for r in rows:
        same = [k for k, t in enumerate(norm) if t == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
    assert len({r.text_sha256 for r in rows}) == len(set(norm)) and max(r.chain for r in rows) > 10 and len({r.bucket for r in rows}) > 1


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = documents(spark, ["a", "A", "a", None], ids=[1, 1, None, None]).withColumns({"key": F.lit(1), "keep_id": F.lit(2), "norm": F.lit("z")})
    got = exact_dedup.exact_dedup(rows).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in got if r.keep_id) == [(False, 1, True), (False, 1, True), (True, 1, False)]
    assert exact_dedup.drop_copies(spark.createDataFrame([], DOCS)).count() == 0
    long = ["a b" * 400_000, "A b" * 400_000, "c"]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(documents(spark, long)).collect()) == [1, 2]
    clash = documents(spark, ["a", "A", None], ids=[3, 3, None]).withColumns({c: F.lit("x") for c in ("key", "sha", "bucket", "norm", "_sha", "_idx")})
    assert exact_dedup.drop_copies(clash).columns == clash.columns
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_copies(clash).collect()) == [0, 3]
    kept = exact_dedup.drop_copies(documents(spark, texts()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == len({(t or "").translate(LOWER) for t in texts()})


def brute_capacity(sizes, k):
    best = [[0] * (len(sizes) + 1)] + [[10**9] * (len(sizes) + 1) for _ in range(k)]
    for j in range(k + 1):
        best[j][0] = 0
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best[0] = [0] + [10**9] * len(sizes)
    for j in range(1, k + 1):
        for n in range(1, len(sizes) + 1):
            best[j][n] = min(max(best[j - 1][m], ends[n] - ends[m]) for m in range(n))
    return best[k][len(sizes)]


def test_capacity_is_smallest():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 40) if rng.random() < 0.9 else 300 for _ in range(rng.randint(1, 30))]
        for k in (1, 3, 8):
            assert sharding.smallest_capacity(sizes, k) == min(brute_capacity(sizes, j) for j in range(1, k + 1))


def test_find_cuts_refines_to_the_exact_answer(spark):
    rng = random.Random(4)
    for hot in (0, 40_000):
        # keys that share their leading bits need several rounds of refinement
        groups = sorted({rng.getrandbits(30) + (rng.getrandbits(1) << 61): rng.randint(1, 500) for _ in range(3000)}.items())
        if hot:
            groups[1000] = (groups[1000][0], hot)
        cuts, capacity = sharding.find_cuts(spark.createDataFrame(groups, "key long, size long"), 8)
        sizes = [s for _, s in groups]
        assert capacity == sharding.smallest_capacity(sizes, 8)
        shards = [0] * 8
        for key, s in groups:
            shards[sum(key >= c for c in cuts)] += s
        assert max(shards) == capacity


def test_shards(spark):
    own = texts()
    rows = sharding.shard_documents(documents(spark, own)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(own)))
    home = {}
    for r in rows:
        t = own[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        assert home.setdefault(t, r.shard) == r.shard and 0 <= r.shard < 8
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
        assert sum(r.size for r in rows if r.shard == s) <= rows[0].capacity
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    again = documents(spark, ["a", "a", None], ids=[1, 1, None]).withColumns({"key": F.lit(9), "shard": F.lit(9), "size": F.lit("x")})
    assert sorted(r.slot for r in sharding.shard_documents(again, shards=1).collect()) == [0, 1, 2]


URLS = [
    None, "", "no scheme/at/all", "https://EXAMPLE.net/en/1", "http://a.example.net/de/1", "http://example.com/de/x?utm_source=feed",
    "http://b.org/fr/", "http://borg/fr/", "https://blog.x.org/en/5?page=2&ref=x", "https://blog.x.org/es/5?utm_source=feed", "https://m.a.example.com/de/4",
    "http://ads-track.example.org", "http://net", "http://x.net?q", "http://x.net/#f", "http://x.net:80/", "a://b://c/d", "http://y.com/banner/a/b.gif", "http://y.com/popup", "http://y.com/popups", "HTTP://Y.COM/POPUP/",
]


def fits(rule, url):
    """Matches a pattern rule character by character, without regular expressions."""
    body, url = rule.removeprefix("@@").lower(), url.lower()

    def at(p, k):
        if p == len(body) or (body[p:] == "|" and k == len(url)):
            return True
        c = body[p]
        if c == "*":
            return any(at(p + 1, n) for n in range(k, len(url) + 1))
        if c == "^":
            return (k == len(url) and at(p + 1, k)) or (k < len(url) and not (url[k].isascii() and url[k].isalnum()) and url[k] not in "_.%-" and at(p + 1, k + 1))
        return k < len(url) and url[k] == c and at(p + 1, k + 1)

    if not body.startswith("||"):
        return any(at(0, k) for k in range(len(url) + 1))
    scheme, found, rest = url.partition("://")
    if not found or not scheme[:1].isalpha() or not all(c.isalnum() or c in "+.-" for c in scheme):
        return False
    host = re.match(r"[^/?#]*", rest).group()
    return any(at(2, len(scheme) + 3 + k) for k in range(len(host) + 1) if k == 0 or host[k - 1] == ".")


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(LOWER)
    best = None
    for verdict, rule in url_filters.HOST_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], best[0]
    hit = [p for p in url_filters.PATTERN_RULES if url and fits(p, url)]
    blocked = any(not p.startswith("@@") for p in hit) and not any(p.startswith("@@") for p in hit)
    return host, path, None, "block" if blocked else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame([(k, u, "h", "t") for k, u in enumerate(URLS + URLS[:4])], "page_id long, url string, host string, token string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert got == {k: brute_url(u) for k, u in enumerate(URLS + URLS[:4])}
    assert {v[3] for v in got.values()} == {"allow", "block"}
    long = "http://z.com/" + "banner/" * 100_000 + "x.gif"
    odd = spark.createDataFrame([(None, long), (None, None), (5, ""), (5, "")], "page_id long, url string").withColumns({c: F.lit("x") for c in ("token", "low", "regex", "rule", "n")})
    assert sorted((r.page_id or 0, r.verdict) for r in url_filters.filter_urls(odd).collect()) == [(0, "allow"), (0, "block"), (5, "allow"), (5, "allow")]
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    assert url_filters.filter_urls(pages, patterns=()).count() == len(URLS) + 4


def test_rules_without_tokens_run_on_every_url(spark):
    pages = spark.createDataFrame([(1, "http://x.com/abcnothingdef"), (2, "http://x.com/zz"), (3, "http://x.com/xnothingy?free")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, host_rules=(), patterns=("*nothing*", "@@*free*")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_many_rules(spark):
    pages = spark.createDataFrame([(k, f"http://x.com/a{k}/b") for k in range(0, 3000, 500)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, host_rules=(), patterns=tuple(f"/a{k}/" for k in range(0, 3000, 3))).collect()}
    assert got == {k: "block" if k % 3 == 0 else "allow" for k in range(0, 3000, 500)}


def test_rules_are_indexed_by_rarest_token(spark):
    urls = spark.createDataFrame([(["page", "2", "ref", "x"],), (["page", "x", "2"],), (["x", "2"],)], "tokens array<string>")
    index = url_filters.rule_index(urls, ("^page=2^ref=x|", "*nothing*"))
    assert {(r.token, r.regex) for r in index.collect()} == {("ref", url_filters.to_regex("^page=2^ref=x|")), (None, url_filters.to_regex("*nothing*"))}
