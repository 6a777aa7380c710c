import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import packing, piece_codec
from tests.llm.helpers import AWKWARD, DOCS, documents, prose

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def texts():
    return AWKWARD + [prose(k, n) for k, n in enumerate([1, 5, 50, 700, 3000, 40, 40])] + ["the " * 3000, "!" * 40 + " " * 33 + "ab"]


def test_codec_equals_library(library, texts):
    codec = piece_codec.PieceCodec(PIECES)
    rng = random.Random(5)
    alphabet = "abcdetnioérs  \n\t▁.,'ß日1290<>"
    for t in [t or "" for t in texts] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]:
        ids = library.encode(t)
        assert codec.encode(t) == ids, t[:80]
        assert codec.decode(ids) == library.decode(ids), t[:80]


def test_every_piece_backtracks_like_the_merge(library):
    codec = piece_codec.PieceCodec(PIECES)
    rng = random.Random(1)
    for _ in range(2000):
        word = "".join(rng.choice(codec.pieces[300:]) for _ in range(rng.randint(1, 4))).replace("▁", "")
        known = "".join(c for c in word if c in codec.ids)
        assert [codec.pieces[k] for k in codec._backtrack(known)] == codec.merge(known) if known else True


def test_codec_digests(spark, library, texts):
    got = {r.doc_id: r for r in piece_codec.codec_digests(documents(spark, texts), PIECES).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = [*library.encode(t or ""), library.eos_id()]
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_codec_cache_gives_the_same_digests(library):
    codec, rng = piece_codec.PieceCodec(PIECES), random.Random(6)
    codec.CACHED, codec.LONGEST = 60, 9  # generations change all the time
    words = [f"{a}{b}{c}" for a in ("the", "Straße", "日本", "▁x", "", "⁇", "\0the") for b in ("", ",", ".\n", "\n\nAnd", "$$$", "é.é") for c in ("", "ing", "!", "zzq")]
    for _ in range(400):
        t = "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\n")) for _ in range(rng.randint(0, 30)))
        ids = [*library.encode(t), library.eos_id()]
        plain = library.decode(ids)
        assert codec.digest(t) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), plain))), t


def test_codec_edges(spark, library):
    assert piece_codec.codec_digests(spark.createDataFrame([], DOCS), PIECES).count() == 0
    rows = documents(spark, ["a b", "a b", None, "long word " * 60_000], ids=[1, 1, None, 2])
    got = piece_codec.codec_digests(rows.withColumn("n_tokens", rows.n_chars).withColumn("ids", rows.source), PIECES).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((k, len(library.encode(t)) + 1) for k, t in ((1, "a b"), (1, "a b"), (0, ""), (2, "long word " * 60_000)))


def test_round_trip(spark, texts):
    docs = documents(spark, texts)
    back = piece_codec.decode_documents(piece_codec.encode_documents(docs, PIECES), PIECES)
    got = {r.doc_id: r.text for r in back.collect()}
    assert got == {k: (t or "").replace("▁", " ") for k, t in enumerate(texts)}


def test_chunks_equal_whole_texts(texts):
    own = packing.ChunkTokenizer(WORDS)
    assert own.by_word
    rng = random.Random(8)
    latin = [chr(c) for c in range(1, 256)] * 2 + list("aaeeiioouu'''      tsrndl'''<|>") + ["\u0301", "Σ", "σ", "İ", "\u2028", "'s", "'ll", "<|endoftext|>"]
    more = ["".join(rng.choice(latin) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    every = [t or "" for t in texts] + more
    for t, ids in zip(every, own.encode_batch(every, None), strict=True):
        assert np.frombuffer(ids, own.width).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_worker_holds_few_words_of_many():
    own, spelt = packing.ChunkTokenizer(WORDS), str.maketrans("0123456789", "etaoinshrd")
    own.CHUNKS = own.WORDS = 2_000
    own.PART = 1 << 14
    words = [str(10_000_000 + 997 * k).translate(spelt) for k in range(30_000)]
    every = [" ".join(words[k : k + 100]) + " the And, x-1" for k in range(0, 25_000, 100)] + [None, "", " ".join(words[25_000:])]
    got = own.encode_batch(every, 2)
    assert len(own.words) + len(own.words.before) < 15_000
    for t, ids in zip(every, got, strict=True):
        assert np.frombuffer(ids, own.width).tolist() == [*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("targets", [None, {"s0": 0.6, "s1": 0.3, "s2": 0.1, "": 0.05}])
def test_packing(spark, texts, targets):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    sources = [[f"s{k % 3}", None][k % 7 == 6] for k in range(len(texts))]
    pieces = packing.pack_documents(documents(spark, texts, sources), WORDS, targets=targets).collect()
    expected = {k: [*own.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(expected)
    for k, own_pieces in by_doc.items():
        ids = []
        for p in sorted(own_pieces, key=lambda p: p.start):
            assert p.start == len(ids) and p.doc_tokens == len(expected[k])
            part = expected[k][p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            ids += part
        assert ids == expected[k]
    for s, own_pieces in by_sequence.items():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0), (s, at)


@pytest.mark.parametrize("weights", [[5], [3, 1], [1, 1, 1], [0, 7, 2, 0, 5], [600_000, 300_000, 99_999, 1], [1, 1_000_000]])
def test_carried_deficits_equal_the_plain_round_robin(weights):
    deficits, served = [0] * len(weights), [0] * len(weights)
    for n in range(1, 3000):
        served[packing.deal(weights, deficits)] += 1
        assert packing.carried(n, weights) == (served, deficits)


def test_schedule_equals_the_plain_round_robin():
    """Every token dealt one by one, queues that run dry included."""
    rng = random.Random(6)
    for _ in range(40):
        totals = [rng.randrange(0, 60) for _ in range(rng.randrange(1, 6))]
        targets = [rng.choice([1.0, 0.5, 3.0]) for _ in totals]
        plan = packing.Schedule.planned(totals, targets, window=16)
        left, dealt, at = list(totals), [], 0
        for k, p in enumerate(plan.phases):
            deficits = [0] * len(totals)
            end = plan.phases[k + 1].start if k + 1 < len(plan.phases) else plan.total
            for _ in range(end - at):
                q = packing.deal(list(p.weights), deficits)
                left[q] -= 1
                dealt.append(q)
            at = end
        assert not any(left) and plan.total == len(dealt) == sum(totals)
        for w in range(-(-plan.total // 16) + 1):
            assert list(plan.served(w)) == [dealt[: 16 * w].count(q) for q in range(len(totals))]


def test_equal_shares_and_same_numbers_again(spark):
    docs = documents(spark, ["a b c d " * n for n in (300, 300, 40, 40)], ["big", "big", "small", None]).coalesce(1)
    runs = [sorted(tuple(r) for r in packing.pack_documents(docs, WORDS, targets=packing.EQUAL, window=120).drop("ids").collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    first = {}
    for r in packing.pack_documents(docs, WORDS, targets=packing.EQUAL, window=120).filter("sequence_id = 0").collect():
        first[r.source] = first.get(r.source, 0) + r.length
    assert first == {"big": 40, "small": 40, None: 40}


def test_mixture_follows_targets():
    plan = packing.Schedule.planned([40_000, 40_000, 4_000], [0.7, 0.2, 0.1], window=100)
    for w in range(0, plan.phases[1].start // 100 - 1):
        a, b = plan.served(w), plan.served(w + 1)
        assert sum(b) - sum(a) == 100
        for share, n in zip([70, 20, 10], [y - x for x, y in zip(a, b, strict=True)], strict=True):
            assert abs(share - n) <= 3
    assert plan.served(-(-plan.total // 100)) == (40_000, 40_000, 4_000)


def test_packing_is_whole_for_empty_and_repeated_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), WORDS).count() == 0
    same = documents(spark, ["one two", "one two", None], ids=[7, 7, None])
    rows = packing.pack_documents(same, WORDS).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 1


@pytest.mark.parametrize("aimed", [False, True])
def test_every_source_has_a_queue(aimed):
    totals = [5000] * 3 + [400] * 37
    targets = [1.0] * 3 + [0.5] * 37 if aimed else None
    plan, paths = packing.Schedule.tiered(totals, targets, window=1000, most=4)
    assert len(set(paths)) == 40 and max(map(len, paths)) > 2
    filled, windows = {}, -(-plan.total // 1000)
    for k, n in enumerate(totals):
        at = 0
        for start, length, sequence, offset in plan.pieces(paths[k], 0, n):
            assert start == at
            at += length
            filled.setdefault(sequence, []).append((offset, length))
        assert at == n
        by_window = [plan.reached(w + 1, paths[k])[0] - plan.reached(w, paths[k])[0] for w in range(windows)]
        share = (targets[k] / sum(targets) if aimed else n / sum(totals)) * 1000
        assert all(abs(m - share) <= 12 for m in by_window[:10])
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length


def test_small_source_gets_its_target(spark):
    sources = [f"s{k:03}" for k in range(560)] + ["curated"] * 3
    docs = documents(spark, ["word " * 400] * 560 + ["one two three " * 10] * 3, sources)
    rows = packing.pack_documents(docs, WORDS, targets={"curated": 1.0} | {f"s{k:03}": 0.01 for k in range(560)}, window=256).collect()
    assert sum(r.length for r in rows) == 560 * 401 + 3 * 31
    early = sum(r.length for r in rows if r.source == "curated" and r.sequence_id < 4)
    assert early == 3 * 31  # a share of 15 per cent: 93 tokens are dealt within 4 windows
