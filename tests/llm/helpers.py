"""Small document tables for the corpus tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, langs=None, ids=None, parts=3):
    rows = [
        (ids[k] if ids else k, t, langs[k] if langs else "en", sources[k] if sources else f"s{k % 3}", None if t is None else len(t))
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "and", "re", "tion", "an", "er", "st", "ou", "th", "in", "ly", "é", "ß", "on"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


AWKWARD = [None, "", " ", "  a\tb\n\nc  d ", "A", "É é Ω ς ΑΣ", "x" * 5000, "…\u2028\u00a0 ▁▁ a▁b", "a  b   c                          d", "日本語 テキスト 😀😀", "<s> </s> <unk> <0x0A>", "\x00\x01 nul", "e\u0301 combining \u0301x"]
