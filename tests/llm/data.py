"""Small documents with the awkward cases every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words string, label string"


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Null, empty and blank texts, a very long one, exact copies, near copies, shared passages, odd bytes;
    extra columns whose names clash with outputs; null labels."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "日本", "it's", "42", "x" * 30, "Mit", "LICENSE", "apache", "the"]
    passage = " ".join(rng.choice(words) + str(i % 7) for i in range(70))
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(6000))
    texts: list[str | None] = [None, "", "   \n\t ", "one", "one two three", "!!! ...", "\x00\x01 a\x0bb\x0cc", "a\u00a0b \u2003c", long, long, long + " tail", "MIT License", "see the Apache License, Version 2.0 now mit license"]
    while len(texts) < n:
        base = " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.randrange(5, 120)))
        texts.append(base)
        if rng.random() < 0.3:
            texts.append(base)
        if rng.random() < 0.3:
            parts = base.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            texts.append("  ".join(parts))
        if rng.random() < 0.2:
            texts.append(base + "\n" + passage + " " + base[::-1])
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k], None if i % 11 == 0 else ("en", "fr")[i % 2], None if i % 13 == 0 else f"src{i % 3}", 1, 0.5, "clash", None) for i, k in enumerate(order)]


def frame(spark, n: int = 60, seed: int = 1, repeat: bool = False):
    own = rows(n, seed)
    return spark.createDataFrame(own + (own[:5] if repeat else []), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
