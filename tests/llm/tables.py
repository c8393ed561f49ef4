"""Small document tables with the cases every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names operators also use inside or in their results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, label string, kept string, page long, fp string, start long"


def documents(spark: SparkSession, texts: dict[int | None, str | None] | list[tuple[int | None, str | None]]) -> DataFrame:
    pairs = texts.items() if isinstance(texts, dict) else texts
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), 7, "h", "l", "k", 1, "f", 0) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + (".\n" if rng.random() < 0.08 else "") for _ in range(words))


def mixed_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Nulls, blanks, copies, near copies, shared passages, a very long text and repeated rows; ids unordered."""
    rng = random.Random(seed)
    passage = prose(rng, 70, 9000)
    base = prose(rng, 120)
    texts: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n "), (3, "One"), (4, "one  two"), (5, base), (6, base.replace(" ", "  ")), (7, base.upper())]
    texts += [(10 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 30)) for i in range(6)]
    texts += [(20 + i, base + f" tail{i}") for i in range(5)]
    texts += [(30, "é" * 300), (31, "ab " * 5000), (32, prose(rng, 20_000)), (33, "é" * 299 + "x"), (34, "a\x00b\x85 c"), (35, "x" * 250)]
    texts += [(40, "same row"), (40, "same row"), (41, "long same row " * 20), (41, "long same row " * 20)]
    rng.shuffle(texts)
    return texts
