"""Fixtures of the operator tests: documents of every awkward kind."""

from __future__ import annotations

import random

#: Extra columns with names that the operators use inside.
CLASHES = ("id", "h", "k", "a", "b", "n", "node", "root", "line", "shard", "block", "label", "score", "spans", "s", "low", "n_tokens", "label2", "bands")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def frame(spark, rows):
    """rows of (doc_id, text, lang, source), with n_chars and the clashing columns filled in."""
    made = [(i, t, lang, s, None if t is None else len(t), *(f"x{k}" for k, _ in enumerate(CLASHES))) for i, t, lang, s in rows]
    return spark.createDataFrame(made, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, n: int, words: int = 400) -> str:
    draw = random.Random(seed)
    pool = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sol", "wen", "qua") for b in ("n", "lor", "st", "ka", "pe", "dim", "vur", "x", "ning", "tt")]
    return " ".join(draw.choice(pool) + str(draw.randrange(words // 80)) for _ in range(n))


AWKWARD = [
    (None, "a row without an id but with plenty of words in it", "en", "s1"),
    (900, None, "en", "s1"),
    (901, "", "en", "s1"),
    (902, "   \n\t\n ", "en", "s1"),
    (903, "!!! ### ---", "en", "s1"),
    (904, "a row without language and source", None, None),
    (905, "the very same row", "en", "s1"),
    (905, "the very same row", "en", "s1"),
    (906, "one id", "en", "s1"),
    (906, "two texts", "en", "s2"),
    (907, "\U0001d54f İstanbul ﬃ \u0000 nul and ퟿", "en", "s1"),
    (908, prose(5, 60_000), "en", "s1"),
    (909, "x" * 300_000, "en", "s1"),
    (910, "\n" * 5000, "en", "s1"),
]
