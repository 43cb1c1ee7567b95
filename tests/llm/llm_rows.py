from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, with other contents.
CLASHING = ["kept", "component", "bucket", "size", "rate", "key", "u", "v", "node", "label", "place", "range", "copies", "host", "path", "at", "ids"]


def frame(spark, rows):
    """Documents of (doc_id, text[, source]) with clashing extra columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
    docs = spark.createDataFrame(full, DOCS)
    for i, name in enumerate(CLASHING):
        docs = docs.selectExpr("*", f"'{i}' AS `{name}`")
    return docs.repartition(3)


def words(seed: int, n: int, kinds: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(kinds)}" for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    draw, parts = random.Random(seed), text.split(" ")
    for _ in range(n):
        parts[draw.randrange(len(parts))] = f"e{draw.randrange(10**6)}"
    return " ".join(parts)


def odd_rows():
    """Nulls, empty and long texts, ties, copies, near copies, repeated rows, shared passages."""
    base, passage = words(1, 120), words(2, 70, 10**6)
    rows = [(1, base, "a"), (2, base, "a"), (3, base, None), (4, edited(base, 1, 2), "b"), (5, edited(base, 2, 3), "b")]
    rows += [(6, None, "a"), (7, "", "b"), (8, " \t\n ", "c"), (9, "one", "c"), (10, "one two\x0bthree", "c"), (None, base, "a"), (None, None, None)]
    rows += [(11, words(3, 60) + " " + passage + "\n" + words(4, 40), "b"), (12, passage + " " + words(5, 10), "a"), (12, passage + " " + words(5, 10), "a")]
    rows += [(13, passage, "c"), (14, words(6, 20_000), "a"), (15, "x" * 50_000, "b"), (16, "é ﬁ 日本 🎉   ▁" * 30, "c")]
    rows += [(17, words(7, 49), "a"), (18, words(7, 49), "a"), (19, words(8, 50), "a"), (20, words(8, 50), "b"), (13, "another text of the same id", "c")]
    return rows
