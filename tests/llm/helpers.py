"""Small inputs that every operator must take, and brute-force versions to hold results against."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    same = "The quick brown fox jumps over the lazy dog and runs far away from here today."
    rows = [
        (1, same, "en", "s1", 10), (2, same, "en", "s1", 10), (2, same, "en", "s1", 10), (3, "", "en", None, 0), (4, None, None, None, None), (5, LONG, "en", "s2", 1), (6, LONG + " end", None, "s2", 1),
        (7, " \n\t ", "fr", "s1", 3), (8, "one two", "en", "s1", 7), (9, "one two", "de", "", 7), (10, "日本語 ünï \u0000 \U0001f600 a", "en", "s3", 5), (None, same, "en", "s1", 10), (12, "1234 !!", "en", "s1", 7),
    ]
    return rows


def clashing(df):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["key", "t", "n", "rank", "score", "sig", "label", "node", "query", "data", "first", "doc", "kind", "core", "value", "at", "size", "rate"]
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


def shingles(text: str | None, k: int) -> set:
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows: list[tuple], k: int, num: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t, k) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            lists[s].append(d)
    for d in sorted(sets):
        for e, n in Counter(e for s in sets[d] for e in lists[s] if e > d).items():
            if 100 * n >= num * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def mutated(n: int, seed: int = 3) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 40)) for _ in range(rnd.randint(0, 60))] for _ in range(n // 15)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            if w:
                w[rnd.randrange(len(w))] = "z" + str(rnd.randint(0, 5))
        rows.append((i * 3, " ".join(w) if rnd.random() > 0.02 else None))
    return rows
