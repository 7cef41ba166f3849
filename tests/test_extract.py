"""Phrases, scores, spans and the extraction plan against plain Python."""

import contextlib
import io
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgraph.functions import scoring
from inkgraph.functions import text as T
from inkgraph.operators import cooccur, mentions, phrases
from inkgraph.plans import pipelines
from inkgraph.sources import annotate

TEXTS = "id long, tokens array<string>"


def tokens_of(text):
    return [t.lower() for t in re.findall(r"""[A-Za-z0-9'\-]+|[.,!?;:"()\[\]]""", text)]


def brute_matches(tokens, forms):
    """Leftmost first, of those the longest."""
    table = {}
    for form, value in forms:
        w = tuple(tokens_of(form))
        if w:
            table[w] = min(table.get(w, (value, form)), (value, form))
    out, i = [], 0
    while i < len(tokens):
        n = next((n for n in range(max(map(len, table), default=0), 0, -1) if tuple(tokens[i : i + n]) in table and i + n <= len(tokens)), 0)
        if n:
            out.append((i, i + n - 1, table[tuple(tokens[i : i + n])][0]))
        i += max(n, 1)
    return out


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 7)
    monkeypatch.setattr(mentions, "PIECE", 7)


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_matches_equal_brute_force(spark, monkeypatch, small_pieces, broadcast):
    monkeypatch.setattr(phrases, "BROADCAST_CHARS", broadcast)
    rnd = random.Random(1)
    forms = [(" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))), rnd.randint(1, 9)) for _ in range(25)] + [("A  b", 3), ("a b", 2), ("", 1), ("é", 1), ("Mr. A", 4), ("c,b", 5)]
    texts = [(i, [rnd.choice("abcd,.") for _ in range(rnd.randint(0, 60))]) for i in range(80)] + [(90, None), (91, []), (92, ["a"] * 3_000), (93, ["mr", ".", "a", "b"])]
    got = phrases.matches(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(forms, "form string, value int").select("value", "form"), ["id"])
    want = sorted((i, *m) for i, t in texts for m in brute_matches(t or [], forms))
    assert sorted((r.id, r.start, r.end, r.value) for r in got.collect()) == want and len(want) > 500


def test_matches_of_nothing(spark):
    none = spark.createDataFrame([], "value int, form string")
    assert phrases.matches(spark.createDataFrame([(1, ["a"])], TEXTS), none, ["id"]).collect() == []
    assert phrases.matches(spark.createDataFrame([], TEXTS), spark.createDataFrame([(1, "a b")], "value int, form string"), ["id"]).collect() == []


def test_pieces(spark):
    df = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, None)], TEXTS)
    rows = df.select("id", F.inline(T.pieces(F.col("tokens"), 3, 1, 2))).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, list("abcde")), (1, 1, 2, list("cdefg")), (1, 2, 5, list("fg"))]


def test_names_of_many_tokens(spark):
    chapters = spark.createDataFrame([("b", 1, "Elizabeth Bennet met Mr. Darcy; Bennet saw ELIZABETH."), ("b", 2, ""), ("b", 3, None)], "book_id string, chapter int, text string")
    forms = spark.createDataFrame([("Elizabeth Bennet", 1), ("Elizabeth", 1), ("Bennet", 2), ("Mr. Darcy", 3)], "form string, coref int")
    got = annotate.Dictionary(forms).annotate(chapters).orderBy("start")
    assert got.columns == annotate.COLUMNS
    assert [(r.coref, r.start, r.end, r.text) for r in got.collect()] == [(1, 0, 1, "Elizabeth Bennet"), (3, 3, 5, "Mr. Darcy"), (2, 7, 7, "Bennet"), (1, 9, 9, "Elizabeth")]


def brute_compound(tokens, hits):
    def value(start, v):
        for back, fade in enumerate((1.0, 0.95, 0.9), 1):
            before = tokens[start - back] if start >= back else None
            step = 0.293 * fade if before in scoring.STRONGER else -0.293 * fade if before in scoring.WEAKER else 0.0
            v = v - step if v < 0 else v + step
            if before in scoring.NEGATIONS:
                v *= -0.74
        return v

    but = tokens.index("but") if "but" in tokens else None
    total = 0.0
    for start, _, v in hits:
        total += value(start, v) * (1 if but is None or start == but else 0.5 if start < but else 1.5)
    asked = tokens.count("?")
    push = min(4, tokens.count("!")) * 0.292 + (0 if asked < 2 else asked * 0.18 if asked <= 3 else 0.96)
    total += push if total > 0 else -push if total < 0 else 0
    return math.floor(max(-1.0, min(1.0, total / math.sqrt(total * total + 15))) * 10_000 + 0.5) if hits else 0


def scores(spark, texts):
    df = spark.createDataFrame([(i, None if t is None else tokens_of(t)) for i, t in enumerate(texts)], TEXTS)
    return [r.score_e4 for r in scoring.score_texts(df, scoring.built_in(spark), ["id"]).orderBy("id").collect()]


def test_scores(spark):
    good, war, no, but, very, slightly, far, far2, idiom, word, shout, ask, empty, null, much = scores(
        spark, ["a good friend", "a cruel war", "not good", "good , but sad", "very good", "slightly good", "very , , good", "good", "kiss of death", "death", "good !", "good ? ? ?", "", None, "death " * 500]
    )
    assert good > 0 > war and no < 0 and but < 0 and very > far > far2 > slightly and word < idiom < 0 and shout > far2 and ask > far2 and empty == null == 0 and much < -9_900


def test_scores_equal_brute_force(spark):
    rnd = random.Random(2)
    words = ["good", "sad", "war", "joy", "very", "slightly", "not", "never", "but", "!", "?", "the", "kiss", "of", "death", "broken", "heart"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    forms = list(scoring.LEXICON.items())
    assert scores(spark, texts) == [brute_compound(tokens_of(t), brute_matches(tokens_of(t), forms)) for t in texts]


def test_spans(spark, small_pieces):
    words = [f"w{i}" for i in range(40)]
    spans = [(0, 0), (5, 9), (6, 7), (0, 39), (38, 50), (45, 50), (3, 2), (-4, 1), (13, 13), (7, 20)]
    rows = [("b", 1, i, 1, a, z, " " if i % 2 else None, "PER") for i, (a, z) in enumerate(spans)] + [("b", 1, 90, 2, 0, 1, "Ann", "PER"), ("none", 1, 91, 1, 0, 1, " ", "PER")]
    ents = spark.createDataFrame(rows, "book_id string, chapter int, line_no int, coref int, start int, end int, text string, etype string")
    got = mentions.fill_spans(ents, spark.createDataFrame([("b", 1, words)], "book_id string, chapter int, tokens array<string>"))
    texts = {r.line_no: r.text for r in got.collect()}
    assert texts == {i: " ".join(words[max(a, 0) : z + 1]) for i, (a, z) in enumerate(spans) if a < 40} | {5: " ", 90: "Ann", 91: " "}


def brute_edges(chapters, forms, tones, half, least):
    pairs, total = Counter(), Counter()
    for book, chapter, text in chapters:
        tokens = tokens_of(text)
        found = brute_matches(tokens, forms)
        names = {}
        for c in {m[2] for m in found}:
            own = Counter(" ".join(tokens[a : z + 1]) for a, z, k in found if k == c)
            names[c] = max(own, key=lambda f: own[f])
        at = [(a, names[c]) for a, _, c in found]
        toned = brute_matches(tokens, tones)
        for pos in {a for a, _ in at}:
            low, high = max(pos - half, 0), pos + half
            cast = sorted({n for a, n in at if low <= a <= high})
            score = brute_compound(tokens[low : high + 1], [(a - low, z - low, v) for a, z, v in toned if a >= low and z <= high])
            for i, x in enumerate(cast):
                for y in cast[i + 1 :]:
                    pairs[book, chapter, x, y] += 1
                    total[book, chapter, x, y] += score
    nearest = lambda n, d: (2 * abs(n) + d) // (2 * d) * (-1 if n < 0 else 1)
    return sorted((*k, n, nearest(total[k], n)) for k, n in pairs.items() if n >= least)


def test_extract_equals_brute_force(spark, monkeypatch, small_pieces):
    """One chapter over many stretches, names and idioms across their borders."""
    monkeypatch.setattr(cooccur, "stretch_of", lambda half: 11)
    rnd = random.Random(3)
    words = ["ann lee", "bob", "carl van dam", "bob", "good", "broken heart", "not", "but", "!", "war", "very", "x", "y", ",", "kiss of death"]
    chapters = [("b", k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate((400, 30, 1, 0), 1)]
    forms = [("ann lee", 1), ("bob", 2), ("carl van dam", 3)]
    df = spark.createDataFrame(chapters, "book_id string, chapter int, text string")
    found = annotate.Dictionary(spark.createDataFrame(forms, "form string, coref int")).annotate(df)
    _, edges = pipelines.extract(df, found, pipelines.Params(window=10, min_freq=1))
    assert sorted((r.book_id, r.chapter, r.a, r.b, r.weight, r.sentiment_e4) for r in edges.collect()) == brute_edges(chapters, forms, list(scoring.LEXICON.items()), 5, 1)


def test_extraction_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("b", 1, "ann met bob")], "book_id string, chapter int, text string")
    found = annotate.Dictionary(spark.createDataFrame([("ann", 1), ("bob", 2)], "form string, coref int")).annotate(df)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        pipelines.extract(df, found, pipelines.Params(min_freq=1))[1].explain("formatted")
    assert "Exchange" in plan.getvalue() and not re.search("EvalPython|InPandas|InArrow|Cartesian|NestedLoop", plan.getvalue())


def test_extraction_exchanges_no_tokens_for_spans_that_are_there(spark):
    """Before, all tokens were exchanged to fill the texts of mentions even where every mention had one, and white space was cleaned though no token holds any."""
    texts = ["Ann\x85met\tBob\x0b's \u00a0 dog\r\n(\x1cEve)", " \u2003 a\x00b c\u3000d\x7f ", "", None, "\n", "K\u212a \x1f- x\u0085y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    both = df.select(T.clean_tokens(F.col("text")).alias("new"), T.tokenize(T.clean_chapter_text(F.col("text"))).alias("old")).collect()
    assert [r.new for r in both] == [r.old for r in both] and both[0].new[:2] == ["annmet", "bob's"]
    chapters = spark.createDataFrame([("b", 1, "ann met bob")], "book_id string, chapter int, text string")
    found = annotate.Dictionary(spark.createDataFrame([("ann", 1), ("bob", 2)], "form string, coref int")).annotate(chapters)
    tokens = pipelines.prepared(chapters)
    assert mentions.fill_spans(found, tokens) is found
    blank = found.withColumn("text", F.lit(" "))
    assert sorted(r.text for r in mentions.fill_spans(blank, tokens).collect()) == ["ann", "bob"]
