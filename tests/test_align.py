"""Mentions carried between token streams, against letters counted one by one."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from inkgraph.operators import align
from inkgraph.plans import pipelines

ENTITIES = "book_id string, chapter int, line_no int, coref int, start int, end int, text string, etype string"
TOKENS = "book_id string, chapter int, tokens array<string>"


def own_tokens(text):
    return [t.lower() for t in re.findall(r"""[A-Za-z0-9'\-]+|[.,!?;:"()\[\]]""", text)]


def spelled(tokens):
    """(letter, index of its token) of a stream."""
    plain = lambda t: "" if re.fullmatch(r"(?i)-[LR][RSC]B-", t or "") else re.sub("[^A-Za-z0-9]", "", t or "").lower()
    return [(c, i) for i, t in enumerate(tokens or []) for c in plain(t)]


def brute(foreign, own, start, end):
    """Own positions of a mention; None where it has none. Streams that differ are looked at letter by letter of the first token and the last letter."""
    theirs, ours = spelled(foreign), spelled(own)
    if start is None or end is None or not 0 <= start <= end < len(foreign or []):
        return None
    inside = [k for k, (_, i) in enumerate(theirs) if start <= i <= end]
    if not inside or inside[-1] >= len(ours):
        return None
    first, last = inside[0], inside[-1]
    word = [c for c, i in theirs if i == start]
    token = [c for c, i in ours[first:] if i == ours[first][1]][: len(word)]
    ends = theirs[last][1] == end
    if word[: len(token)] != token or ends and theirs[last][0] != ours[last][0]:
        return None
    return ours[first][1], ours[last][1]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(align, "PIECE", 5)
    monkeypatch.setattr(align, "BUCKET", 7)


def run(spark, chapters, mentions):
    foreign = spark.createDataFrame([("b", k, f) for k, f, _ in chapters], TOKENS)
    own = spark.createDataFrame([("b", k, o) for k, _, o in chapters], TOKENS)
    rows = [("b", k, n, 1, s, e, "x", "PER") for n, (k, s, e) in enumerate(mentions)]
    return align.align(spark.createDataFrame(rows, ENTITIES), foreign, own)


def test_align_equals_brute_force(spark, small):
    rnd = random.Random(3)
    words = ["It's", "U.S.A.", "well-known", "café", "the", "...", "“", "(no)", "x", "e.g.,", "Ö", "ﬁ", "K", "İ", "-LRB-", "99", "a" * 40]
    chapters = []
    for k in range(12):
        foreign = [rnd.choice(words) for _ in range(rnd.randint(25, 60))]
        chapters.append((k, foreign, own_tokens(" ".join(foreign))))
    chapters += [(20, None, ["a"]), (21, [], []), (22, ["a", None, "b"], ["a", "b"]), (23, ["one", "two", "three"], ["one", "too", "three"]), (24, ["a", "b"], None), (25, ["the"] * 700, ["the"] * 700)]
    mentions = [(k, rnd.randint(-1, 61), 0) for k, *_ in chapters for _ in range(40)]
    mentions = [(k, s, s + rnd.randint(-1, 3)) for k, s, _ in mentions] + [(0, None, 3), (0, 3, None), (0, 1, 1), (0, 1, 1), (99, 0, 0), (25, 699, 699), (25, 700, 700)]
    streams = {k: (f, o) for k, f, o in chapters}
    got = {r.line_no: r for r in run(spark, chapters, mentions).collect()}
    assert len(got) == len(mentions)
    want = [brute(*streams.get(k, (None, None)), s, e) for k, s, e in mentions]
    for n, w in enumerate(want):
        assert (got[n].own_start, got[n].own_end) == (w or (None, None)), (mentions[n], streams.get(mentions[n][0]))
    assert sum(w is not None for w in want) > 150 and sum(w is None for w in want) > 150


def test_aligned_mentions_land_on_their_first_character(spark):
    """Both streams made from one text; the character position of each token is known."""
    text = "Mr. O'Hara (of Tara) said: “Don't!” — and the U.S. consul, Ms. Ng, left at 9:30.  " * 30
    foreign = [(m[0], m.start()) for m in re.finditer(r"\w+|[^\w\s]", text)]
    own = [(m[0], m.start(), m.end()) for m in re.finditer(r"""[A-Za-z0-9'\-]+|[.,!?;:"()\[\]]""", text)]
    where = [(0, i, i) for i, (t, _) in enumerate(foreign) if re.search(r"\w", t)]
    out = run(spark, [(0, [t for t, _ in foreign], [t.lower() for t, *_ in own])], where).collect()
    assert all(own[r.own_start][1] <= foreign[r.start][1] < own[r.own_start][2] for r in out) and len(out) == len(where)


def test_counts_and_carrying_over(spark):
    out = run(spark, [(0, ["Ann", "!", "Bo"], ["ann", "!", "bo"]), (1, ["?"], ["?"])], [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0)])
    assert sorted(tuple(r) for r in align.alignment_counts(out).collect()) == [("b", 0, 3, 1), ("b", 1, 1, 1)]
    kept = align.carried_over(out)
    assert kept.schema["start"].dataType.simpleString() == "int" and sorted((r.start, r.end) for r in kept.collect()) == [(-1, -1), (-1, -1), (0, 0), (2, 2)]
    assert align.align(spark.createDataFrame([], ENTITIES), *[spark.createDataFrame([("b", 0, ["a"])], TOKENS)] * 2).count() == 0


def test_extraction_from_another_token_space(spark):
    """Raw positions of a finer tokeniser would lie outside the chapter; aligned, the pair is found where it stands. Other chapters keep their positions."""
    text = "“–” " * 40 + "Ann saw Bo . Ann saw Bo . Ann left ."
    theirs = [m[0] for m in re.finditer(r"\w+|[^\w\s]", text)]
    place = [i for i, t in enumerate(theirs) if t in ("Ann", "Bo")]
    rows = [("b", 1, n, 1 if theirs[i] == "Ann" else 2, i, i, None if n == 0 else theirs[i], "PER") for n, i in enumerate(place)]
    rows += [("b", 1, 90, 3, 0, 0, "Quote", "PER"), ("b", 2, 0, 1, 0, 0, "Ann", "PER"), ("b", 2, 1, 2, 1, 1, "Bo", "PER")]
    chapters = spark.createDataFrame([("b", 1, text), ("b", 2, "Ann Bo")], "book_id string, chapter int, text string")
    foreign = spark.createDataFrame([("b", 1, theirs)], TOKENS)
    params = pipelines.Params(window=6, min_freq=1)
    found, edges = pipelines.extract(chapters, spark.createDataFrame(rows, ENTITIES), params, foreign=foreign)
    assert sorted((r.chapter, r.name, r.pos) for r in found.collect()) == [(1, "Ann", 0), (1, "Ann", 4), (1, "Ann", 8), (1, "Bo", 2), (1, "Bo", 6), (1, "Quote", -1), (2, "Ann", 0), (2, "Bo", 1)]
    assert {(r.chapter, r.a, r.b): r.weight for r in edges.collect()} == {(1, "Ann", "Bo"): 5, (2, "Ann", "Bo"): 2}
    _, raw = pipelines.extract(chapters, spark.createDataFrame(rows, ENTITIES), params)
    assert {r.chapter for r in raw.collect()} == {2}


def test_letters_are_counted_once_where_the_tokens_are(spark, small):
    """Before, letters of every token were taken by expressions in six places and gathered by chapter; stretches with their places come from one pass, whose letters are those of `letters`."""
    rnd = random.Random(4)
    words = ["It's", None, "", "-LRB-", "-rsb-", "-lrb-\n", "-LRB--", "café", "K", "ſ", "İ", "9:30", "the", "T-H-E", "“the”", "a b", "x" * 30, "-LſB-"]
    rows = [("b", k, [rnd.choice(words) for _ in range(n)]) for k, n in enumerate((0, 1, 4, 5, 6, 40, 63))] + [("b", 90, None), (None, 91, ["der"])]
    df = spark.createDataFrame(rows, TOKENS)
    told = {(r.chapter, r.pos): r.w for r in df.select("chapter", F.posexplode("tokens").alias("pos", "t")).select("chapter", "pos", align.letters(F.col("t")).alias("w")).collect()}
    got, place = {}, {}
    for r in sorted(align._cut(df).collect(), key=lambda r: (r.chapter, r.stretch)):
        assert r.first == r.stretch * 5 and r.offset == place.get(r.chapter, 0) and r.size == len(r.spelled)
        place[r.chapter] = r.offset + r.size
        got |= {(r.chapter, r.first + i): r.spelled[a:b] for i, (a, b) in enumerate(zip(r.starts, [*r.starts[1:], r.size], strict=True))}
    assert got == told
    streams = {k: t for _, k, t in rows}
    found = {(r.chapter, r.start): r.text for r in align.spelled_as(df, ["the", "der"]).collect()}
    assert found == {p: streams[p[0]][p[1]] for p, w in told.items() if w in ("the", "der")} and len(found) > 5
    none = spark.createDataFrame([("b", 0, 0, 1, 0, 0, "x", "PER")], ENTITIES)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        align.align(none, df, df).explain("formatted")
    assert "Window" not in plan.getvalue() and plan.getvalue().count("MapInArrow (") <= 6
