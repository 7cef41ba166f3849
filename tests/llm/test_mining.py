"""Spelling variants, hard negatives and URL filters against SQL and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from inkgraph.llm import hard_negatives, queries, spelling, url_filter
from tests.llm.helpers import DOCS, LONG, clashing, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_hard_negatives", "op13_url_filter"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert len(want) > 40
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def brute_words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def variants(docs):
    got = spelling.variants(spelling.occurrences(docs))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_spelling_equals_brute_force(spark):
    rnd = random.Random(11)
    stems = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(4, 8))) for _ in range(60)]

    def word():
        w = list(rnd.choice(stems))
        if rnd.random() < 0.5:
            i = rnd.randrange(len(w))
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "é", "×"])
        return "".join(w).upper() if rnd.random() < 0.1 else "".join(w)

    rows = [(i, " ".join(word() for _ in range(60))) for i in range(120)]
    rows += [(None, "misspelt"), (7, None), (8, ""), (9, "x" * 200_000 + " " + "x" * 200_000 + " " + "x" * 200_000), (10, ("x" * 199_999 + " ") * 3), (14, ("x" * 99_999 + "y" + "x" * 100_000 + " ") * 3), (15, ("x" * 99_999 + "yz" + "x" * 99_999 + " ") * 3), (11, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ")] + [(12, "repeat repeats")] * 3 + [(13, " ".join(["chainone"] * 20 + ["chaintone"] * 8 + ["chaintones"] * 3))]
    got = variants(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_variants(brute_words(rows))
    assert ('chaintones', 'chaintone', 'chainone', 3, 1, 8) in got  # a chain of forms


def test_spelling_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert variants(clashing(spark.createDataFrame(odd_rows(), DOCS))) == brute_variants(brute_words(rows))
    assert variants(spark.createDataFrame([], DOCS)) == []
    assert len(LONG) > 500_000


def test_every_pair_of_an_edit_meets_once(spark):
    words = {a + m + b for a in ("", "t", "e") for m in ("hello", "helo", "hxllo", "hélló", "oellh", "tttt") for b in ("", "s", "é", "tt")}
    rows = sorted((w, i + 1) for i, w in enumerate(sorted(words)))
    got = spelling.near_pairs(spark.createDataFrame(rows, "word string, n long")).collect()
    want = {frozenset((a, b)) for a, _ in rows for b, _ in rows if a != b and one_edit(a, b)}
    assert len(got) == len(want) and {frozenset((r.a, r.b)) for r in got} == want


def brute_negatives(rows, every=50, n=5, k=3):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, own, x in sorted({i: r for r in sorted(good, reverse=True) for i in [r[0]] if i % every == 0}.values()):
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), i, label) for i, label, v in good if i != a)
        for p, pid, _ in [s for s in scored if s[2] == own][:n]:
            fit = [(i, -s) for s, i, label in scored if label != own and 50 * -p <= 100 * -s <= 95 * -p][:k]
            out += [(a, pid, r + 1, i, -p, s) for r, (i, s) in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("key") % 50 == 0, F.col("vec_id"), F.col("label"), F.col("embedding")).collect())


VECTORS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("scale", [1.0, 2.0**40])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)  # many blocks, so that the last choice spans them
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rnd = np.random.default_rng(4)
    rows = [(i, int(rnd.integers(0, 4)), [float(x) for x in rnd.integers(-3, 9, 6) / 16 * (scale if i % 50 else 1.0)]) for i in range(600)]
    rows += [(700, 1, rows[50][2]), (701, 1, rows[3][2]), (700, 2, rows[50][2]), (703, 0, rows[3][2]), (704, 0, rows[3][2])]  # ties, repeated ids
    rows += [(750, 9, rows[0][2]), (800, None, rows[3][2]), (None, 1, rows[3][2]), (801, 1, None), (802, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (803, 1, [float("inf")] * 6), (804, 1, [float("nan")] * 6)]
    got = mined(clashing(spark.createDataFrame(rows + [(900, 1, [1.0])], VECTORS)))
    assert got == brute_negatives(rows) and len(got) > 50


def test_hard_negatives_odd_rows(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [-1.0])], VECTORS)) == []
    zero = [(0, 1, [0.0]), (1, 1, [1.0]), (2, 0, [2.0])]
    assert mined(spark.createDataFrame(zero, VECTORS)) == [(0, 1, 1, 2, 0, 0)]


def test_meetings_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(400)], "key long, label long, c array<double>").repartition(4)
    blocks, asked = hard_negatives.packed(rows, 10), hard_negatives.packed(rows.filter("key % 50 = 0"), 4)
    judge = lambda own, ids, labels, scores: [(TaskContext.get().partitionId(), scores.size)]
    met = hard_negatives.meetings(blocks, asked, judge, "task long, n long").groupBy("task").sum("n").collect()
    assert len(met) > 4 and sum(r[1] for r in met) == 400 * 8  # small in bytes, and before all in one task


def fits(rule, host, path):
    if rule.exact:
        h, _, p = rule.text.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)
    body = rule.text.removeprefix("||")
    regex = "".join({"*": "(?s:.*)", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
    return re.search((r"\A(?:[^/]*\.)?" if body != rule.text else "") + regex, host + path) is not None


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    won = max((r for r in rules if fits(r, host, path)), key=lambda r: (r.exact, len(r.text), [-ord(c) for c in r.text] + [1], r.verdict == "block"), default=None)
    return host, path, won.text if won and won.exact else None, won.text if won and not won.exact else None, won.verdict if won else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.net/en/x", "http://a.Example.NET/en", "http://net", "http://net/", "http://planet/", "http://x.net?/en/", "https://ads-track.example.org/fr/", "https://m.ads-track.example.org/EN/?q=://net/",
    "ftp://a.example.com/de/1#f", "http://example.com/de", "http://é.net/ü", "http://x.org/adserver/a", "http://x.org/fr/adserver/", "http://x.org/popunder", "http://x.org/popunders", "http://x.org/popunder_", "http://x.org/a/POPUNDER/", "http://good-pills.io/",
    "http://pills.io/", "http://a\nb.net/\n", "http://h.io/" + "a/" * 3_000 + "doorway/", "http://" + "b." * 3_000 + "net/", "http://[::1]:80/$(x)+", "http://a.io/(x)$+z", "http://K.net/", "http://x.io/a*b", "http://u.io/one-two/three",
]


@pytest.mark.parametrize("chunk", [5_000, 3])
def test_urls_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(url_filter, "CHUNK", chunk)
    rules = url_filter.HOST_RULES + url_filter.PATTERNS + [url_filter.Rule(x, v) for x, v in (("*one*three", "block"), ("(x)$+", "allow"), ("u.io/one-", "allow"), ("||h.io/*/doorway/", "allow"), ("^two^", "block"))] + [url_filter.Rule("io", "allow", True), url_filter.Rule("io", "block", True)]
    rows = [(i, u) for i, u in enumerate([*URLS, *URLS])]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string")).withColumn("verdict", F.lit("x"))
    got = url_filter.judge(df, rules).select("page_id", "host", "path", "rule", "pattern", "verdict_").collect()
    assert sorted(map(tuple, got)) == [(i, *brute_judge(u, rules)) for i, u in rows]
    assert {r.pattern for r in got} >= {"*one*three", "(x)$+"} or any(r.pattern for r in got)


def test_very_long_urls(spark):
    rows = [(1, "http://h.io/" + "a/" * 300_000 + "doorway/"), (2, "http://" + "b." * 300_000 + "net/"), (3, "http://a.com/" + "pills/" * 100_000 + "x-pills.")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.HOST_RULES + url_filter.PATTERNS + [url_filter.Rule("*pills*bets*")])
    assert [(r.page_id, r.rule, r.pattern) for r in got.orderBy("page_id").collect()] == [(1, None, "/doorway/"), (2, "net/", None), (3, None, "||*-pills.")]


def test_urls_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, url_filter.PATTERNS).collect() == []
    one = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(one, []).collect()] == [(1, "http://a/b", "a", "/b", None, None, "allow")]


def test_rules_are_filed_under_their_rarest_word():
    rule = url_filter.Rule("||shop.example/cheap^")
    assert rule.words() == ["shop", "example", "cheap"]
    at = [e["word"] for b in url_filter.filed([rule], {"shop": 5, "example": 90, "cheap": 2}) for e in b]
    assert at == ["cheap"]
    assert url_filter.Rule("cheap*pills").words() == [] and url_filter.Rule("/a-b*").words() == ["a"]


def test_urls_stay_where_they_are(spark, capsys):
    """One projection: no shuffle, no Python, the index a constant."""
    url_filter.op13_url_filter(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Exchange|Python|Pandas|Arrow|from_json", plan)
