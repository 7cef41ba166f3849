"""Archives, tokens, mixing, languages, pages and personal data."""

import hashlib
import hmac
import itertools
import math
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkgraph.llm import bpe, html_blocks, language_id, mixing, queries, surrogates, warc
from tests.llm.helpers import DOCS, LONG, clashing, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return bpe.public_codec()


@pytest.fixture(scope="module")
def tik(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_arc_versions_parse():
    blob = warc.arc_version_block(1, "20240101000000") + warc.arc_record(1, "http://a/", "1.2.3.4", "199901", "text/html", b"HTTP/1.0 200 OK\r\n\r\nbody") + b"\n\n"
    blob += warc.arc_version_block(2, "20240101000000") + warc.arc_record(2, "http://b/ x", "1.2.3.4", "20240102030405", "text/plain", b"\n\nhttp://fake 1 2 3 4\n") + warc.arc_record(2, "dns:b", "1.2.3.4", "20240102030405", "text/dns", b"")
    got = [warc.to_warc(f, b) for _, f, b in warc.parse_arc(blob)]
    assert [r["warc_type"] for r in got] == ["warcinfo", "response", "warcinfo", "response", "resource"]
    assert got[1]["warc_date"] == "1999-01-01T00:00:00Z"
    assert (got[1]["payload"], got[3]["payload"], got[4]["payload"]) == (b"body", b"\n\nhttp://fake 1 2 3 4\n", b"")
    assert got[1]["payload_digest"] == warc.base32_sha1(b"body")
    assert len({r["record_id"] for r in got}) == 5
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(blob[:-30] + b"http://c/ 1 2 3 4 5 6 7 8 99\nx"))


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u5", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n é"), (6, "u6", LONG), (7, "u7", "same"), (8, "u8", "\n\n")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    records = warc.mark_revisits(warc.convert(warc.pack_arc(pages, "page_id", "url", "html")).filter("warc_type <> 'warcinfo'"))
    warc.write_warc(records, str(tmp_path / "w"))
    got = {r.key: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.warc_type, r.refers_to_key) for k, r in got.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None)}
    for k, _, html in rows:
        data = (html or "").encode()
        assert got[k].payload_bytes == len(data)
        assert got[k].payload_digest == warc.base32_sha1(data)
        assert got[k].warc_type == "revisit" or bytes(got[k].payload) == data
    assert got[1].refers_to_id == got[7].record_id
    repeated = spark.createDataFrame([(1, "u", "A"), (1, "u", "A"), (1, "u", "B"), (5, "u", "A"), (5, "v", "A"), (None, "u", "A"), (None, None, "C")], "page_id long, url string, html string")
    warc.write_warc(warc.mark_revisits(warc.through_arc(repeated, "page_id", "url", "html").filter("warc_type <> 'warcinfo'")), str(tmp_path / "r"))
    again = sorted(((r.key, r.warc_type, r.refers_to_key, r.payload_digest == warc.base32_sha1(b"A")) for r in warc.read_warc(spark, str(tmp_path / "r")).collect()), key=repr)
    assert again == sorted([(1, "revisit", 5, True), (1, "revisit", 5, True), (1, "response", None, False), (5, "response", None, True), (5, "response", None, True), (None, "revisit", 5, True), (None, "response", None, False)], key=repr)
    empty = warc.convert(warc.pack_arc(pages.limit(0), "page_id", "url", "html"))
    assert empty.count() == 0


def test_bpe_equals_the_library(codec, tik):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "\n", "\t", "'s", "é", "日本", "1", "23", "!!", " ", " ", "a" * 80, "the", "<|endoftext|>"]
    for text in ["", LONG[:50_000], *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(500))]:
        assert codec.encode(text) == tik.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    assert codec.encode(None) == []
    assert all(codec.hash.get(t) == i for i, t in enumerate(codec.tokens))
    assert codec.hash.get(b"no such token at all") == -1


def test_bpe_long_texts_in_pieces(codec, tik, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 100)
    assert codec.encode(LONG[:20_000]) == tik.encode_ordinary(LONG[:20_000])


def test_bpe_query_and_odd_rows(spark, codec, tik):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    got = bpe.digest_documents(clashing(docs), codec, keep=("lang",)).collect()
    want = []
    for d, t, *_ in odd_rows():
        ids = tik.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, want))
    ids = bpe.encode_documents(docs, codec)
    assert sorted(map(repr, (bytes(r.data).decode() for r in bpe.decode_documents(ids, codec).collect()))) == sorted(repr(t or "") for _, t, *_ in odd_rows())
    assert bpe.digest_documents(docs.limit(0), codec).count() == 0


def test_mixing(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    named = docs.withColumns({c: F.lit("own") for c in ("mix_source", "mix_copies", "mix_copy", "Mix_Key", "mix_row")})
    assert {(r.mix_source, r.mix_copies, r.mix_copy, r.Mix_Key, r.mix_row) for r in mixing.replicate(named).collect()} == {("own",) * 5}
    assert mixing.replicate(named).columns[-3:] == ["mix_copy_", "mix_copies_", "mix_key_"]
    one = mixing.replicate(clashing(docs))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, mixing.replicate(clashing(docs)).collect()))
    assert mixing.replicate(docs.limit(0)).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = {r.source: r["count"] for r in mixing.replicate(many, {"a": 0.25, "b": 0.75}).groupBy("source").count().collect()}
    assert abs(got["a"] - 1000) < 150
    assert abs(got["b"] - 3000) < 250
    assert {r.source for r in mixing.replicate(many, {"b": 1.0}).select("source").distinct().collect()} == {"b"}
    keys = [r.mix_key for r in mixing.replicate(many).collect()]
    assert keys == sorted(keys)


def poisson_quantile(rate, u):
    """The least k with P(X <= k) > u, by exact logarithms of factorials; the tail below is counted as nothing."""
    low, total = max(0, int(rate - 15 * math.sqrt(rate) - 30)), 0.0
    for k in itertools.count(low):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0
        if total > u:
            return k


def test_mixing_large_rates(spark):
    us = [0.0001, 0.1, 0.25, 0.5, 0.77, 0.9, 0.9999]
    rows = [(float(rate), u) for rate in (0, 0.3, 1, 7, 150, 194, 196, 900, 5000, 20_000, 1_000_000) for u in us]
    got = spark.createDataFrame(rows, "rate double, u double").select("rate", "u", mixing.poisson_quantile(F.col("rate"), F.col("u")).alias("n")).collect()
    for r in got:
        # At a rate of a million, lgamma itself is right to some 1e-9 only: a step of 4e-4 decides.
        assert abs(r.n - poisson_quantile(r.rate, r.u)) <= (0 if r.rate < 1e5 else 1), r
    few = spark.createDataFrame([(1, "a", "small"), (2, "a" * 30_000, "large"), (3, None, None)], "doc_id long, text string, source string")
    mixed = mixing.replicate(few, {"small": 0.5, "large": 0.5}, budget=10.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("mix_copy").alias("d"), F.max("mix_copies").alias("m")).collect()
    copies = {r.doc_id: r.n for r in mixed}
    assert all(r.n == r.d == r.m for r in mixed) and abs(copies[1] - 150_005) < 3000
    with pytest.raises(Exception, match="rate"):
        spark.createDataFrame([(1e10, 0.5)], "rate double, u double").select(mixing.poisson_quantile(F.col("rate"), F.col("u"))).collect()


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 200
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_languages_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows() + [(20 + i, f"le la les des une pour {i}", "fr", "s", 1) for i in range(6)], DOCS)
    got = {r.doc_id: r for r in language_id.identify(clashing(docs), language_id.train(docs)).collect()}
    assert all((got[d].lang_pred, got[d].score_, got[d].excess, got[d].score) == ("und", 0.0, None, "x") for d in (3, 4, 7, 12))
    assert got[21].lang_pred == "fr"
    assert got[5].lang_pred == "en"
    named = language_id.identify(docs.withColumns({"score": F.lit("own"), "lang_pred": F.lit("own")}), language_id.train(docs))
    assert named.columns[-3:] == ["lang_pred_", "score_", "excess"]
    assert {(r.score, r.lang_pred) for r in named.collect()} == {("own", "own")}
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.train(docs.limit(0))).count() == 0


def plain_ppm(trained, text):
    """Escape method C with exclusion, byte by byte, from counts in dictionaries."""
    order, counts = language_id.ORDER, {}
    for t in trained:
        s = language_id.BEFORE + t.encode()
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                counts[s[i - k : i]][s[i]] += 1
    s, bits = language_id.BEFORE + text.encode(), 0.0
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            seen = {b: n for b, n in counts.get(s[i - k : i], {}).items() if b not in gone}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if s[i] in seen:
                bits -= math.log2(seen[s[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
            gone |= set(seen)
        else:
            bits += math.log2(256 - len(gone))
    return bits


def test_code_lengths_equal_a_plain_coder():
    texts = {"a": ["the cat sat on the mat", "that hat"], "b": ["der Hund über dem Tisch", "日本語 und ñ"], "c": [""]}
    counts = {}
    for name, own in texts.items():
        cells = np.concatenate([language_id.cells_of(t) for t in own])
        counts[name] = np.unique(cells, return_counts=True)
    model = language_id.build(counts)
    for text in ("the hat", "Tisch ü \x00 zq", "日本", "xyz", "a"):
        got = model.lengths(text.encode())
        assert got == pytest.approx([plain_ppm(texts[n], text) for n in model.langs], rel=1e-4)


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "GROUP", 7)
    rows = [(1000 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + (k * 7 + j) % 26)}{chr(192 + k)}" for j in range(12)), f"l{k:02d}", "s", 1) for k in range(70) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    models = language_id.train(docs)
    assert sum(len(m.langs) for m in models) == 70
    got = language_id.identify(docs, models).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(rows)


def test_every_byte_counts(spark):
    """Scripts that together use more than half of all byte values stay apart."""
    text = lambda base, i: " ".join("".join(chr(base + (i * 13 + j * 5 + k) % 40) for k in range(6)) for j in range(12))
    rows = [(100 * n + i, text(base, i), name, "s", 1) for n, (name, base) in enumerate([("ru", 0x430), ("he", 0x5D0), ("th", 0xE01), ("zh", 0x4E00), ("ko", 0xAC00), ("el", 0x3B1), ("hi", 0x905)]) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert all(r.lang == r.lang_pred for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x --><div class="ad">Buy this now and save a lot of money today.</div>
<div id="cookie-notice"><p>We use cookies on this site to make it better for everyone who comes here.</p></div>
<article><h1>Head &amp; tail</h1><p><b>First   para<br>graph with <a href="x">one link</a> in it &lt;ok&gt;.<p>Second.</p><aside>Related: more of the same</aside>
<form><p>Subscribe to our newsletter here</p></form></article>
<section class="comments"><p>I liked this article very much, thank you so much for writing it all down.</p></section>
<footer>&copy; me</footer></body></html>"""


TREE = html_blocks.train_tree(html_blocks.labelled())


def lorem(n):
    return " ".join(["lorem"] * n)


def test_pages():
    rows = html_blocks.labelled()
    assert 150 <= len(rows) <= 300
    assert np.mean([html_blocks.classify(TREE, r[:-1]) == r[-1] for r in rows]) > 0.97
    assert html_blocks.main_text(PAGE, TREE) == "Head & tail\n\nFirst para graph with one link in it <ok>.\n\nSecond."
    for page in (None, "", "<", "<p", "<script>", "<!--", "</p></p>", "<a <b>", "<article"):
        assert html_blocks.main_text(page, TREE) == ""
    assert html_blocks.main_text("<article><p>a < b &amp; c &am</article", TREE) == "a < b & c &am"
    assert html_blocks.main_text("<article><p>Let <math>x</math> be.</p></article>", TREE) == "Let x be."


def test_the_tree_splits_on_text_features():
    def used(t):
        return set() if isinstance(t, int) else {html_blocks.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert {"words", "density"} <= used(TREE)
    assert used(TREE) & {"words_before", "words_after"}
    assert used(TREE) & {"density_before", "density_after"}


@pytest.mark.parametrize("around", ["<div>{}</div>", "<div id='main' class='with-sidebar'>{}</div>", "<article class='post has-comments'>{}</article>", "<body class='page with-sidebar'><div class='sidebar-layout'><article>{}</article></div>", "{}"])
@pytest.mark.parametrize("sizes", [(60, 2, 30), (60, 30, 3), (12, 70), (45, 1, 1, 50)])
def test_pages_of_plain_paragraphs(around, sizes):
    page = around.format("".join(f"<p>{lorem(n)}</p>" for n in sizes))
    page = "<div><a>Home</a></div><div><a>Old news</a></div>" + page + "<div class='comments'><p>" + lorem(25) + "</p></div><footer>(c) someone</footer>"
    assert html_blocks.main_text(page, TREE).split("\n\n") == [lorem(n) for n in sizes]


OFF = ["ad", "ad-slot", "adBox", "site-footer", "main-nav", "article-sidebar", "comment-list", "comments", "cookie-banner", "social-links", "share-buttons", "search-form", "side-bar", "related-posts", "newsletter-signup", "nav-2", "legal-notice", "promo-box"]
ON = ["side-effects", "social-history", "form-of-government", "river-side-story", "legal-thriller", "header-of-state", "search-for-meaning", "alert-and-oriented", "share-of-market", "tags-explained"]


@pytest.mark.parametrize("tag", ["div", "section", "article"])
@pytest.mark.parametrize("mark", ["class", "id"])
def test_pages_judge_whole_names(tag, mark):
    body = "".join(f"<p>{lorem(n)}</p>" for n in (40, 55, 30))
    for name in ON:
        assert html_blocks.main_text(f"<html><body><{tag} {mark}='{name}'>{body}</{tag}></body></html>", TREE).count("\n\n") == 2, name
    for name in OFF if tag != "article" else ("ad", "comment", "ad-slot", "comment-body"):  # an article is one unless its name begins otherwise
        assert html_blocks.main_text(f"<html><body><{tag} {mark}='{name}'>{body}</{tag}><main>{body}</main></body></html>", TREE).count("\n\n") == 2, name


def test_pages_read_attributes_as_html_does():
    for attributes in ("title=it's", 'class="a""', "title='a>b'", 'title="say \'hi\'"', "x = 'y' disabled", 'data-class="menu"', 'title="class=ad"', "a='b'c=\"d\"'", "=", 'title="never closed'):
        page = f"<article><p {attributes}>Hello one two three, don't drop this.</p></article>"
        assert html_blocks.main_text(page, TREE) == "Hello one two three, don't drop this.", attributes
    assert html_blocks.main_text("<article><p>a</p><div hidden><p>b</p></div><div class=menu><p>c</p></div></article>", TREE) == "a"


def test_pages_nest_deeply_in_linear_time():
    page = "<div>" * 40_000 + ("<p>" + lorem(30) + "</p></p></li>") * 500 + "</i>" * 40_000
    start = time.monotonic()
    assert html_blocks.main_text(page, TREE).count("\n\n") == 499
    assert time.monotonic() - start < 10


def test_pages_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_blocks.op6_html(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.DOTALL)[1]
        words = re.findall(r"\w+", re.sub(r"<[^>]*>?|&[a-z]+;?", " ", inner))
        assert words == re.findall(r"\w+", re.sub(r"&[a-z]*\Z", " ", r.text))
        assert r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", PAGE, "x"), (4, "u", PAGE * 200, None), (4, "u", PAGE, None), (4, "u", PAGE, None)], "page_id long, url string, html string, text string")
    got = html_blocks.extract(clashing(odd).withColumn("page_html", F.lit("y")), keep=("page_id", "url", "page_html")).collect()
    assert len(got) == 6
    assert {r.page_html for r in got} == {"y"}
    assert html_blocks.extract(odd.limit(0), keep=("page_id",)).count() == 0


def luhn(s: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


TEXTS = [
    (1, "Mail Ann.Lee@Example.com or ann.lee@example.com, call +1 (337) 555-7349."),
    (2, "Card 4111111111111111 and 4111 1111 1111 1111; order 4111111111111112."),
    (3, "From 10.20.30.40 not 10.20.300.40, version 4.0. or 1.2.3"),
    (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 24BE64439E3E49CF46B2D7C90F3602A3D0B907FF'),
    (5, "Mrs. Smith met Mr. John Doe and Mrs. Smith; Г. and Госпожа Иванова."),
    (6, "Nothing here 2024, only words."),
    (7, None),
    (8, ""),
    (8, ""),
]


def pseudonymise(docs, key="test"):
    return surrogates.pseudonymise(docs, key)


def test_surrogates(spark):
    docs = clashing(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    got = pseudonymise(docs).collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(TEXTS)
    assert set(got[0].asDict()) == {*docs.columns, "n_entities"}
    assert (text[6], text[7], text[8]) == (TEXTS[5][1], None, "")
    mails = re.findall(r"\S+@[\w.]+\w", text[1])
    assert len(mails) == 2
    assert mails[0] == mails[1] != "ann.lee@example.com"
    assert re.search(r"\+1 \(\d{3}\) 555-\d{4}\.$", text[1])
    assert "7349" not in text[1]
    cards = re.findall(r"\d{16}|(?:\d{4} ){3}\d{4}", text[2])
    assert cards[0] == cards[1].replace(" ", "") != "4111111111111111"
    assert luhn(cards[0])
    assert "4111111111111112" in text[2]
    assert "10.20.300.40" in text[3]
    assert "10.20.30.40 " not in text[3]
    assert text[3].endswith("version 4.0. or 1.2.3")
    low, high = re.findall(r"[0-9a-fA-F]{40}", text[4])
    assert high == low.upper()
    assert low != "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    first, second = re.findall(r"Mrs\. (\w+)", text[5])
    assert first == second != "Smith"
    assert re.search(r"Госпожа [А-Я]", text[5])
    named = docs.withColumns({c: F.lit("own") for c in ("pii_found", "pii_doc", "pii_new", "n_entities")})
    assert {(r.pii_found, r.pii_doc, r.pii_new, r.n_entities) for r in pseudonymise(named).collect()} == {("own",) * 4}
    again = pseudonymise(docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    other = {r.doc_id: r.text for r in pseudonymise(docs, key="other").collect()}
    assert other[1] != text[1]
    assert pseudonymise(docs.limit(0)).count() == 0


def test_surrogates_match_gender_script_and_format(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ATTEMPTS", 2)
    rows = [(1, "Mr. Alex Doe and Mrs. Alex Doe and Mr. Alex Doe"), (2, "Mr. Παπαδόπουλος, Mrs. Ελένη Νίκου, Mr. Արամ Հայկյան"), (3, "Call +49 30 901820 or +4930901820 or +380 44 123 4567")]
    got = {r.doc_id: r.text for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    he, she, again = re.fullmatch(r"Mr\. (.*) and Mrs\. (.*) and Mr\. (.*)", got[1]).groups()
    assert he == again
    assert he.split()[0] in surrogates.MALE
    assert she.split()[0] in surrogates.FEMALE
    one, two, three = re.fullmatch(r"Mr\. (\w+), Mrs\. (\w+ \w+), Mr\. (\w+ \w+)", got[2]).groups()
    assert all("Ͱ" <= c <= "Ͽ" or "ἀ" <= c for c in one + two.replace(" ", ""))
    assert two.split()[0] in surrogates.FEMALE_GREEK
    assert three.split()[0] in surrogates.MALE_ARMENIAN
    assert re.fullmatch(r"Call \+49 3\d \d{6} or \+493\d{7} or \+380 4\d \d{3} \d{4}", got[3])
    assert got[3][5:18].replace(" ", "") == got[3][21:33].strip().replace(" ", "")
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("+49 3"), F.lpad(F.col("id").cast("string"), 1, "0"), F.lit(" 000 "), F.lpad((F.col("id") * 7).cast("string"), 4, "0")).alias("text"))
    shaped = [r.text for r in pseudonymise(many).collect()]
    assert all(re.fullmatch(r"\+49 3\d \d{3} \d{4}", t) for t in shaped)


def test_surrogates_stay_distinct(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("call +1 (555) 555-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" now")).alias("text")).withColumnRenamed("id", "doc_id")
    got = {re.search(r"\+1.*\d", r.text)[0] for r in pseudonymise(rows).collect()}
    assert len(got) == 3000
    assert not got & {r.text[5:-4] for r in rows.collect()}


def test_surrogates_of_very_many_names(spark):
    """More names than the first draws have forms, in each script; none is given twice, none is a name of the corpus."""
    n, digits = 25_000, {"mr": "abcdefghij", "ms": "абвгдежзик", "mx": "αβγδεζηθικ", "my": "աբգդեզէըթժ"}
    rows = [(t, f"Mr. {letters[0].upper()}{''.join(letters[int(c)] for c in f'{i:05d}')}") for t, letters in digits.items() for i in range(n)]
    got = pseudonymise(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", F.substring("text", 5, 99).alias("name"), "n_entities").toPandas()
    assert len(got) == len(rows) and (got.n_entities == 1).all()
    assert got.name.is_unique
    assert not set(got.name) & {t[4:] for _, t in rows}
    assert all(re.fullmatch(p, x) for d, p in (("mr", "[A-Za-z]+"), ("ms", "[А-я]+"), ("mx", "[Α-ω]+"), ("my", "[Ա-և]+")) for x in got.name[got.doc_id == d])


def test_surrogates_of_a_full_format(spark, monkeypatch):
    """Draws are made to have 200 forms for 900 numbers, and 2,000 once the first digit is drawn too."""
    monkeypatch.setattr(surrogates, "WIDER", 2)
    monkeypatch.setattr(surrogates, "_digit_stream", lambda draw: F.lpad((surrogates._number(draw, 1) % 2000).cast("string"), 8, "0"))
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.format_string("+65 61%06d", F.col("id")).alias("text"))
    got = [r.text for r in pseudonymise(rows).collect()]
    assert all(re.fullmatch(r"\+65 \d{8}", x) for x in got)
    assert len(set(got)) == 900 and not set(got) & {r.text for r in rows.collect()}


def test_surrogates_need_a_key(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        surrogates.pseudonymise(docs, "")
    for key in ("k", "k" * 64, "ключ" * 40):
        got = spark.range(1).select(surrogates.keyed(key, F.lit("a\x1fÅ"))).first()[0]
        assert got == hmac.new(key.encode(), "a\x1fÅ".encode(), "sha256").hexdigest()


def test_surrogates_of_a_megabyte_of_labels(spark):
    """The expression does not go deeper for each label; addresses beside the labels are still found."""
    labels = "see a@" + "b." * 500_000 + "!"
    rows = [(1, labels), (2, labels + " then ann@mail.example.org."), (3, "x@" + "a." * 126 + "com end")]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == labels and got[1].n_entities == 0
    assert got[2].text.startswith(labels) and "ann@mail" not in got[2].text and got[2].n_entities == 1
    assert got[3].n_entities == 1 and "a.a." not in got[3].text


def test_surrogates_use_no_python(spark):
    plan = pseudonymise(spark.createDataFrame(TEXTS, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_surrogates_on_documents(spark):
    got = {r.doc_id: r.text for r in surrogates.op10_surrogates(spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        planted = [m for m in re.findall(r"\b\d{16}\b|[\w.]+@[\w.]+\.com|\b[0-9a-f]{40}\b|\+1 \(\d{3}\) 555-\d{4}", r.text) if not m.isdigit() or luhn(m)]
        assert not any(m in got[r.doc_id] for m in planted)
        if not re.search(r"\d|@", r.text):
            assert got[r.doc_id] == r.text


def test_whatever_the_pattern_finds_has_the_hint(spark):
    rnd = random.Random(10)
    keys = ["a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6", "A1" * 16, "ab1" * 11] + ["".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (32, 40) for _ in range(3000)]
    entities = ["a@b.co", "1.2.3.4", "+1 22 333 4444", "(555) 234-5678", "555-234-5678", "4539 1488 0343 6467", "4539148803436467", "Mr Stone", "Mrs. O'Neil", "Госпожа Иванова", "Señor Ruiz", *keys]
    rows = spark.createDataFrame(list(enumerate(f"see {x} here" for x in entities)), "doc_id long, text string")
    assert rows.filter(F.col("text").rlike(surrogates.PATTERN) & ~F.col("text").rlike(surrogates.HINT)).count() == 0
    got = {r.doc_id: r for r in pseudonymise(rows.filter("doc_id < 14")).collect()}
    assert all(got[i].n_entities == 1 and entities[i] not in got[i].text for i in range(14))
