import pytest
from pyspark.sql import functions as F

from inkgraph.functions import numbers
from inkgraph.functions import text as T
from inkgraph.sources import readers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Mr. O'Neil's well-known café (ok)!", "mr . o'neil's well-known caf ( ok ) !"), ("don’t", "don t"), ("", ""), ("«é»", "")],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, T.tokenize) == tokens.split()


def test_clean(spark):
    assert one(spark, "a\fb   c  d\n", T.clean_chapter_text) == "ab c d"
    assert one(spark, "x  y\x85z", T.clean_chapter_text) == "x yz"
    assert one(spark, None, T.clean_chapter_text) is None


def test_strip_markers(spark):
    assert one(spark, "x\n*** START OF THIS PROJECT GUTENBERG\nbody\n*** end of the project gutenberg ***\ny", T.strip_markers) == "body\n"
    assert one(spark, "plain", T.strip_markers) == "plain"
    assert one(spark, "*** START OF THE PROJECT GUTENBERG", T.strip_markers) == ""
    assert one(spark, "*** END OF THE PROJECT GUTENBERG *** START OF THE PROJECT GUTENBERG\nb", T.strip_markers) == ""


def chapters(spark, text):
    return [(r.chapter, r.text) for r in readers.split_chapters(spark.createDataFrame([("b", text)], "book_id string, text string")).orderBy("chapter").collect()]


def test_chapters(spark):
    assert chapters(spark, "x\nChapter 1\nbody1\nCHAPTER II. Two\nbody2") == [(1, "Chapter 1\nbody1"), (2, "CHAPTER II. Two\nbody2")]
    assert chapters(spark, "no headings") == []
    # a heading swallows the next line that is not blank, so headings in a row are one
    assert len(chapters(spark, "Chapter 1\nChapter 2\nbody\nthe middle\nChapter 3\nbody3")) == 2
    assert chapters(spark, "chap. twenty-one\nx") == [(1, "chap. twenty-one\nx")]
    assert chapters(spark, "The chapter one is\nnot a heading") == []


def test_books_without_headings_fail(spark):
    books = spark.createDataFrame([("b", "nothing")], "book_id string, text string")
    with pytest.raises(Exception, match="no chapter headings"):
        readers.split_chapters(readers.require_chapters(books)).collect()


def test_chapter_number(spark):
    assert one(spark, "/x/my_ch_book_ch07.txt", T.chapter_number) == 7
    assert one(spark, "/x/book.txt", T.chapter_number) is None


def test_context(spark):
    df = spark.createDataFrame([(list("abcdefg"),)], "t array<string>")
    assert [df.select(T.context(F.col("t"), F.lit(c), F.lit(2))).first()[0] for c in (0, 3, 6)] == ["a b c", "b c d e f", "e f g"]


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (500, 501, -500, -501)], "s long")
    assert [r[0] for r in df.select(numbers.polarity(F.col("s"))).collect()] == ["neutral", "positive", "neutral", "negative"]
    df = spark.createDataFrame([(7, 2), (-7, 2), (5, 10), (4, 10), (0, 3)], "n long, d long")
    assert [r[0] for r in df.select(numbers.round_div(F.col("n"), F.col("d"))).collect()] == [4, -4, 1, 0, 0]
    df = spark.createDataFrame([(8.2,), (12345.0,), (47.0,)], "x double")
    assert [r[0] for r in df.select(numbers.general_format("x")).collect()] == ["8.2", "1.234e+04", "47"]
