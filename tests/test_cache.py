"""The cache of annotations, and chapters that fail."""

import pytest
from pyspark.sql import functions as F

from inkgraph.operators import decay, mentions
from inkgraph.plans import pipelines
from inkgraph.sources import annotate

CHAPTERS = "book_id string, chapter int, text string"


def chapters(spark, *texts):
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(texts, 1)], CHAPTERS)


class Counting:
    """A dictionary that remembers how many chapters it was asked for."""

    def __init__(self, spark, broken=False):
        self.inner = annotate.Dictionary(spark.createDataFrame([("ann", 1), ("bob lee", 2)], "form string, coref int"))
        self.asked, self.broken = [], broken

    def annotate(self, asked):
        self.asked.append(sorted(r.chapter for r in asked.collect()))
        rows = self.inner.annotate(asked)
        return rows.withColumn("text", F.when(F.col("start") >= 0, F.raise_error(F.lit("broken"))).otherwise(F.col("text"))) if self.broken else rows


def rows(df):
    return sorted((r.chapter, r.coref, r.start, r.end, r.text) for r in df.collect())


def test_a_text_is_annotated_once(spark, tmp_path):
    cache, provider = annotate.Cache(str(tmp_path / "cache")), Counting(spark)
    first = chapters(spark, "Ann met Bob Lee", "nobody", "", None, "Ann")
    found, failures = cache.annotate(first, provider)
    want = [(1, 1, 0, 0, "ann"), (1, 2, 2, 3, "bob lee"), (5, 1, 0, 0, "ann")]
    assert rows(found) == want and failures.isEmpty() and found.columns == annotate.COLUMNS
    assert rows(cache.annotate(first, provider)[0]) == want
    assert provider.asked == [[1, 2, 3, 4, 5]]  # chapters without a name are known too
    changed = chapters(spark, "Ann met Bob Lee", "Bob Lee", "", None, "Ann")
    assert rows(cache.annotate(changed, provider)[0]) == [*want[:2], (2, 2, 0, 1, "bob lee"), want[2]]
    assert rows(cache.read(first)) == want  # the older text is still known
    assert provider.asked == [[1, 2, 3, 4, 5], [2]]


def test_a_run_that_fails_leaves_the_cache_whole(spark, tmp_path):
    cache = annotate.Cache(str(tmp_path / "cache"))
    before = chapters(spark, "Ann")
    cache.annotate(before, Counting(spark))
    after = chapters(spark, "Ann", "Ann and Bob Lee")
    with pytest.raises(Exception, match="broken"):
        cache.annotate(after, Counting(spark, broken=True))
    assert rows(cache.read(after)) == [(1, 1, 0, 0, "ann")]
    provider = Counting(spark)
    assert len(rows(cache.annotate(after, provider)[0])) == 3 and provider.asked == [[2]]


def test_nothing_to_annotate(spark, tmp_path):
    cache = annotate.Cache(str(tmp_path / "none"))
    found, failures = cache.annotate(chapters(spark).limit(0), Counting(spark))
    assert found.isEmpty() and failures.isEmpty() and cache.read(chapters(spark, "x")).isEmpty()


def model():
    def people(text):
        if "!" in text:
            raise RuntimeError("too loud")
        return [(1, i, i, w, "PER") for i, w in enumerate(text.split()) if w in ("ann", "bob")]

    return people


def test_one_chapter_that_raises(spark, tmp_path):
    """Its neighbours stay right, in both modes; it is tried again by the next run."""
    books = chapters(spark, "ann x", "bob ! ann", "bob y", None, "ann")
    cache = annotate.Cache(str(tmp_path / "cache"))
    found, failures = cache.annotate(books, annotate.Function(model))
    assert [tuple(r) for r in failures.collect()] == [("b", 2, "RuntimeError: too loud")]
    assert sorted((r.chapter, r.text) for r in found.collect()) == [(1, "ann"), (3, "bob"), (5, "ann")]
    assert [r.chapter for r in cache.missing(books).collect()] == [2]
    named = mentions.character_positions(found)
    edges = spark.createDataFrame([("b", 1, "ann", "bob", 10, 0), ("b", 3, "ann", "bob", 4, 0)], "book_id string, chapter int, a string, b string, weight long, sentiment_e4 long")
    fold = lambda reset: sorted((r.chapter, r.k, r.weight_e4, r.is_carry) for r in decay.decayed(edges, pipelines.after_failures(named, books, failures, reset)).collect())
    assert fold(False) == [(1, 1, 100_000, None), (3, 2, 82_000, False), (5, 3, 57_400, True)]
    assert fold(True) == [(1, 1, 100_000, None), (3, 1, 40_000, None), (5, 2, 28_000, True)]
