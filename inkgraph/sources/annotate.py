"""Annotation providers: chapters to entity rows. Models plug in here; a dictionary annotator is built in.

`Cache` keeps what providers return, so that a text is annotated once, and a chapter that fails is a row and not the end of the job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.functions.text import clean_tokens
from inkgraph.operators.phrases import matches
from inkgraph.sources.store import exists

COLUMNS = ["book_id", "chapter", "line_no", "coref", "start", "end", "text", "etype"]


#: Rows that a Python provider hands on at once.
ROWS = 10_000


class Provider(Protocol):
    """Anything that turns (book_id, chapter, text) into rows of COLUMNS.

    A chapter that could not be annotated may be a row with its reason in a further column ``error``; whatever else is said of that chapter is not used.
    """

    def annotate(self, chapters: DataFrame) -> DataFrame: ...


class Dictionary:
    """Surface forms of one or more tokens from a table (form, coref), in the token space of `tokenize`.

    Forms are tokenised as texts are, so letter case and spacing do not matter. Matches do not overlap: the leftmost
    stays, and of those that begin together the longest. Forms of equal tokens count as the one of least number. The table may be of any size; no model leaves the JVM.
    """

    def __init__(self, forms: DataFrame, etype: str = "PER"):
        self.forms, self.etype = forms, etype

    def annotate(self, chapters: DataFrame) -> DataFrame:
        texts = chapters.select("book_id", "chapter", clean_tokens(F.col("text")).alias("tokens"))
        found = matches(texts, self.forms.select("coref", F.col("form").alias("text"), "form"), ["book_id", "chapter"])
        number = lambda c: F.col(c).cast("int").alias(c)
        return found.select("book_id", "chapter", F.col("start").cast("int").alias("line_no"), "coref", number("start"), number("end"), "text", F.lit(self.etype).alias("etype"))


class Function:
    """A Python function of a chapter's text that gives (coref, start, end, text, etype) rows: where a model is called.

    ``make`` is called once in each task and returns the function, so that a model is loaded where it runs. What the
    function raises for one chapter becomes that chapter's row of ``error``; the other chapters go on.
    """

    def __init__(self, make: Callable[[], Callable[[str], Iterable[tuple]]]):
        self.make = make

    def annotate(self, chapters: DataFrame) -> DataFrame:
        make = self.make
        kinds = {f.name: f.dataType.simpleString() for f in chapters.schema}
        names = [*COLUMNS, "error"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, held = make(), []
            table = lambda: pd.DataFrame(held, columns=names).astype({c: "Int64" for c in ("line_no", "coref", "start", "end")})
            for pdf in batches:
                for book, chapter, text in zip(pdf["book_id"], pdf["chapter"], pdf["text"], strict=True):
                    try:
                        held += [(book, chapter, i, *row, None) for i, row in enumerate(call("" if text is None else text))]
                    except Exception as e:  # of whatever kind: models raise their own
                        held.append((book, chapter, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    if len(held) >= ROWS:
                        yield table()
                        held = []
            if held:
                yield table()

        return chapters.select("book_id", "chapter", "text").mapInPandas(run, f"book_id {kinds['book_id']}, chapter {kinds['chapter']}, line_no int, coref int, start int, end int, text string, etype string, error string")


class Cache:
    """Annotations kept under ``path``, by book, chapter and text.

    A run writes the rows of the chapters that have none for their present text to a folder of its own, and then, as its last step, which
    chapters these are. Rows count only by that list, so a run that ends early leaves no trace, a second run finds nothing to do,
    and a changed text is annotated again and its old rows are no longer read. Chapters that failed are not on the list: the next run tries them again.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _done(self, chapters: DataFrame) -> DataFrame | None:
        spark = chapters.sparkSession
        if not exists(spark, f"{self.path}/done"):
            return None
        schema = chapters.select("book_id", "chapter").withColumns({"text_hash": F.lit(""), "run": F.lit("")}).schema
        return spark.read.schema(schema).parquet(f"{self.path}/done").groupBy("book_id", "chapter", "text_hash").agg(F.max("run").alias("run"))

    def missing(self, chapters: DataFrame) -> DataFrame:
        """book_id, chapter, text, text_hash of the chapters without annotations for their text."""
        hashed = chapters.select("book_id", "chapter", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
        done = self._done(chapters)
        return hashed if done is None else hashed.join(done, ["book_id", "chapter", "text_hash"], "left_anti")

    def read(self, chapters: DataFrame) -> DataFrame:
        """The kept rows (COLUMNS) of these chapters as their texts are now."""
        done = self._done(chapters)
        keys = chapters.select("book_id", "chapter", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash")).distinct()
        schema = ", ".join(f"{c} {chapters.schema[c].dataType.simpleString()}" for c in ("book_id", "chapter")) + ", line_no int, coref int, start int, end int, text string, etype string, error string, run string"
        if done is None:
            return chapters.sparkSession.createDataFrame([], schema).select(*COLUMNS)
        live = keys.join(done, ["book_id", "chapter", "text_hash"]).drop("text_hash")
        return chapters.sparkSession.read.schema(schema).parquet(f"{self.path}/rows").join(live, ["run", "book_id", "chapter"]).select(*COLUMNS)

    def annotate(self, chapters: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
        """(entities of all chapters, failures of this run: book_id, chapter, error). Only missing chapters reach the provider, each once."""
        spark, todo, run = chapters.sparkSession, self.missing(chapters), uuid.uuid4().hex
        none = chapters.select("book_id", "chapter", F.lit("").alias("error")).limit(0)
        if todo.isEmpty():
            return self.read(chapters), none
        rows = provider.annotate(todo.select("book_id", "chapter", "text"))
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        numbers = ("line_no", "coref", "start", "end")
        rows = rows.select(*[F.col(c).cast("int").alias(c) if c in numbers else F.col(c) for c in COLUMNS], error.alias("error"))
        rows.write.parquet(f"{self.path}/rows/run={run}")
        failures = spark.read.schema(rows.schema).parquet(f"{self.path}/rows/run={run}").filter("error is not null").groupBy("book_id", "chapter").agg(F.min("error").alias("error"))
        ended = todo.select("book_id", "chapter", "text_hash").distinct().join(failures, ["book_id", "chapter"], "left_anti")
        ended.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.path}/done")
        return self.read(chapters), failures


def annotate_missing(chapters: DataFrame, cached: DataFrame, provider: Provider) -> DataFrame:
    """Cached annotations, and new ones for the chapters that have none; the key is book and chapter."""
    missing = chapters.join(cached.select("book_id", "chapter").distinct(), ["book_id", "chapter"], "left_anti")
    return cached.select(*COLUMNS).unionByName(provider.annotate(missing).select(*COLUMNS))
