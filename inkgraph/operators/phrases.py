"""Phrases of one or more tokens found in token streams, leftmost first and of those the longest.

Token streams are cut into bounded pieces that reach over their end by a phrase's length. Every token meets the phrases that begin with it: the
phrases are sent to all tasks where their size, which is looked at first, allows it; else both sides are dealt out by that token. What
follows the token decides. Of the phrases found at one place the longest stays; of places that overlap, the leftmost, then the next that begins after its end, and so on:
matches (not tokens) of one text are put in order for that, on one task, and only runs of overlapping ones are gathered and folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions.text import pieces, tokenize

#: Positions in a piece; characters of all phrases up to which they are broadcast.
PIECE, BROADCAST_CHARS = 2048, 4_000_000
#: First words up to which tokens that begin no phrase are passed over before they become rows.
FIRST_WORDS = 10_000


def phrase_table(phrases: DataFrame, form: str = "form") -> DataFrame:
    """words array<string>, payload struct (the other columns): each token sequence once, with its least payload. Forms without a token are no phrases."""
    rest = [c for c in phrases.columns if c != form]
    words = phrases.select(tokenize(F.col(form)).alias("words"), F.struct(*rest).alias("payload"))
    return words.filter(F.size("words") > 0).groupBy("words").agg(F.min("payload").alias("payload"))


def matches(texts: DataFrame, phrases: DataFrame, keys: list[str], form: str = "form") -> DataFrame:
    """keys, start, end (both inclusive), and the columns of ``phrases`` but the form. ``texts``: keys and tokens array<string>, a row each; ``keys`` tell texts apart.

    Null and empty texts have no matches, nor has anything without phrases; a phrase of many tokens is one match, wherever a stretch of the text was cut.
    """
    table = phrase_table(phrases, form)
    size = table.agg(F.max(F.size("words")).alias("most"), F.sum(F.length(F.concat_ws(" ", "words"))).alias("chars")).first()
    most = size["most"] or 1
    held = F.broadcast(table) if (size["chars"] or 0) <= BROADCAST_CHARS else table
    cut = texts.select(*keys, F.inline(pieces(F.col("tokens"), PIECE, 0, most - 1)))
    firsts = [r[0] for r in table.select(F.col("words")[0]).distinct().limit(FIRST_WORDS + 1).collect()]
    own = cut.select(*keys, "first", "tokens", F.posexplode(F.slice("tokens", 1, PIECE)).alias("i", "word"))  # in generated code, where a function of each token would be interpreted
    begins = own if len(firsts) > FIRST_WORDS else own.filter(F.col("word").isin(firsts))
    at = begins.select(*keys, (F.col("first") + F.col("i")).alias("start"), "word", F.slice("tokens", F.col("i") + 1, most).alias("ahead"))
    found = at.join(held, F.col("word") == F.col("words")[0]).filter(F.slice("ahead", 1, F.size("words")) == F.col("words"))
    found = found.select(*keys, "start", (F.col("start") + F.size("words") - 1).alias("end"), "payload")
    if most > 1:
        found = found.repartition(*keys).groupBy(*keys, "start").agg(F.max_by(F.struct("end", "payload"), "end").alias("m")).select(*keys, "start", "m.*")
        before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("apart", F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True)))
        found = found.withColumn("run", F.sum(F.col("apart").cast("int")).over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
        run = found.groupBy(*keys, "run").agg(F.sort_array(F.collect_list(F.struct("start", "end", "payload"))).alias("run_of"))
        found = run.select(*keys, F.inline(leftmost("run_of")))
    return found.select(*keys, "start", "end", "payload.*")


def leftmost(name: str):
    """Of a sorted array of (start, end, ...), the first and then always the next that begins after the end of the last."""
    last = lambda kept: F.element_at(kept, -1)["end"]
    fold = F.aggregate(name, F.slice(name, 1, 1), lambda kept, m: F.when(m["start"] > last(kept), F.array_append(kept, m)).otherwise(kept))
    return F.when(F.size(name) < 2, F.col(name)).otherwise(fold)
