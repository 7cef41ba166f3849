"""Edges carried across ordered chapters with exponential decay.

An edge's next value depends on its own previous value alone, so the sequential update is
independent for each (book, segment, alpha, pair): one group of observations, folded in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions.numbers import TICKS, polarity
from inkgraph.operators.cooccur import dealt

KEYS = ["book_id", "chapter"]
PLAIN, CARRIED = "co-occurrence", "co-occurrence-markov"


def _runs(chapters: DataFrame) -> list[str]:
    """Columns within which state passes from chapter to chapter: the book, and its segment where there is one."""
    return ["book_id", "segment"] if "segment" in chapters.columns else ["book_id"]


def ordinals(chapters: DataFrame) -> DataFrame:
    """book_id, chapter [, segment], k: place of each processed chapter of a book (or segment), from 1; skipped chapters have no place."""
    runs = _runs(chapters)
    known = chapters.select(*runs, "chapter").distinct()
    return known.withColumn("k", F.row_number().over(Window.partitionBy(*runs).orderBy("chapter")))


#: What one pair is in one chapter, while it is folded; ``exact``: its sentiment before rounding, times ``whole``.
STEP = "struct<k:bigint,weight:bigint,sentiment:bigint,exact:decimal(38,0),carry:boolean>"


def _let(value: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """body(value) with the value computed once."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


def _nearest(n: Column, d: int) -> Column:
    """n / d as the nearest whole number, half away from zero, in whole numbers throughout."""
    return (F.signum(n) * F.call_function("div", 2 * F.abs(n) + d, F.lit(2 * d))).cast("bigint")


def fold(seen: Column, last: Column, part: Column, least: int, whole: int = 100) -> Column:
    """The steps of one pair in order, an array of STEP.

    ``seen``: array of (k, weight, sentiment_e4), at most one a chapter. ``part``: alpha in parts of ``whole``.
    ``least``: ticks below which a carry is pruned; after that no chapter is visited up to the next observation.
    """
    wide = "bigint" if whole <= 10**6 else "decimal(38,0)"  # products of weights and parts have to fit
    part = part.cast(wide)

    def at(k: Column, weight: Column, sentiment: Column, carry: Column) -> Column:
        return F.struct(k.alias("k"), _nearest(weight, whole).alias("weight"), _nearest(sentiment, whole).alias("sentiment"), sentiment.cast("decimal(38,0)").alias("exact"), carry.alias("carry")).cast(STEP)

    def lives(done: Column, k: Column) -> Column:
        end = F.element_at(done, -1)
        return (end.k == k - 1) & (part * end.weight >= least * whole)

    def carried(done: Column, k: Column) -> Column:
        end = F.element_at(done, -1)
        return F.when(lives(done, k), F.array_append(done, at(k, part * end.weight, part * end.sentiment, F.lit(True)))).otherwise(done)

    def observed(done: Column, now: Column) -> Column:
        end = F.get(done, F.size(done) - 1)
        linked = end.isNotNull() & (end.k == now.k - 1)
        weight, sentiment = (now.weight * TICKS).cast(wide), now.sentiment_e4.cast(wide)
        before = lambda field: F.when(linked, end[field]).otherwise(F.lit(0).cast("bigint"))
        first = now.k == 1
        blend = lambda old, new: F.when(first, new * whole).otherwise(part * old + (whole - part) * new)
        step = at(now.k, blend(before("weight"), weight), blend(before("sentiment"), sentiment), F.when(~first, F.lit(False)))
        chain = lambda grown: F.when((now.until > now.k + 1) & lives(grown, now.k + 1), F.aggregate(F.sequence(now.k + 1, now.until - 1), grown, carried)).otherwise(grown)
        return _let(F.array_append(done, step), chain, f"array<{STEP}>")

    ordered = F.array_sort(seen)
    until = F.transform(ordered, lambda x, i: F.struct(x.k.alias("k"), x.weight.alias("weight"), x.sentiment_e4.alias("sentiment_e4"), F.coalesce(F.get(ordered, i + 1).k, last.cast("bigint") + 1).alias("until")))
    return F.aggregate(until, F.array().cast(f"array<{STEP}>"), observed)


def fold_pair_floats(seen: dict[int, tuple[int, float]], last: int, alpha: float, least: float) -> Iterator[tuple]:
    """The same fold in binary floating point, rounded to four places as Python rounds: (k, weight, sentiment, is_carry)."""
    weight = sentiment = 0.0
    alive = False
    for k in range(min(seen), last + 1):
        now = seen.get(k)
        if now is not None:
            if k == 1:
                weight, sentiment = float(now[0]), now[1]
                yield k, weight, sentiment, None
            else:
                weight, sentiment = round(alpha * weight + (1 - alpha) * now[0], 4), round(alpha * sentiment + (1 - alpha) * now[1], 4)
                yield k, weight, sentiment, False
            alive = True
        elif alive and alpha * weight >= least:
            weight, sentiment = round(alpha * weight, 4), round(alpha * sentiment, 4)
            yield k, weight, sentiment, True
        else:
            weight, sentiment, alive = 0.0, 0.0, False


def decayed(edges: DataFrame, chapters: DataFrame, alphas: list[int] = (70,), least: float = 0.5, exact_python: bool = False, whole: int = 100) -> DataFrame:
    """book_id, chapter [, segment], k, alpha (in parts of ``whole``: hundredths), a, b, weight_e4, sentiment_e4, polarity, label, is_carry.

    ``edges``: book_id, chapter, a, b, weight [, sentiment_e4]. ``chapters``: the processed ones; where they have a column ``segment`` (see
    `segments`), each segment starts afresh. Alpha is a column, so a sweep shares extraction. Observations of a pair are
    gathered once (at most one a chapter). Places, a row for each chapter, are broadcast: by chapters, far fewer than pairs, edges would meet in a few tasks. ``exact_python`` folds in binary floating point, by a Python function.
    """
    if not all(0 <= a <= whole for a in alphas):
        raise ValueError("alpha must lie between 0 and 1")
    place = ordinals(chapters).withColumn("book_id", F.col("book_id").cast("string"))
    runs = _runs(chapters)
    observed = (edges if "sentiment_e4" in edges.columns else edges.withColumn("sentiment_e4", F.lit(0).cast("bigint"))).withColumn("book_id", F.col("book_id").cast("string"))
    one = F.struct(F.col("k").cast("bigint").alias("k"), F.col("weight").cast("bigint").alias("weight"), F.col("sentiment_e4").cast("bigint").alias("sentiment_e4"))
    gathered = dealt(observed.join(F.broadcast(place), KEYS), *runs, "a", "b").groupBy(*runs, "a", "b", "h").agg(F.collect_list(one).alias("seen")).drop("h")
    ends = place.groupBy(*runs).agg(F.max("k").alias("last"))
    rows = gathered.join(F.broadcast(ends), runs).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    if exact_python:
        return _float_steps(rows, runs, least, whole).join(F.broadcast(place), [*runs, "k"])
    steps = rows.select(*runs, "alpha", "a", "b", F.explode(fold(F.col("seen"), F.col("last"), F.col("alpha"), round(least * TICKS), whole)).alias("step"))
    return steps.select(
        *runs, F.col("step.k").cast("int").alias("k"), "alpha", "a", "b", F.col("step.weight").alias("weight_e4"), F.col("step.sentiment").alias("sentiment_e4"),
        polarity(F.col("step.exact"), whole).alias("polarity"), F.when(F.col("step.carry").isNull(), PLAIN).otherwise(CARRIED).alias("label"), F.col("step.carry").alias("is_carry"),
    ).join(F.broadcast(place), [*runs, "k"])


def _float_steps(rows: DataFrame, runs: list[str], least: float, whole: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*runs, "k", "alpha", "a", "b", "weight_e4", "sentiment_e4", "polarity", "label", "is_carry"]
    kinds |= {"k": "int", "weight_e4": "long", "sentiment_e4": "long", "polarity": "string", "label": "string", "is_carry": "boolean"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = []
            for r in pdf.itertuples(index=False):
                seen = {x["k"]: (x["weight"], x["sentiment_e4"] / TICKS) for x in r.seen}
                own = tuple(getattr(r, c) for c in runs)
                held += [(*own, k, r.alpha, r.a, r.b, round(w * TICKS), round(s * TICKS), None, PLAIN if c is None else CARRIED, c) for k, w, s, c in fold_pair_floats(seen, r.last, r.alpha / whole, least)]
                if len(held) > 50_000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)

    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def carried_nodes(mentions: DataFrame, graph: DataFrame) -> DataFrame:
    """book_id, chapter, alpha, name, mention_count: the cast, and ends of the previous chapter's edges that this one lacks.

    Ends of edges that were pruned on the way stay one chapter, with no mentions.
    """
    place, runs = ordinals(mentions), _runs(mentions)
    alphas = graph.select("alpha").distinct()
    cast = mentions.groupBy(*KEYS, "name").agg(F.count("*").alias("mention_count")).crossJoin(F.broadcast(alphas))
    ends = graph.select(*runs, (F.col("k") + 1).alias("k"), "alpha", F.explode(F.array("a", "b")).alias("name")).distinct()
    ghosts = ends.join(F.broadcast(place), [*runs, "k"]).select(*KEYS, "alpha", "name")
    joined = cast.join(ghosts, [*KEYS, "alpha", "name"], "full_outer")
    return joined.select(*KEYS, "alpha", "name", F.coalesce("mention_count", F.lit(0)).cast("bigint").alias("mention_count"))


def segments(chapters: DataFrame, failed: str = "failed") -> DataFrame:
    """book_id, chapter, segment for chapters that did not fail; a failure starts the state afresh after it."""
    order = Window.partitionBy("book_id").orderBy("chapter")
    return chapters.withColumn("segment", F.sum(F.col(failed).cast("int")).over(order)).filter(~F.col(failed)).drop(failed)


def continuity(mentions: DataFrame) -> DataFrame:
    """book_id, chapter, shared, new, lost: the cast against that of the chapter before; from the second on."""
    place = ordinals(mentions)
    cast = mentions.select(*KEYS, "name").distinct().join(place, KEYS).select("book_id", "k", "name")
    before = cast.select("book_id", (F.col("k") + 1).alias("k"), "name").withColumn("was", F.lit(1))
    both = cast.withColumn("is", F.lit(1)).join(before, ["book_id", "k", "name"], "full_outer")
    counted = both.groupBy("book_id", "k").agg(F.count_if(F.col("is").isNotNull() & F.col("was").isNotNull()).alias("shared"), F.count_if(F.col("was").isNull()).alias("new"), F.count_if(F.col("is").isNull()).alias("lost"))
    return counted.join(place, ["book_id", "k"]).filter("k > 1").select(*KEYS, "shared", "new", "lost")
