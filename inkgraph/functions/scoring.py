"""Lexicon sentiment of token arrays, in column functions: a compound score between -1 and 1.

The lexicon is a table (form -> valence), its forms of one or more tokens; `operators.phrases` finds them, the longest first. The rules are
the published ones for rule-based sentiment of short texts: negation within three tokens, intensifiers that fade with
distance, a contrastive "but", exclamation and question marks, and normalisation of the sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.functions.numbers import TICKS
from inkgraph.operators.phrases import matches

# Small built-in lexicon, chosen here; pass your own for real work.
LEXICON = {
    "good": 1.9, "great": 3.1, "love": 3.2, "loved": 2.9, "happy": 2.7, "joy": 2.8, "kind": 2.4, "friend": 2.2, "hope": 1.9, "peace": 2.5, "smile": 1.5, "laugh": 2.6, "brave": 2.4, "gentle": 1.9, "noble": 2.0, "honest": 2.3, "faithful": 1.9,
    "beautiful": 2.9, "delight": 3.0, "pleasure": 2.7, "tender": 1.6, "warm": 0.9, "thank": 1.5, "thanks": 1.9, "win": 2.8, "best": 3.2, "better": 1.9, "safe": 1.9, "trust": 2.3, "admire": 2.1, "comfort": 1.5, "calm": 1.3, "agreeable": 1.8, "charming": 2.8,
    "bad": -2.5, "hate": -2.7, "hated": -3.2, "sad": -2.1, "angry": -2.3, "anger": -2.7, "fear": -2.2, "afraid": -1.9, "death": -2.9, "dead": -3.3, "die": -2.9, "kill": -3.7, "murder": -3.7, "cruel": -2.8, "enemy": -2.2, "pain": -2.3, "war": -2.9, "cry": -2.1,
    "grief": -2.2, "sorrow": -2.4, "lonely": -1.5, "poor": -2.1, "proud": 2.1, "shame": -2.1, "ugly": -2.3, "wicked": -2.4, "wretched": -2.1, "worst": -3.1, "worse": -2.1, "terrible": -2.1, "horror": -2.7, "lost": -1.3, "weep": -2.7, "tears": -0.9, "jealous": -2.0, "betray": -3.2,
    "broken heart": -2.9, "heart of gold": 2.6, "kiss of death": -1.5, "cold blood": -2.3, "cut to the quick": -2.0, "over the moon": 2.7, "good for nothing": -2.4, "at peace": 2.2, "lost his temper": -2.0, "lost her temper": -2.0, "in love": 3.0, "dead to me": -2.8,
}
NEGATIONS = ["not", "no", "never", "none", "nor", "nothing", "neither", "nowhere", "cannot", "without", "hardly", "rarely", "seldom", "despite", "can't", "don't", "won't", "isn't", "wasn't", "aren't", "weren't", "couldn't", "didn't", "doesn't", "hadn't", "hasn't", "haven't", "shouldn't", "wouldn't"]
STRONGER = ["very", "really", "so", "most", "extremely", "quite", "utterly", "deeply", "entirely", "greatly", "highly", "truly", "completely", "awfully", "exceedingly"]
WEAKER = ["slightly", "somewhat", "barely", "almost", "scarcely", "partly", "little", "less", "nearly"]
BOOST, FADE, NEGATED, BUT_BEFORE, BUT_AFTER, EXCLAMATION, QUESTION, QUESTIONS, NORMAL = 0.293, (1.0, 0.95, 0.9), -0.74, 0.5, 1.5, 0.292, 0.18, 0.96, 15.0


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "form string, valence double")


def _value(tokens: Column, hit: Column, first: Column) -> Column:
    """A hit's valence after what stands up to three tokens before it, from the nearest on, as far as the tokens reach."""
    value = hit["valence"]
    for back, fade in enumerate(FADE, 1):
        at = hit["start"] - first - back
        before = F.when(at >= 0, F.get(tokens, at.cast("int")))
        value = F.element_at(F.transform(F.array(value), _moved(before, fade)), 1)
    return value


def _moved(before: Column, fade: float) -> Callable[[Column], Column]:
    step = F.when(before.isin(STRONGER), BOOST * fade).when(before.isin(WEAKER), -BOOST * fade).otherwise(0.0)
    return lambda v: (v + F.when(v < 0, -step).otherwise(step)) * F.when(before.isin(NEGATIONS), NEGATED).otherwise(1.0)


def compound(tokens: Column, hits: Column, first: Column | None = None) -> Column:
    """Score of the tokens, -1 to 1; 0 without a hit. ``hits``: array<struct<start, end, valence>> in order of start, at positions counted from ``first`` (0), all of it inside the tokens.

    Hits before the first "but" weigh half and those after it half as much again; up to four exclamation marks and two
    or more question marks push the sum away from 0.
    """
    first = F.lit(0) if first is None else first
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  value is computed once
    weight = lambda h, but: F.when(but < first, 1.0).when(h["start"] < but, BUT_BEFORE).when(h["start"] > but, BUT_AFTER).otherwise(1.0)
    total = lambda but: F.aggregate(F.transform(hits, lambda h: _value(tokens, h, first) * weight(h, but)), F.lit(0.0), lambda acc, v: acc + v)
    marks = lambda mark: F.when(F.array_contains(tokens, mark), F.size(F.filter(tokens, lambda t: t == mark))).otherwise(0)
    asked = bind(marks("?"), lambda n: F.when(n < 2, 0.0).when(n <= 3, n * QUESTION).otherwise(QUESTIONS))
    push = F.least(marks("!"), F.lit(4)) * EXCLAMATION + asked
    pushed = lambda x: x + bind(push, lambda p: F.when(x > 0, p).when(x < 0, -p).otherwise(0.0))
    scored = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / F.sqrt(x * x + NORMAL)))
    return F.when(F.size(hits) > 0, bind(bind(bind(F.array_position(tokens, "but") - 1 + first, total), pushed), scored)).otherwise(0.0)


def as_ticks(score: Column) -> Column:
    """Whole ten-thousandths, half up."""
    return F.floor(score * TICKS + 0.5).cast("bigint")


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, valence: the lexicon's forms in the texts. The lexicon may be of any size."""
    return matches(texts, lexicon.select("form", F.col("valence").cast("double").alias("valence")), keys).select(*keys, "start", "end", "valence")


def score_texts(texts: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score_e4 of each text (keys, tokens). Null and empty texts, and texts without a hit, score 0."""
    hits = lexicon_hits(texts, lexicon, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "valence"))).alias("hits"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,valence:double>>")
    return texts.join(hits, keys, "left").select(*keys, F.coalesce(as_ticks(compound(F.col("tokens"), F.coalesce("hits", none))), F.lit(0).cast("bigint")).alias("score_e4"))


def valence(tokens: Column, lexicon: dict[str, int]) -> Column:
    """Plain sum of whole-number valences over tokens, without leaving the JVM."""
    table = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, t: acc + F.coalesce(table[t], F.lit(0)))
