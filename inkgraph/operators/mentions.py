"""Entity mentions under canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.functions.text import pieces, strip
from inkgraph.operators.phrases import PIECE

# Pronouns that never name a cluster that has another mention.
PRONOUNS = ["he", "she", "they", "him", "her", "them", "his", "hers", "their", "theirs", "it", "its", "i", "we", "us", "our", "you", "your", "me", "my"]
PERSON_TYPES = ["PER", "PERSON"]
UNKNOWN = "UNKNOWN"


def people(entities: DataFrame) -> DataFrame:
    return entities.filter(F.upper("etype").isin(PERSON_TYPES))


def fill_spans(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Entities without text take the tokens start..end of their chapter. ``tokens``: book_id, chapter, tokens array<string>; (book_id, chapter, line_no) tells entities apart.

    Only entities without text move, as positions: they meet stretches of their chapter's tokens, and a span over several is put
    together from its parts. Positions outside the chapter give no words; in a chapter without tokens the text stays as it is. Whether there
    are any is looked at first, so that no tokens are exchanged where there are none.
    """
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    if entities.filter(blank).isEmpty():
        return entities
    ids = ["book_id", "chapter", "line_no"]
    over = F.sequence(F.floor(F.greatest("start", F.lit(0)) / PIECE), F.floor(F.greatest("start", "end", F.lit(0)) / PIECE))
    asked = entities.filter(blank).select(*ids, "start", "end", F.explode(over).alias("stretch"))
    cut = tokens.select("book_id", "chapter", F.inline(pieces(F.col("tokens"), PIECE)))
    low = F.greatest(F.col("start"), F.lit(0)) - F.col("first")
    part = F.slice("tokens", F.greatest(low, F.lit(0)).cast("int") + 1, F.greatest(F.col("end") - F.col("first") + 1 - F.greatest(low, F.lit(0)), F.lit(0)).cast("int"))
    parts = asked.join(cut, ["book_id", "chapter", "stretch"]).select(*ids, "stretch", part.alias("part"))
    spans = parts.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("stretch", "part"))).alias("p")).select(*ids, F.array_join(F.flatten(F.transform("p", lambda x: x["part"])), " ").alias("span"))
    filled = entities.filter(blank).join(spans, ids, "left").withColumn("text", F.coalesce("span", "text")).select(*entities.columns)
    return entities.filter(~blank).unionByName(filled)


def canonical_names(mentions: DataFrame, group: list[str], text: str = "text", order: str = "line_no") -> DataFrame:
    """group, name: the commonest stripped surface form that is no pronoun (else the commonest), ties to the first seen.

    Counts per (group, form) are partially aggregated before the shuffle, and the choice among forms is
    an aggregate as well, so a cluster with very many mentions never gathers in one place.
    """
    formed = mentions.withColumn("form", strip(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    counted = formed.groupBy(*group, "form").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.struct((F.col("form") != "").alias("a"), (~F.lower("form").isin(PRONOUNS)).alias("b"), F.col("n").alias("c"), (-F.col("first")).alias("d"))
    named = counted.groupBy(*group).agg(F.max_by("form", rank).alias("form"))
    return named.select(*group, F.when(F.col("form") == "", UNKNOWN).otherwise(F.col("form")).alias("name"))


def character_positions(entities: DataFrame) -> DataFrame:
    """mentions(book_id, chapter, name, pos, line_no): clusters with one canonical name are one character; duplicates stay."""
    who = people(entities)
    names = canonical_names(who, ["book_id", "chapter", "coref"])
    return who.join(names, ["book_id", "chapter", "coref"]).select("book_id", "chapter", "name", F.col("start").cast("bigint").alias("pos"), "line_no")


def mention_counts(mentions: DataFrame) -> DataFrame:
    """book_id, chapter, name, mention_count: duplicates and positions out of range count."""
    return mentions.groupBy("book_id", "chapter", "name").agg(F.count("*").alias("mention_count"))


def positions(mentions: DataFrame) -> DataFrame:
    """book_id, chapter, name, positions: sorted, duplicates kept."""
    return mentions.groupBy("book_id", "chapter", "name").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
