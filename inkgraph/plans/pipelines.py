"""End-to-end plans: chapters and annotations to graphs, evaluations and sweeps.

Every plan handles all books and chapters in one lazy DataFrame; nothing loops over chapters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.functions import scoring
from inkgraph.functions import text as T
from inkgraph.functions.numbers import polarity, ticks
from inkgraph.operators import align, cooccur, decay, graph, mentions, metrics, snapshot, sweep
from inkgraph.sources.store import fresh_path, kept

KEYS = ["book_id", "chapter"]


@dataclass
class Params:
    """The command line's parameters and their defaults."""

    window: int = 100
    min_freq: int = 3
    alpha: float = 0.7
    least_weight: float = 0.5
    strategy: str = "topN"
    top_n: int = 20

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")


@dataclass
class Graphs:
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def prepared(chapters: DataFrame) -> DataFrame:
    """book_id, chapter, tokens, n_tokens of the cleaned text."""
    tokens = chapters.select(*KEYS, T.clean_tokens(F.col("text")).alias("tokens"))
    return tokens.withColumn("n_tokens", F.size("tokens"))


def centre_scores(tokens: DataFrame, half: int, lexicon: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that adds score_e4 to the rows of `cooccur.windows`: the score of the ``half`` tokens on either side of the centre.

    A stretch of a chapter is one row: its tokens, the lexicon's hits near it, and its centres. The tokens go out once, and no row has more than
    a stretch of them, so one long chapter is many tasks. A form that the window's border cuts does not count.
    """
    size = cooccur.scored_stretch(half)
    cut = tokens.select(*KEYS, F.inline(T.pieces(F.col("tokens"), size, half, half)))
    cut = cut.select(*KEYS, F.col("stretch").alias("bucket"), "first", F.array_join("tokens", " ").alias("joined"))  # tokens hold no spaces; a string takes a third of the room
    near = F.array_distinct(F.array(*[F.floor((F.col("start") + x) / size) for x in (0, -half, half)]))
    hits = scoring.lexicon_hits(tokens, lexicon, KEYS).select(*KEYS, F.explode(near).alias("bucket"), F.struct("start", "end", "valence").alias("hit"))
    hits = hits.groupBy(*KEYS, "bucket").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,valence:double>>")

    def scored(c: Column, words: Column) -> Column:
        low, high = F.greatest(c["pos"] - half, F.lit(0)), c["pos"] + half
        context = F.slice(words, (low - F.col("first") + 1).cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))
        inside = F.filter("hits", lambda h: (h["start"] >= low) & (h["end"] <= high))
        score = F.element_at(F.transform(F.array(F.struct(context.alias("tokens"), inside.alias("hits"))), lambda x: scoring.compound(x["tokens"], x["hits"], low)), 1)
        return F.struct(c["pos"].alias("pos"), c["cast"].alias("cast"), scoring.as_ticks(score).alias("score_e4"))

    def add(found: DataFrame) -> DataFrame:
        centres = found.groupBy(*KEYS, "bucket").agg(F.collect_list(F.struct("pos", "cast")).alias("centres"))
        rows = centres.join(cut, [*KEYS, "bucket"]).join(hits, [*KEYS, "bucket"], "left").withColumn("hits", F.coalesce("hits", none))
        each = F.transform(F.array(F.split("joined", " ")), lambda words: F.transform("centres", lambda c: scored(c, words)))  # split once a stretch
        return rows.select(*KEYS, F.inline(F.flatten(each)))

    return add


def in_own_tokens(entities: DataFrame, foreign: DataFrame, tokens: DataFrame) -> DataFrame:
    """``entities`` with positions in ``tokens``; their texts, where they have none, are those of the foreign tokens. Those not aligned stand at -1."""
    names, chapters = entities.columns, foreign.select(*KEYS).distinct()
    theirs = mentions.fill_spans(entities.join(chapters, KEYS, "left_semi").select(*names), foreign)
    return entities.join(chapters, KEYS, "left_anti").select(*names).unionByName(align.carried_over(align.align(theirs, foreign, tokens)))


def extract(chapters: DataFrame, entities: DataFrame, params: Params, lexicon: DataFrame | None = None, foreign: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, edges with sentiment). ``entities`` as `sources.readers.read_entities` gives them; ``lexicon``: form, valence (None: the built-in one).

    ``foreign``: the tokens that positions of entities count (`sources.readers.read_tokens`), where these are another tokeniser's; chapters
    that have none there count the library's own.

    Tokens are written once to the shared folder; entities are read several times, so they should be a table (`sources.annotate.Cache`) and not a provider's plan.
    """
    spark = chapters.sparkSession
    tokens = kept(prepared(chapters), fresh_path(spark, "tokens"))
    if foreign is not None:
        entities = kept(in_own_tokens(entities, foreign, tokens), fresh_path(spark, "aligned"))
    found = mentions.character_positions(mentions.fill_spans(entities, tokens))
    half = params.window // 2
    scores = centre_scores(tokens, half, scoring.built_in(spark) if lexicon is None else lexicon)
    return found, cooccur.edges(cooccur.in_range(found, tokens), half, params.min_freq, scores=scores)


def plain(found: DataFrame, edges: DataFrame) -> Graphs:
    """Each chapter by itself."""
    nodes, linked = graph.plain_nodes(found), graph.plain_edges(edges)
    return Graphs(nodes, linked, graph.summary_records(nodes, linked))


def alpha_parts(alpha: float) -> tuple[int, int]:
    """alpha as whole hundredths, or else as whole parts of the least power of ten that holds all its digits (nine at most)."""
    exact = Decimal(repr(alpha))
    digits = max(2, -exact.normalize().as_tuple().exponent)
    if digits > 9:
        raise ValueError("alpha may have nine decimal places")
    return int(exact.scaleb(digits)), 10**digits


def carried(found: DataFrame, edges: DataFrame, params: Params) -> Graphs:
    """Each chapter on top of the ones before it."""
    parts, whole = alpha_parts(params.alpha)
    linked = decay.decayed(edges, found, [parts], params.least_weight, whole=whole)
    first = found.groupBy(*KEYS, "name").agg(F.min("line_no").alias("first"))
    nodes = decay.carried_nodes(found, linked).join(first, [*KEYS, "name"], "left").withColumn("first", F.coalesce("first", F.lit(1 << 40)))
    return Graphs(nodes, linked, graph.summary_records(nodes, linked))


def after_failures(found: DataFrame, chapters: DataFrame, failures: DataFrame, reset: bool) -> DataFrame:
    """Mentions for `carried`, `decay.decayed` and sweeps when some chapters failed: their state passes over a failed chapter, or with ``reset`` starts afresh after it."""
    if not reset:
        return found.join(failures.select(*KEYS).distinct(), KEYS, "left_anti")
    failed = failures.select(*KEYS).distinct().withColumn("failed", F.lit(True))
    flagged = chapters.select(*KEYS).distinct().join(failed, KEYS, "left").fillna(False, ["failed"])
    return found.join(decay.segments(flagged), KEYS)


def snapshots(graphs: Graphs, found: DataFrame, params: Params) -> DataFrame:
    """Snapshot of each chapter's previous graph, as the next chapter sees it: book_id [, segment], k, snapshot."""
    place = decay.ordinals(found)
    runs = [c for c in ("book_id", "segment") if c in found.columns]
    cast = found.join(place.select(*KEYS, "k"), KEYS).select(*runs, (F.col("k") - 1).alias("k"), "name")
    return snapshot.serialize(graphs.edges, params.strategy, params.top_n, cast if params.strategy == "topN" else None, [*runs, "k"])


def evaluate(graphs: Graphs, gold_nodes: DataFrame, gold_edges: DataFrame, budget: int = 200_000) -> DataFrame:
    """book_id, chapter, precision_e4, recall_e4, f1_e4, jaccard_e4, agreement_e4, ged; for chapters with a gold graph."""
    judged = gold_nodes.select(*KEYS).distinct().join(graphs.nodes.select(*KEYS).distinct(), KEYS, "left_semi")
    own = lambda df: df.join(judged, KEYS, "left_semi")
    linked = own(graphs.edges)
    prf = metrics.precision_recall_f1(linked, own(gold_edges), KEYS, chapters=judged)
    agreed = metrics.polarity_agreement(linked, own(gold_edges)).select(*KEYS, "agreement_e4")
    ged = metrics.graph_edit_distance(own(graphs.nodes), linked, own(gold_nodes), own(gold_edges), KEYS, budget)
    return prf.join(agreed, KEYS, "left").join(ged, KEYS, "left").fillna(0, ["agreement_e4"])


def alpha_search(found: DataFrame, edges: DataFrame, gold_edges: DataFrame, params: Params, alphas: list[int] = sweep.ALPHAS) -> tuple[DataFrame, DataFrame]:
    """(results by alpha, the best alpha of each book)."""
    results = sweep.sweep(edges, found, gold_edges, alphas, params.least_weight)
    return results, sweep.best_alpha(results)


def label(sentiment: Column) -> Column:
    """Polarity of a sentiment between -1 and 1."""
    return polarity(ticks(sentiment))
