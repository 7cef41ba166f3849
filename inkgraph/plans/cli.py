"""Command line: ``python -m inkgraph.plans.cli plain|carried|sweep --chapters ... --entities ... --out ...``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.operators import decay, sweep
from inkgraph.plans import pipelines
from inkgraph.sources import annotate, readers, writers
from inkgraph.sources.store import kept


# Option names and defaults are fixed values.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("mode", choices=["plain", "carried", "sweep"])
    p.add_argument("--books", help="pattern of whole books; split into chapters at headings")
    p.add_argument("--chapters", help="pattern of {book_id}_ch{NN}.txt files, instead of --books")
    p.add_argument("--entities", help="pattern of {book_id}_ch{NN}.entities files")
    p.add_argument("--tokens", help="pattern of {book_id}_ch{NN}.tokens files, which the positions of --entities count; without it they count the program's own tokens")
    p.add_argument("--dictionary", help="file of lines 'surface form TAB number of the person'; annotates the chapters that have no entities")
    p.add_argument("--cache", help="folder in which annotations are kept from run to run (default: annotations in --out)")
    p.add_argument("--on_failure", choices=["keep", "reset"], help="what carried state does at a chapter that could not be annotated; sweeps reset, other runs keep")
    p.add_argument("--lexicon", help="file of lines 'word or phrase TAB valence', in place of the built-in one")
    p.add_argument("--gold", help="pattern of {book_id}_ch{NN}.graphml files")
    p.add_argument("--out", required=True)
    p.add_argument("--window", type=int, default=100)
    p.add_argument("--min_freq", type=int, default=3)
    p.add_argument("--alpha", type=float, default=0.7)
    p.add_argument("--strategy", choices=["flat", "edges", "topN"], default="topN")
    p.add_argument("--topN", type=int, default=20)
    p.add_argument("--evaluate", action="store_true")
    return p


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("book_id", F.regexp_replace("stem", r"_ch[^_]*$", "")).withColumn("chapter", F.regexp_extract("stem", r"_ch([^_]*)$", 1).try_cast("int")).drop("stem")


def _pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="").dropna()


def _entities(spark: SparkSession, a: argparse.Namespace, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, failures): those of the files, and the dictionary's for chapters that have none there."""
    given = readers.read_entities(spark, a.entities) if a.entities else None
    if not a.dictionary:
        return given, chapters.select("book_id", "chapter").limit(0)
    provider = annotate.Dictionary(_pairs(spark, a.dictionary, "form string, coref int"))
    without = chapters if given is None else chapters.join(given.select("book_id", "chapter").distinct(), ["book_id", "chapter"], "left_anti")
    found, failures = annotate.Cache(a.cache or f"{a.out}/annotations").annotate(without, provider)
    return found if given is None else given.select(*annotate.COLUMNS).unionByName(found), failures


def _show(rows: DataFrame, columns: dict[str, str], order: list[str]) -> None:
    print(" ".join(columns))
    for r in writers.table_text(rows.orderBy(*order), columns).toLocalIterator():
        print(r.line)


#: Console tables: column -> format.
SUMMARY = {"book_id": "%-20s", "chapter": "%7d", "node_count": "%10d", "edge_count": "%10d"}
SWEEP = {"book_id": "%-20s", "alpha": "%5d", "precision_e4": "%12d", "recall_e4": "%9d", "f1_e4": "%6d"}


def main(args: list[str]) -> int:
    a = parser().parse_args(args)
    if not (a.books or a.chapters) or not (a.entities or a.dictionary):
        print("one of --books and --chapters is needed, and one of --entities and --dictionary")
        return 1
    try:
        params = pipelines.Params(a.window, a.min_freq, a.alpha, strategy=a.strategy, top_n=a.topN)
    except ValueError as e:
        print(e)
        return 1
    spark = SparkSession.builder.getOrCreate()
    chapters = readers.read_chapters(spark, a.chapters) if a.chapters else readers.split_chapters(readers.require_chapters(readers.read_books(spark, a.books)))
    if chapters.limit(1).isEmpty():
        print("no chapters")
        return 1
    if a.mode != "plain" and chapters.select("book_id", "chapter").distinct().limit(2).count() < 2:
        print("warning: with fewer than two chapters nothing is carried")
    lexicon = _pairs(spark, a.lexicon, "form string, valence double") if a.lexicon else None
    entities, failures = _entities(spark, a, chapters)
    foreign = kept(readers.read_tokens(spark, a.tokens), f"{a.out}/tokens") if a.tokens else None
    found, edges = (kept(x, f"{a.out}/{name}") for x, name in zip(pipelines.extract(chapters, entities, params, lexicon, foreign), ("mentions", "edges"), strict=True))
    if not failures.isEmpty():
        print("chapters that failed are in the cache's rows")
        found = pipelines.after_failures(found, chapters, failures, reset=(a.on_failure or ("reset" if a.mode == "sweep" else "keep")) == "reset")
    gold = tuple(map(_keyed, readers.read_graphml(spark, a.gold))) if a.gold else None
    if a.mode == "sweep":
        if gold is None or gold[0].limit(1).isEmpty():
            print("a sweep needs gold graphs")
            return 1
        results, best = pipelines.alpha_search(found, edges, gold[1], params, sweep.ALPHAS)
        linked = decay.decayed(edges, found, sweep.ALPHAS, params.least_weight)
        keys = ["alpha", "book_id", "chapter"]
        writers.write_graphml(writers.graphml_documents(decay.carried_nodes(found, linked), linked, keys), f"{a.out}/graphs", keys)
        _show(results, SWEEP, ["book_id", "alpha"])
        writers.write_records(results, f"{a.out}/sweep")
        writers.write_records(best, f"{a.out}/best_alpha")
        return 0
    graphs = pipelines.plain(found, edges) if a.mode == "plain" else pipelines.carried(found, edges, params)
    writers.write_graphml(writers.graphml_documents(graphs.nodes, graphs.edges), f"{a.out}/graphs")
    _show(graphs.summary, SUMMARY, ["book_id", "chapter"])
    writers.write_records(graphs.summary, f"{a.out}/summary")
    if a.mode == "carried":
        writers.write_records(pipelines.snapshots(graphs, found, params), f"{a.out}/snapshots")
    if a.evaluate and gold is not None:
        writers.write_records(pipelines.evaluate(graphs, *gold), f"{a.out}/evaluation")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
