"""Text snapshots of a graph: adjacency lists, edge lists, heaviest edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions.numbers import TICKS, general_format
from inkgraph.operators.graph import KEYS


def _joined(rows: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(*order, line)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x[line]), "\n").alias("snapshot"))


def joined_lines(lines: DataFrame, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """keys, snapshot: the texts of `cooccur.edge_lines` or `cooccur.node_lines` in order, one under the other.

    They come sorted to the task of their graph, which holds one graph's text and nothing else of it. A snapshot is one string, so it has less than 2^31 bytes; a longer one fails.
    """
    kinds = dict(lines.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def row() -> pa.RecordBatch:
            text = "\n".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([text], pa.string())], names=[*keys, "snapshot"])

        for batch in batches:
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= pc.not_equal(batch[k][1:], batch[k][:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for start, stop in zip(starts, starts[1:], strict=False):
                if start == stop:
                    continue
                now = [batch[k][start] for k in keys]
                if held and now != key:
                    yield row()
                key = now
                held.append("\n".join(batch["text"].slice(start, stop - start).to_pylist()))
        if held:
            yield row()

    placed = lines.select(*keys, *order, "text").repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", snapshot string")


def flat(edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, snapshot: ``node: neighbour(+s,w=W), ...``, nodes ascending, heaviest neighbours first (ties by name)."""
    both = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other"), "weight_e4", "sentiment_e4").unionByName(edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"), "weight_e4", "sentiment_e4"))
    sign = F.when(F.col("sentiment_e4") >= 0, "+").otherwise("")
    text = F.concat(F.col("other").cast("string"), F.lit("("), sign, F.format_string("%.1f", F.col("sentiment_e4") / TICKS), F.lit(",w="), F.format_string("%.0f", F.col("weight_e4") / TICKS), F.lit(")"))
    near = both.select(*keys, "node", (-F.col("weight_e4")).alias("heavy"), "other", text.alias("text"))
    listed = F.sort_array(F.collect_list(F.struct("heavy", "other", "text")))
    lines = near.groupBy(*keys, "node").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("t")).withColumn("line", F.concat(F.col("node").cast("string"), F.lit(": "), "t"))
    return _joined(lines, keys, ["node"], "line")


def edge_line(a: Column, b: Column, weight_e4: Column, polarity: Column) -> Column:
    return F.concat(a.cast("string"), F.lit("--"), b.cast("string"), F.lit(": weight="), general_format(weight_e4 / TICKS), F.lit(", polarity="), polarity)


def edge_list(edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, snapshot: ``a--b: weight=W, polarity=P``, heaviest first (ties by names)."""
    rows = edges.select(*keys, (-F.col("weight_e4")).alias("heavy"), "a", "b", edge_line(F.col("a"), F.col("b"), F.col("weight_e4"), F.col("polarity")).alias("line"))
    return _joined(rows, keys, ["heavy", "a", "b"], "line")


def relevant(edges: DataFrame, cast: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Edges of which at least one end is in ``cast`` (keys, name)."""
    ends = edges.withColumn("name", F.explode(F.array("a", "b")))
    return ends.join(cast.select(*keys, "name").distinct(), [*keys, "name"], "left_semi").drop("name").distinct()


def top_edges(edges: DataFrame, n: int = 20, cast: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """keys, rank, a, b, weight_e4, polarity: the n heaviest relevant edges."""
    rows = edges if cast is None else relevant(edges, cast, keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("weight_e4"), "a", "b")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(*keys, "rank", "a", "b", "weight_e4", "polarity")


def top_list(edges: DataFrame, n: int = 20, cast: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    return edge_list(top_edges(edges, n, cast, keys), keys)


STRATEGIES = {"flat": lambda e, n, c, k: flat(e, k), "edges": lambda e, n, c, k: edge_list(e, k), "topN": top_list}


def serialize(edges: DataFrame, strategy: str = "flat", top_n: int = 20, cast: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Snapshots by name of the strategy; graphs without edges have no row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](edges, top_n, cast, keys)
