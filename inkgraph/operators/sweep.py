"""Decay factors compared against gold graphs; alpha is a column, so extraction runs once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.functions.numbers import TICKS, round_div
from inkgraph.operators.cooccur import dealt
from inkgraph.operators.decay import ordinals
from inkgraph.operators.metrics import ratios

# The grid, in hundredths.
ALPHAS = [30, 50, 70, 90]
#: Rows of pairs that are folded together.
AT_ONCE = 500_000


def alive(pair: np.ndarray, k: np.ndarray, weight: np.ndarray, last: np.ndarray, part: int, least: int, whole: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(pair, k) of every step of `decay.fold` for one alpha, all pairs at a time.

    Observations in the order of pair and k, at most one for each; ``weight`` in ticks; ``last``: the last place of the pair's run.
    """
    if len(weight) and int(weight.max()) > 2**62 // (2 * whole):
        raise OverflowError("weights too large for whole numbers of 64 bits")
    nearest = lambda n: (2 * n + whole) // (2 * whole)  # noqa: E731 (weights are not negative)
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
    many = np.diff(np.append(starts, len(pair)))
    until = np.where(np.append(pair[1:] == pair[:-1], False)[: len(pair)], np.append(k[1:], 0)[: len(pair)], last + 1)
    end_k, end_w = np.full(len(starts), -1, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    steps = [(pair, k)]
    for r in range(int(many.max(initial=0))):
        open_ = np.flatnonzero(many > r)
        at = starts[open_] + r
        before = np.where(end_k[open_] == k[at] - 1, end_w[open_], 0)
        w = nearest(np.where(k[at] == 1, weight[at] * whole, part * before + (whole - part) * weight[at]))
        end_k[open_], end_w[open_] = k[at], w
        on, to = open_, until[at]
        while len(on):
            live = (end_k[on] + 1 < to) & (part * end_w[on] >= least * whole)
            on, to = on[live], to[live]
            end_k[on] += 1
            end_w[on] = nearest(part * end_w[on])
            steps.append((pair[starts[on]], end_k[on].copy()))
    return np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])


def _numbered(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """A number for each row, equal where all columns are."""
    code = np.zeros(len(rows), dtype=np.int64)
    for c in columns:
        own = rows[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return code


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Tables of some ``size`` rows, from batches in the order of ``key``; rows of one key stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < size:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield rows[:cut]
        held = rows[cut:].combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _counts(edges: DataFrame, place: DataFrame, runs: list[str], gold: DataFrame, alphas: list[int], least: float) -> DataFrame:
    """runs, k, n_gold, n_0, both_0, n_1, ...: edges of the gold graph, of each alpha's, and of both, in each chapter.

    A pair's observations and gold chapters meet in one task, which folds many pairs at a time and counts; only counts leave it.
    """
    pair = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    k = F.col("k").cast("bigint").alias("k")
    placed = lambda df: df.withColumn("book_id", F.col("book_id").cast("string")).join(F.broadcast(place), ["book_id", "chapter"])
    seen = placed(edges).select(*runs, *pair, k, (F.col("weight").cast("bigint") * TICKS).alias("weight"), F.when(F.col("a") <= F.col("b"), 0).otherwise(1).alias("side"))
    wanted = placed(gold).select(*runs, *pair, k, F.lit(0).cast("bigint").alias("weight"), F.lit(2).alias("side"))
    ends = place.groupBy(*runs).agg(F.max("k").cast("bigint").alias("last"))
    both = dealt(seen.unionByName(wanted).join(F.broadcast(ends), runs), *runs, "lo", "hi").sortWithinPartitions("h")  # last: a join would drop the order
    names = [x for i in range(len(alphas)) for x in (f"n_{i}", f"both_{i}")]
    kinds = {f.name: f.dataType.simpleString() for f in place.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in runs), *(f"{c} bigint" for c in ["k", "n_gold", *names])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, "h", AT_ONCE):
            pairs, group = _numbered(rows, [*runs, "lo", "hi"]), _numbered(rows, runs)
            at, weight, side, last = (rows[c].to_numpy() for c in ("k", "weight", "side", "last"))
            wide = int(max(at.max(initial=0), last.max(initial=0))) + 1
            order = np.lexsort((at, side, pairs))
            order = order[side[order] < 2]
            ids = pairs[order] * 2 + side[order]
            gold_at = np.unique(pairs[side == 2] * wide + at[side == 2])
            first = np.unique(group, return_index=True)[1]
            group_of = np.zeros(int(pairs.max(initial=0)) + 1, dtype=np.int64)
            group_of[pairs] = group
            count = lambda found: np.bincount(group_of[found // wide] * wide + found % wide, minlength=len(first) * wide)
            columns = {"n_gold": count(gold_at)}
            for i, alpha in enumerate(alphas):
                own, step = alive(ids, at[order], weight[order], last[order], alpha, round(least * TICKS))
                found = np.unique(own // 2 * wide + step)
                columns |= {f"n_{i}": count(found), f"both_{i}": count(found[np.isin(found, gold_at, assume_unique=True)])}
            used = np.flatnonzero(sum(columns.values()))
            keys = [rows[c].combine_chunks().take(pa.array(first[used // wide])) for c in runs]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(used % wide), *(pa.array(x[used]) for x in columns.values())], names=[*runs, "k", *columns])

    return both.mapInArrow(run, schema).groupBy(*runs, "k").agg(*[F.sum(c).alias(c) for c in ("n_gold", *names)])


def sweep(edges: DataFrame, chapters: DataFrame, gold: DataFrame, alphas: list[int] = ALPHAS, least: float = 0.5) -> DataFrame:
    """book_id, alpha, chapters, precision_e4, recall_e4, f1_e4: averages of the chapters' rounded metrics.

    Only chapters that have a gold graph count. ``gold``: book_id, chapter, a, b.
    """
    if not all(0 <= a <= 100 for a in alphas):
        raise ValueError("alpha must lie between 0 and 1")
    runs = ["book_id", "segment"] if "segment" in chapters.columns else ["book_id"]
    place = ordinals(chapters).withColumn("book_id", F.col("book_id").cast("string"))
    counts = _counts(edges, place, runs, gold, alphas, least).filter("n_gold > 0")
    grid = counts.select(*runs, "k", "n_gold", F.inline(F.array(*[F.struct(F.lit(x).alias("alpha"), F.col(f"n_{i}").alias("n_pred"), F.col(f"both_{i}").alias("both")) for i, x in enumerate(alphas)])))
    each = ratios(grid, [*runs, "k", "alpha"])
    total = each.groupBy("book_id", "alpha").agg(F.count("*").alias("chapters"), *[F.sum(c).alias(c) for c in ("precision_e4", "recall_e4", "f1_e4")])
    return total.select("book_id", "alpha", "chapters", *[round_div(F.col(c), F.col("chapters")).alias(c) for c in ("precision_e4", "recall_e4", "f1_e4")])


def best_alpha(results: DataFrame) -> DataFrame:
    """book_id, best_alpha, f1_e4: the first, so the smallest, of the best."""
    return results.groupBy("book_id").agg(F.max_by("alpha", F.struct("f1_e4", (-F.col("alpha")).alias("n"))).alias("best_alpha"), F.max("f1_e4").alias("f1_e4"))
