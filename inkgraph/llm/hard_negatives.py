"""Hard negatives: for each anchor all scores are sorted, and each positive reads off the different-label rows just below it.

Components become whole numbers, so scores are whole numbers and every comparison is exact. Rows are packed in blocks; each block
meets each block of anchors. A meeting computes the scores of all its rows, sorts them by score and id for each anchor,
finds each positive's upper limit by binary search, and reads the first ``k`` rows of another label from there down to the lower
limit. The first ``k`` of all blocks are among the first ``k`` of each, so only those few leave a meeting, and
the last choice among them is a ranked window. Positives are found the same way, in a first pass over the same blocks.

Defined results: a row takes no part if its id, its label or its vector is null, if a component is null, not a number or infinite, or if it has another
dimension than most rows; empty vectors of that dimension score 0. A row with the anchor's own id is neither its positive nor its negative;
of rows that repeat an anchor's id, the one of least label and vector asks; other repeated rows count each.
An anchor without another row of its label, or a positive without a row between the limits, has no rows. Where the largest possible score passes 2^53,
whole numbers of any size are used; a score past 64 bits fails the run. Columns that are not asked for, whatever their names, take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.llm.common import partitions, stored, table

BLOCK, ANCHORS = 2048, 128
#: Tasks of the meetings for each shuffle partition.
FINER = 2
PACKED = "block long, ids binary, labels binary, codes binary"


def usable(vectors: DataFrame, key: Column, label: Column, vector: Column, scale: float = 256.0) -> DataFrame:
    """key, label, c (whole numbers as array<double>): the rows that take part."""
    rows = vectors.select(key.cast("long").alias("key"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    good = rows.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    whole = F.transform("v", lambda x: F.rint(x * scale - F.pmod(x * scale, F.lit(1.0))))  # both steps are exact: floor without a change of type
    return good.filter(F.size("v") == (common["d"] if common else 0)).select("key", "label", whole.alias("c"))


def packed(rows: DataFrame, size: int, extra: dict[str, str] | None = None) -> DataFrame:
    """A row for each ``size`` rows or fewer of a partition, in the order of their ids; ``extra``: array columns kept as they are, with their types."""
    extra = extra or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            part = pd.concat(held).sort_values("key", kind="stable")
            held.clear()
            ids = part["key"].to_numpy(np.int64)
            row = {"block": int(ids[0]), "ids": ids.tobytes(), "labels": part["label"].to_numpy(np.int64).tobytes(), "codes": np.stack(part["c"].to_numpy()).astype(np.float64).tobytes()}
            return pd.DataFrame([row | {c: [x.tolist() for x in part[c]] for c in extra}])

        for pdf in batches:
            while len(pdf):
                room = size - sum(map(len, held))
                held.append(pdf.iloc[:room])
                pdf = pdf.iloc[room:]
                if sum(map(len, held)) == size:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInPandas(run, PACKED + "".join(f", {c} array<{t}>" for c, t in extra.items()))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: in floating point while every sum fits, else in whole numbers of any size."""
    largest = lambda x: int(np.abs(x).max(initial=0))
    if max(1, a.shape[1]) * largest(a) * largest(b) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in r] for r in x], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


def meetings(blocks: DataFrame, asked: DataFrame, judge: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Every block of rows with every block of anchors. Blocks of rows stay where they are dealt; anchors, the smaller side, go everywhere.

    ``judge`` gets the anchors' block, the rows' ids and labels, and the scores (an anchor a line). Few bytes are much work here, so both
    sides are dealt to a stated number of tasks: by their bytes Spark would join them to one.
    """
    groups = FINER * partitions(blocks.sparkSession)
    dealt = blocks.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(groups))).drop("block").repartition(groups, "deal")
    names = [c for c in asked.columns if c != "block"]
    sent = asked.select(*[F.col(c).alias(f"a_{c}") for c in names], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("deal")).repartition(groups, "deal")
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, labels = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.labels, dtype=np.int64)
                own = {c: getattr(row, f"a_{c}") for c in names}
                own |= {c: np.frombuffer(own[c], dtype=np.int64) for c in ("ids", "labels")}
                shape = lambda data, n: np.frombuffer(data).reshape(n, -1) if data else np.zeros((n, 0))
                scores = products(shape(own["codes"], len(own["ids"])), shape(row.codes, len(ids)))
                yield pd.DataFrame(judge(own, ids, labels, scores), columns=columns)

    return dealt.join(sent.hint("shuffle_merge"), "deal").drop("deal").mapInPandas(run, schema)


def downwards(scores: np.ndarray) -> np.ndarray:
    """Each line's places in order of score, highest first; rows come in the order of their ids, and equals keep it."""
    bits = max(1, scores.shape[-1]).bit_length()
    if scores.dtype == object or np.abs(scores).max(initial=0) >= 1 << (62 - bits):
        return np.argsort(-scores, axis=-1, kind="stable")
    keys = (-scores << bits) | np.arange(scores.shape[-1])  # score and place in one number sort faster
    keys.sort(axis=-1)
    return keys & ((1 << bits) - 1)


def positives(blocks: DataFrame, anchors: DataFrame, n: int = 5) -> DataFrame:
    """anchor_id, positive_id, positive_score: the first ``n`` other rows of each anchor's label."""

    def judge(own: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        out = []
        for anchor, label, line, order in zip(own["ids"], own["labels"], scores, downwards(scores), strict=True):
            for i in order[(labels[order] == label) & (ids[order] != anchor)][:n]:
                out.append((anchor, ids[i], int(line[i])))
        return out

    found = meetings(blocks, packed(anchors, ANCHORS), judge, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n)


def negatives(blocks: DataFrame, anchors: DataFrame, found: DataFrame, k: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; limits in hundredths of the positive's score."""
    listed = found.groupBy(F.col("anchor_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("p"))  # a few for each anchor
    asked = anchors.join(listed, "key").select("key", "label", "c", F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))

    def judge(own: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        out = []
        for anchor, label, p_ids, p_scores, line, order in zip(own["ids"], own["labels"], own["p_ids"], own["p_scores"], scores, downwards(scores), strict=True):
            order = order[(labels[order] != label) & (ids[order] != anchor)]
            falling = -line[order]
            for p_id, p in zip(p_ids, map(int, p_scores), strict=True):
                start = int(np.searchsorted(falling, -(high * p // 100), side="left"))  # 100 s <= high p just where s <= floor(high p / 100)
                for i in order[start : start + k]:
                    if 100 * int(line[i]) < low * p:
                        break
                    out.append((anchor, p_id, ids[i], p, int(line[i])))
        return out

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    near = meetings(blocks, packed(asked, ANCHORS, {"p_ids": "array<long>", "p_scores": "array<long>"}), judge, schema)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, anchor: Column, key: Column, label: Column, vector: Column, n: int = 5, k: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` (over key, label, c) holds."""
    rows = stored(usable(vectors, key, label, vector))
    first = rows.filter(anchor).groupBy("key").agg(F.min(F.struct("label", "c")).alias("r")).select("key", "r.*")
    blocks = stored(packed(rows, BLOCK))
    found = stored(positives(blocks, first, n))
    return negatives(blocks, first, found, k, low, high)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0, F.col("vec_id"), label, F.col("embedding"))


ORACLE_OP12 = """
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id AS id, r.label, list_inner_product(a.c, r.c)::BIGINT AS score FROM good a JOIN good r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
