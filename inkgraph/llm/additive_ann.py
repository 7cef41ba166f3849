"""Approximate nearest neighbours by inner product, with additive quantisation.

A vector is stored as M codes; it is approximated by the sum of one full-dimensional
codeword from each of M codebooks. Codebooks start as residual k-means and are
refined jointly by least squares. Encoding is a beam search over the codebooks. The norms of the vector and
of its approximation are stored; a query scores all codes with a look-up table of its
products with every codeword, scaled by the stored norms. In each block of the index, the ``shortlist`` best by these scores
get their exact products in double precision; so does every other row of the block whose score, with the length of what its codes leave over
(stored too) times the length of the query, could still reach the ``k``-th best of them. No row among the nearest can be missed,
whatever the vectors; where codes approximate them badly, more rows are scored exactly.

Codebooks are fitted on a bounded sample (``sample`` vectors, those with the smallest hash of
the id); every vector is indexed. Queries meet the index in blocks: index blocks are dealt to
groups once, query blocks go to every group, and only a query's best scores and ids leave a pair of blocks. They meet by shuffle
whatever size Spark guesses: it counts a block of vectors as a hundred bytes, and a copy for every group as one.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have
another dimension than most, take no part; a null id takes no part; the query's own id is never found;
ties go to the smaller id; fewer candidates than ``k`` give as many rows; rows that
repeat an id are candidates each, and only the first of a repeated query id asks; an empty table gives no rows;
extra columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import partitions, stored, table

SAMPLE = 16_384
BLOCK, QUERY_BLOCK = 4096, 256
#: Most bytes of vectors in one block of the index.
BLOCK_BYTES = 4 << 20


@dataclass
class Codebooks:
    words: np.ndarray  # [M, K, d], float32

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes [n, M] by beam search over the residual."""
        books, size, _ = self.words.shape
        out = np.zeros((len(x), books), dtype=np.uint8)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024].astype(np.float32)
            n = len(part)
            rest, codes, loss = part[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8), (part**2).sum(1)[:, None]
            for m in range(books):
                words = self.words[m]
                each = loss[:, :, None] - 2 * (rest @ words.T) + (words**2).sum(1)
                flat = each.reshape(n, -1)
                width = min(beam, flat.shape[1])
                best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
                from_, code = best // size, best % size
                row = np.arange(n)[:, None]
                rest = rest[row, from_] - words[code]
                loss = flat[row, best]
                codes = np.concatenate([codes[row, from_], code[:, :, None].astype(np.uint8)], axis=2)
            out[at : at + n] = codes[np.arange(n), loss.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _sums(group: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the rows of each group."""
    out = np.zeros((groups, rows.shape[1]), dtype=rows.dtype)
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    out[sorted_group[first]] = np.add.reduceat(rows[order], first)
    return out


def fit(x: np.ndarray, books: int = 16, size: int = 256, rounds: int = 8, refine: int = 2, seed: int = 7) -> Codebooks:
    """Residual k-means, then ``refine`` times: encode by beam search, solve for all codebooks at once."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = x.astype(np.float32)
    d = x.shape[1]
    words = np.zeros((books, size, d), dtype=np.float32)
    rest = x.copy()
    for m in range(books):
        centres = rest[rng.choice(len(rest), size=size, replace=len(rest) < size)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
            count, total = np.bincount(near, minlength=size), _sums(near, rest, size)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
        words[m], rest = centres, rest - centres[near]
    model = Codebooks(words)
    for _ in range(refine if len(x) > books * size else 0):
        codes = model.encode(x).astype(np.int64) + np.arange(books) * size
        gram = np.zeros((books * size, books * size))
        target = np.zeros((books * size, d))
        for m in range(books):
            own = slice(m * size, (m + 1) * size)
            target[own] = _sums(codes[:, m] - m * size, x.astype(np.float64), size)
            for j in range(books):
                gram[own, j * size : (j + 1) * size] = np.bincount((codes[:, m] - m * size) * size + codes[:, j] - j * size, minlength=size * size).reshape(size, size)
        old = model.words.reshape(books * size, d).astype(np.float64)
        gram[np.diag_indices_from(gram)] += 1.0  # keeps codewords that few vectors use near where they were
        model = Codebooks(np.linalg.solve(gram, target + old).reshape(books, size, d).astype(np.float32))
    return model


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, v: the rows that take part."""
    kind = "float" if vectors.schema[column].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast(f"array<{kind}>").alias("v"))
    good = rows.filter(F.col("key").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.filter(F.size("v") == (common["d"] if common else 0))


def index_blocks(rows: DataFrame, model: Codebooks) -> DataFrame:
    """Every vector encoded; a row for each block: ids, vectors, codes, norm of the vector over that of its approximation, norm of what that leaves over."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    number = _number(rows)
    size = max(1, min(BLOCK, BLOCK_BYTES // (model.words.shape[2] * np.dtype(number).itemsize)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            ids, x = np.concatenate(keys), np.concatenate(held)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            codes = shared.value.encode(x)
            near = shared.value.decode(codes).astype(np.float64)
            scale = (np.linalg.norm(x.astype(np.float64), axis=1) / np.maximum(np.linalg.norm(near, axis=1), 1e-30)).astype(np.float32)
            left = np.linalg.norm(x - near * scale[:, None], axis=1)
            keys.clear()
            held.clear()
            return pd.DataFrame([{"block": int(ids[0]), "ids": ids.tobytes(), "x": x.tobytes(), "codes": codes.tobytes(), "scale": scale.tobytes(), "left": left.tobytes()}])

        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                keys.append(part["key"].to_numpy(dtype=np.int64))
                held.append(np.stack(part["v"].to_numpy()).astype(number))
                if sum(map(len, keys)) >= size:
                    yield flush()
        if keys:
            yield flush()

    return rows.mapInPandas(run, "block long, ids binary, x binary, codes binary, scale binary, left binary")


def query_blocks(rows: DataFrame) -> DataFrame:
    """A row for each QUERY_BLOCK queries, whatever the size of the batches they come in."""
    number = _number(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([{"q_ids": np.array(keys, dtype=np.int64).tobytes(), "q": np.stack(held).astype(number).tobytes()}])
            keys.clear()
            held.clear()
            return out

        for pdf in batches:
            for k, v in zip(pdf["key"], pdf["v"], strict=True):
                keys.append(k)
                held.append(v)
                if len(keys) == QUERY_BLOCK:
                    yield flush()
        if keys:
            yield flush()

    return rows.mapInPandas(run, "q_ids binary, q binary")


def _number(rows: DataFrame) -> str:
    """Vectors keep the width they came in; all products are in double precision."""
    return "f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "f8"


def best_of(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest in a row; of equals, the first."""
    if n >= len(scores):
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: n - len(above)]])


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with q, added up from the first component on, so equal rows score equal wherever they stand."""
    total = np.zeros(len(x))
    for j, y in enumerate(q):
        total += x[:, j] * y
    return total


def nearest_in(guess: np.ndarray, reach: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, room: float, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k nearest rows of a block.

    ``guess``: approximate scores, at most ``reach`` away from the exact ones; ``own``: rows that take no part; ``room``: for products added up in another order.
    """
    free = np.flatnonzero(~own)
    if not len(free):
        return ids[:0], np.zeros(0)
    near = free[best_of(np.nan_to_num(guess[free], nan=np.inf), shortlist)]
    kth = lambda scores: np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    more = free[~(guess[free] + reach[free] < kth(x[near] @ q) - room)]
    rough = x[more] @ q
    more = more[~(rough < kth(rough) - room)]
    scores = exact_products(x[more], q)
    best = np.lexsort((ids[more], -scores))[:k]
    return ids[more][best], scores[best]


def search(queries: DataFrame, index: DataFrame, model: Codebooks, number: str, k: int = 20, shortlist: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query by inner product; of equal scores, the smaller ids."""
    spark = queries.sparkSession
    groups = partitions(spark)
    shared = spark.sparkContext.broadcast(model)
    dealt = index.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = query_blocks(queries).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = dealt.join(asked.hint("merge"), "deal").select("ids", "x", "codes", "scale", "left", "q_ids", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value.words
        books, size, d = words.shape
        longest = float(np.linalg.norm(words.astype(np.float64), axis=2).max(axis=1).sum())
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, q_ids = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.q_ids, dtype=np.int64)
                x = np.frombuffer(row.x, dtype=number).reshape(len(ids), d).astype(np.float64)
                codes = np.frombuffer(row.codes, dtype=np.uint8).reshape(len(ids), books).T.astype(np.intp)
                scale, left = np.frombuffer(row.scale, dtype=np.float32), np.frombuffer(row.left)
                off = left + (d + books + 4) * 2.0**-23 * longest * scale  # with the rounding of the look-up tables
                q = np.frombuffer(row.q, dtype=number).reshape(len(q_ids), d).astype(np.float64)
                tables = (q.astype(np.float32) @ words.reshape(books * size, d).T).reshape(len(q), books, size)
                room = 1e-13 * d * np.abs(q).max(axis=1) * max(np.abs(x).max(), 1e-300)
                out = []
                for i, own in enumerate(q_ids):
                    guess = tables[i, 0].take(codes[0])
                    for m in range(1, books):
                        guess += tables[i, m].take(codes[m])
                    guess *= scale
                    found, scores = nearest_in(guess, off * np.linalg.norm(q[i]), ids == own, ids, x, q[i], room[i], k, shortlist)
                    out.append((own, found.tobytes(), scores.tobytes()))
                yield pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, scores = None, np.zeros(0, dtype=np.int64), np.zeros(0)
        ranked = lambda: pd.DataFrame({"query_id": now, "rank": np.arange(1, len(ids) + 1), "vec_id": ids, "score": scores})
        for pdf in batches:
            for own, more, given in zip(pdf["query_id"], pdf["ids"], pdf["scores"], strict=True):
                if own != now:
                    if now is not None:
                        yield ranked()
                    now, ids, scores = own, ids[:0], scores[:0]
                ids, scores = np.concatenate([ids, np.frombuffer(more, dtype=np.int64)]), np.concatenate([scores, np.frombuffer(given)])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
        if now is not None:
            yield ranked()

    found = pairs.mapInPandas(run, "query_id long, ids binary, scores binary")
    return found.repartition(groups, "query_id").sortWithinPartitions("query_id").mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


def sample_rows(rows: DataFrame, n: int = SAMPLE) -> np.ndarray:
    """At most n vectors, those with the smallest hash of the id. The tasks' lists are merged in a task, so the driver gets the n rows only."""
    number = _number(rows)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame([{"n": len(pdf), "x": np.stack(pdf["v"].to_numpy()).astype(number).tobytes()}])

    found = rows.orderBy(F.xxhash64("key"), "key").limit(n).select("v").mapInPandas(packed, "n long, x binary").collect()
    return np.concatenate([np.frombuffer(r.x, dtype=number).reshape(r.n, -1) for r in found]) if found else np.zeros((0, 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shortlist: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows whose id is divisible by ``every`` ask; all rows are candidates."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, column)
    x = sample_rows(rows)
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = fit(x)
    index = stored(index_blocks(rows, model))
    return search(rows.filter(F.col("key") % every == 0).dropDuplicates(["key"]), index, model, _number(rows), k, shortlist)


def op2_additive_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
