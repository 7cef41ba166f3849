"""N-gram Jaccard self-join: documents whose shingle sets overlap enough, as components.

Search is by T-occurrence: a query document's shingles name inverted lists of
candidates, and a candidate is a partner if it occurs in at least T of them. DivideSkip sets
the longest lists aside, merges the short ones with a heap, and probes the long ones by
binary search only for candidates that the merge left possible.

The lists of the whole corpus would be long beyond bound, so each query has lists over the
candidates that can still be its partners, found by an exact filter. Two sets of sizes a and b
with Jaccard at least t differ in at most H = (a + b)(1 - t)/(1 + t) shingles. Shingles are
dealt into 5/4 (H + 1) parts by hash; then some parts are the same in both sets, and one of them is not small. Each document
emits a hash of each of its larger parts, for its own band of sizes and the band below, and only documents that share such
a hash are candidates. A line, a passage or a word pair that is very common is but a piece
of a part, so it brings no candidates.

Documents that share a part hash are never paired with each other. Each meets one pivot of the
bucket; links found so are closed to components; only buckets whose members are
still in different components are looked at again, with pairs across components that pass
a parity sketch (a lower bound on the difference, so also exact). Components therefore lose no link.

Defined results: null text, or text without words, has an empty set and no links; texts of
fewer words than a shingle have one shingle; texts with equal sets are one class before any
search; rows that repeat a doc_id count as one document with the union of their
shingles' rows kept apart, and all get the smallest component of that doc_id; a row without a doc_id
has a set but no links, and a null component; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import durable, partitions, release, stored, table
from inkgraph.llm.components import components
from inkgraph.llm.shingles import mix, shingle_set

#: Least and most 64-bit words of the parity sketch; between them it has a cell for each shingle at least.
SKETCH = (8, 256)
#: Candidates, and bytes of their sets, that one search holds at a time.
CHUNK, CHUNK_BYTES = 256, 8 << 20
#: Values that a Python task gathers before it hands them on.
HELD = 1 << 18
#: DivideSkip's cost ratio between a step of the merge and a probe.
MU = 0.01


class Bands:
    """Bands of set sizes so that partners are in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        lo, hi = 0, len(self.low)
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.low[mid] <= n else (lo, mid)
        return lo

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of a band, and how many of them may differ between partners."""
        self.of(self.low[-1])
        while len(self.low) <= band + 1:
            self.of(self.low[-1])
        most = self.low[band + 1] - 1
        differ = (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        return -(-5 * (differ + 1) // 4), differ


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes a and b with Jaccard at least num/den."""
    return -(-num * (a + b) // (num + den))


def part_hashes(found: np.ndarray, bands: Bands) -> np.ndarray:
    """The hashes of the larger parts of a set, for its own band and the band below.

    Of P parts at least P - H are the same in two partners. A set leaves out its smallest parts, P - H - 1 of them
    at most: fewer than are the same, and a part that is the same has one size. So of the parts that are the same
    one at least is kept by both, and empty or tiny parts, which many sets share, are left out.
    """
    n = len(found)
    own = bands.of(n)
    out = []
    value = mix(found, 7)
    for band in (own, own - 1):
        if band < 0:
            continue
        parts, differ = bands.parts(band)
        part = (((mix(found, 11 + band) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]]))
        total = np.add.reduceat(value[order], first)
        size = np.diff(np.concatenate([first, [n]]))
        empty, skip = parts - len(first), parts - differ - 1
        least = 0 if skip < empty else np.partition(size, skip - empty)[skip - empty]
        kept = size >= least
        name = sorted_part[first[kept]].astype(np.uint64)
        out.append(mix(total[kept] ^ mix((np.uint64(band) << np.uint64(32)) + name, 3), 5))
        if skip < empty:  # so many empty parts that they have to speak too
            name = np.setdiff1d(np.arange(parts), sorted_part[first]).astype(np.uint64)
            out.append(mix(mix((np.uint64(band) << np.uint64(32)) + name, 3), 5))
    return np.concatenate(out).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each cell. The words are a power of two that grows with the set, so a short text has a short sketch.

    A cell is a hash modulo the number of cells: the xor of the two halves of a sketch is the sketch of half its length.
    """
    words = SKETCH[0]
    while words < SKETCH[1] and words * 64 < len(found):
        words *= 2
    cells = np.bincount(((mix(found, 23) >> np.uint64(32)) & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def divide_skip(query: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Numbers of the sets whose Jaccard with the query is at least num/den."""
    if not sets or not len(query):
        return []
    sizes = [len(s) for s in sets]
    need = [needed(len(query), n, num, den) for n in sizes]
    least = min(need)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    at = np.searchsorted(query, values)
    hit = query[np.minimum(at, len(query) - 1)] == values
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, dtype=np.int64)
    flat = owner.tolist()
    lists = sorted((flat[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), key=len)
    longest = len(lists[-1]) if lists else 0
    aside = min(least - 1, int(least / (MU * log2(max(2, longest)) + 1)), len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    counts: dict[int, int] = {}
    for c in heapq.merge(*short) if len(short) > 1 else (short[0] if short else []):
        counts[c] = counts.get(c, 0) + 1
    if least - aside <= 0:
        counts = {c: counts.get(c, 0) for c in range(len(sets))}
    out = []
    for c, n in counts.items():
        if n < need[c] - aside:
            continue
        left = len(long)
        for own in long:
            if n + left < need[c]:
                break
            left -= 1
            p = bisect_left(own, c)
            n += p < len(own) and own[p] == c
        if n >= need[c]:
            out.append(c)
    return sorted(out)


def features(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """key, n, two halves of the set's hash, sketch, and brief: the sketch at its least length."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "n", "h1", "h2", "sketch", "brief"]).astype({"key": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                if len(rows) * SKETCH[1] >= HELD:
                    yield frame(rows)
                    rows = []
                s = shingle_set(t, words)
                parity = sketch(s)
                rows.append((None if pd.isna(k) else int(k), len(s), int(mix(s, 31).sum().astype(np.int64)), int(mix(s, 37).sum().astype(np.int64)), parity, np.bitwise_xor.reduce(parity.reshape(-1, SKETCH[0]))))
            yield frame(rows)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, n long, h1 long, h2 long, sketch array<long>, brief array<long>")


def signatures(docs: DataFrame, words: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """key, sig: a row for each part hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(num, den)
        for pdf in batches:
            keys, sigs, held = [], [], 0
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                s = shingle_set(t, words)
                if len(s):
                    keys.append(k)
                    sigs.append(part_hashes(s, bands))
                    held += len(sigs[-1])
                if held >= HELD:
                    yield pd.DataFrame({"key": np.repeat(keys, [len(s) for s in sigs]), "sig": np.concatenate(sigs)})
                    keys, sigs, held = [], [], 0
            if keys:
                yield pd.DataFrame({"key": np.repeat(keys, [len(s) for s in sigs]), "sig": np.concatenate(sigs)})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null").mapInPandas(run, "key long, sig long")


def _bitmap(ids: DataFrame, bits: int = 23) -> bytes:
    """A fixed 1 MB filter of the ids: it lets all of them through, and fewer of the others the fewer ids there are."""
    cell = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    words = ids.select(cell.alias("cell")).select(F.expr("cell div 64 AS word"), F.expr("shiftleft(1L, cast(cell % 64 as int)) AS bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy()
    return out.tobytes()


def _sets(docs: DataFrame, ids: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """key, hashes binary: the sets of the documents in ``ids``. Texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(shared.value, dtype=np.int64)
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            pdf = pdf[(bits[cell >> 6] >> (cell & 63)) & 1 == 1]
            keys, sets, held = [], [], 0
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                keys.append(k)
                sets.append(shingle_set(t, words).tobytes())
                held += len(sets[-1]) // 8
                if held >= HELD:
                    yield pd.DataFrame({"key": keys, "hashes": sets})
                    keys, sets, held = [], [], 0
            if keys:
                yield pd.DataFrame({"key": keys, "hashes": sets})

    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null").withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(1 << 23)))
    return named.select("key", "text", "cell").mapInPandas(run, "key long, hashes binary")


def verify(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """Of the pairs (query, key), those that are links, by T-occurrence search of each query among its candidates.

    A query with many candidates is dealt over several tasks, CHUNK candidates to each on
    average; a task holds one chunk of sets at a time.
    """
    sets = _sets(docs, pairs.select("key").unionByName(pairs.select(F.col("query").alias("key"))).distinct(), words, key, text)
    deals = pairs.groupBy("query").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("deals"))
    dealt = pairs.join(deals, "query").withColumn("deal", F.pmod(F.xxhash64("key"), F.col("deals"))).select("query", "key", "deal")
    candidates = dealt.join(sets, "key").select("query", "deal", F.lit(1).alias("role"), "key", "hashes")
    asked = deals.select("query", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal")).join(sets.withColumnRenamed("key", "query"), "query").select("query", "deal", F.lit(0).alias("role"), F.col("query").alias("key"), "hashes")
    rows = asked.unionByName(candidates).repartition(partitions(docs.sparkSession), "query", "deal").sortWithinPartitions("query", "deal", "role", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, asked_set, keys, held, size = None, None, [], [], 0

        def flush() -> pd.DataFrame:
            found = divide_skip(asked_set, held, num, den)
            return pd.DataFrame({"query": [query] * len(found), "key": [keys[c] for c in found]}, dtype="int64")

        for pdf in batches:
            for q, role, k, raw in zip(pdf["query"], pdf["role"], pdf["key"], pdf["hashes"], strict=True):
                s = np.frombuffer(raw, dtype=np.uint64)
                if role == 0:
                    if keys:
                        yield flush()
                    query, asked_set, keys, held, size = q, s, [], [], 0
                    continue
                keys.append(k)
                held.append(s)
                size += len(raw)
                if len(keys) >= CHUNK or size >= CHUNK_BYTES:
                    yield flush()
                    keys, held, size = [], [], 0
        if keys:
            yield flush()

    return rows.mapInPandas(run, "query long, key long")


def _folded(held: Column, words: Column) -> Column:
    """A sketch at a smaller length: the xor of its pieces of so many words."""
    piece = lambda i: F.aggregate(F.sequence(F.lit(1), (F.size(held) / words).cast("int") - 1), F.get(held, i), lambda acc, j: acc.bitwiseXOR(F.get(held, i + j * words)))
    return F.when(F.size(held) == words, held).otherwise(F.transform(F.sequence(F.lit(0), words - 1), piece))


def _linkable(num: int, den: int) -> Column:
    """Whether sizes and sketches of query and key allow a link: cells that differ in parity are shingles that differ at least."""
    words = F.least(F.size("s_query"), F.size("s_key"))
    differ = F.aggregate(F.zip_with(_folded(F.col("s_query"), words), _folded(F.col("s_key"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    sized = F.least("n_query", "n_key") * den >= F.greatest("n_query", "n_key") * num
    return sized & (differ * (num + den) <= (F.col("n_query") + F.col("n_key")) * (den - num))


def _possible(pairs: DataFrame, feats: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (query, key) whose sizes and sketches allow a link; whole sketches move only for pairs that brief ones let through."""
    for name in ("brief", "sketch"):
        side = lambda s: feats.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col(name).alias(f"s_{s}"))  # noqa: B023, E731
        pairs = pairs.join(side("query"), "query").join(side("key"), "key").filter(_linkable(num, den)).select("query", "key")
    return pairs


def _buckets(docs: DataFrame, copies: DataFrame, words: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """sig, key: the part hashes that several documents have, copies under the key of their first. One exchange serves both sides."""
    dealt = signatures(docs, words, num, den, key, text).repartition(partitions(docs.sparkSession), "sig")
    shared = dealt.groupBy("sig").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("sig")
    return stored(dealt.join(shared, "sig").join(copies, "key", "left").select("sig", F.coalesce("first", "key").alias("key")).distinct())


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id: Jaccard of word shingles at least num/den links two documents."""
    every = stored(features(docs, words, key, text))
    feats = every.filter("key is not null")
    least = feats.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("key").alias("first"), F.count("*").alias("same"))
    members = stored(feats.select("key", "h1", "h2", "n").filter("n > 0").join(least.filter("same > 1"), ["h1", "h2", "n"]).select("key", "first").distinct())

    copies = members.groupBy("key").agg(F.min("first").alias("first"))
    buckets = _buckets(docs, copies, words, num, den, key, text)
    release(docs.sparkSession)

    pivots = buckets.groupBy("sig").agg(F.min("key").alias("query"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = buckets.join(pivots, "sig").filter("key <> query").select("query", "key").distinct()
    one = feats.groupBy("key").agg(F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief"))
    links = durable(verify(durable(_possible(firsts, one, num, den)), docs, words, num, den, key, text))
    release(docs.sparkSession)
    joined = links.select(F.col("query").alias("a"), F.col("key").alias("b"))
    labels = durable(components(joined))

    labelled = buckets.join(labels.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", F.coalesce("label", "key").alias("label"))
    open_ = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("sig")
    left = durable(labelled.join(open_, "sig").join(one.drop("sketch"), "key"))
    release(docs.sparkSession)
    if not left.isEmpty():
        side = lambda s: left.select("sig", F.col("key").alias(s), F.col("label").alias(f"l_{s}"), F.col("n").alias(f"n_{s}"), F.col("brief").alias(f"s_{s}"))
        across = side("query").join(side("key"), "sig").filter((F.col("query") < F.col("key")) & (F.col("l_query") != F.col("l_key")) & _linkable(num, den))
        again = durable(_possible(across.select("query", "key").distinct().join(firsts, ["query", "key"], "left_anti"), one, num, den))
        release(docs.sparkSession)
        if not again.isEmpty():
            more = durable(verify(again, docs, words, num, den, key, text))
            labels = durable(components(joined.unionByName(more.select(F.col("query").alias("a"), F.col("key").alias("b"))))) if not more.isEmpty() else labels

    named = feats.select("key", "n").join(copies, "key", "left").withColumn("node", F.coalesce("first", "key"))
    linked = named.join(labels, "node", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))
    return linked.unionByName(every.filter("key is null").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


ORACLE_OP9 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * pairs.n >= 90 * (p.n + q.n - pairs.n)),
near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id)
"""
