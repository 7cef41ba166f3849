"""Exact-substring dedup: bytes covered by a string of ``length`` bytes that an earlier document also has.

Suffixes are compared by their prefixes at growing lengths, and a suffix leaves as soon as its prefix is
unique to one document or is past the threshold:

1. length ``GRAM``. Positions are first thinned by a rule of content alone: of the
   ``length - GRAM + 1`` grams inside a window of ``length`` bytes the one of least
   hash (leftmost of equals) speaks for the window. Equal windows have the same
   speaker, so a speaker whose gram occurs in one document only speaks for windows that do too.
   About ``2 / (length - GRAM + 2)`` of all positions remain before the first exchange.
2. about twice that: the whole stretch of text that holds the windows of a
   speaker. Where an earlier document has the same stretch, all its windows are covered.
3. ``length``: the single windows of those stretches that are the earliest of their kind
   while the gram also stands in other stretches.

What prefix doubling calls a rank is here a name made of content (a hash of the prefix), so that the
rank of any other position is computed where it is needed and not fetched; the README says why.
Names have 64 bits in round 1, where a clash only keeps a position longer, and 96 bits after.

Each round aggregates where the text is before anything moves: of the rows of one name that a task holds
at a time, those that are settled among themselves go on under a name of their own (so they spread
evenly), and one row speaks for the name. A line that a third of all documents share is thus a few rows a
task, and no exchange gathers its positions.

Defined results: null text is no bytes; a text shorter than ``length`` keeps all; matches
never cross documents; rows with the same doc_id never remove from each other; a null doc_id
neither removes nor is removed from; an empty table gives no rows; extra columns, whatever their names,
take no part. Rows that repeat a doc_id with other texts are told apart by 32 bits of a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import discard, partitions, release, stored, table
from inkgraph.llm.shingles import mix

LENGTH, GRAM = 50, 26
#: Window starts that are worked on at a time in a long text.
PIECE = 1 << 18
#: Rows of a task that are aggregated at a time, before they are dealt out.
HELD = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(50))
_BYTES = [_RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) for _ in range(2)]
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_ZERO = np.zeros(1, dtype=np.int64)
_PLACES = np.arange(PIECE + 4 * LENGTH, dtype=np.uint64)
_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of hash k and of its inverse modulo 2**64."""
    if k not in _POWER or len(_POWER[k][0]) < n:
        out = []
        for base in (_BASE[k], pow(_BASE[k], -1, 1 << 64)):
            p = np.full(max(n, PIECE + 4 * LENGTH), base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWER[k] = (out[0], out[1])
    return _POWER[k]


class Hashed:
    """Hashes of any stretch of a piece of text in constant time."""

    def __init__(self, data: np.ndarray, which: tuple[int, ...] = (0, 1)):
        self.sums = {}
        for k in which:
            up, _ = _powers(k, len(data) + 1)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[k][data] * up[: len(data)], out=sums[1:])
            self.sums[k] = sums

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _powers(k, len(self.sums[k]))
        return mix((self.sums[k][end] - self.sums[k][start]) * down[start], 41 + k)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _ranked(x: np.ndarray) -> np.ndarray:
    """Cheap scrambling, enough to order grams by."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x &= np.uint64(0xFFFFFFFFFF000000)
    return x


def speakers(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, Hashed, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of the text: its offset, hashes, and for each speaker its place and its first and last window.

    Places are relative to the piece. Pieces overlap, so every window is in one of them.
    """
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(whole) - length + 1, PIECE):
        part = whole[at : at + PIECE + length - 1]
        hashed = Hashed(part, (0,))
        n = len(part) - gram + 1
        sums, (_, down) = hashed.sums[0], _powers(0, len(part) + 1)
        key = _ranked((sums[gram:] - sums[:-gram]) * down[:n])
        key |= _PLACES[:n]
        spoken = _sliding_least(key, length - gram + 1) & np.uint64((1 << 24) - 1)
        first = np.flatnonzero(spoken[1:] != spoken[:-1]) + 1
        first = np.concatenate([_ZERO, first])
        last = np.concatenate([first[1:], [len(spoken)]]) - 1
        yield at, hashed, spoken[first].astype(np.int64), first, last


def _short(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Columns:
    """Arrays by column, put together once for each batch."""

    def __init__(self, *names: str):
        self.held: dict[str, list[np.ndarray]] = {n: [] for n in names}
        self.size = 0

    def add(self, count: int, **arrays) -> None:
        for name, own in self.held.items():
            value = arrays[name]
            own.append(value if isinstance(value, np.ndarray) else np.full(count, value, dtype=np.int64))
        self.size += count

    def arrays(self) -> dict[str, np.ndarray]:
        out = {n: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for n, v in self.held.items()}
        self.__init__(*self.held)
        return out


def _groups(*names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal names are neighbours, and where each group begins in it."""
    order = np.lexsort(names[::-1]) if len(names) > 1 else np.argsort(names[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for x in names:
        own = x[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def _own_names(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A name for each row that no other has, as good as surely; it spreads settled rows over the tasks."""
    return mix(doc.astype(np.uint64) ^ mix(first.astype(np.uint64), 61), 62).view(np.int64)


#: A row that only tells that its name is shared, and no position.
TOLD = -1


def _shared_here(held: Columns) -> pd.DataFrame:
    """Round 1 rows of one task. Grams that two documents of it have are settled: their positions go on as -2 - first, and one row tells."""
    x = held.arrays()
    gram, doc, first = x["gram"], x["doc"], x["first"].astype(np.int32)
    order, start = _groups(gram)
    own = doc[order]
    several = np.minimum.reduceat(own, start) < np.maximum.reduceat(own, start)
    told = order[start[several]]
    settled = np.zeros(len(gram), dtype=bool)
    settled[order] = np.repeat(several, np.diff(np.append(start, len(order))))
    name = np.where(settled, _own_names(doc, first), gram)
    place = np.where(settled, -2 - first, first)
    return pd.DataFrame({"gram": np.concatenate([name, gram[told]]), "doc": np.concatenate([doc, doc[told]]), "first": np.concatenate([place, np.full(len(told), TOLD, dtype=np.int32)])})


def _covered_here(held: Columns) -> pd.DataFrame:
    """Rows of a later round of one task. Of equal names the least document speaks; rows of later documents are covered: they go on as -1 - first."""
    x = held.arrays()
    order, start = _groups(x["n1"], x["n2"])
    low = np.minimum.reduceat(x["doc"][order], start)
    covered = np.zeros(len(order), dtype=bool)
    covered[order] = np.repeat(low, np.diff(np.append(start, len(order)))) < x["doc"][order]
    x["n1"] = np.where(covered, _own_names(x["doc"], x["first"]), x["n1"])
    x["n2"] = np.where(covered, 0, x["n2"]).astype(np.int32)
    x["first"] = np.where(covered, -1 - x["first"], x["first"]).astype(np.int32)
    return pd.DataFrame(x)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), F.hash(body).alias("t"), F.encode(body, "utf-8").alias("data"))


def gram_ranks(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Round 1 input: doc, first window, name of the speaker's gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Columns("doc", "first", "gram")
        for pdf in batches:
            for doc, data in zip(pdf["doc"], pdf["data"], strict=True):
                for at, hashed, place, first, _ in speakers(data, length, gram):
                    held.add(len(first), doc=doc, first=first + at, gram=hashed.of(0, place, place + gram).view(np.int64))
                    if held.size > HELD:
                        yield _shared_here(held)
        if held.size:
            yield _shared_here(held)

    return rows.filter("doc is not null").select("doc", "data").mapInPandas(run, "gram long, doc long, first int")


def stretch_ranks(rows: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """Round 2 input: names of the stretch, part of the gram's name, doc, t, first window, how many more; for the places that are left."""
    listed = places.groupBy("doc").agg(F.collect_list("first").alias("firsts"))  # of one text: bounded by its length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Columns("n1", "n2", "gram", "doc", "t", "first", "more")
        for pdf in batches:
            for doc, t, data, firsts in zip(pdf["doc"], pdf["t"], pdf["data"], pdf["firsts"], strict=True):
                wanted = np.sort(firsts)
                for at, hashed, place, first, last in speakers(data, length, gram):
                    found = np.searchsorted(wanted, first + at)
                    own = np.flatnonzero(wanted[np.minimum(found, len(wanted) - 1)] == first + at)
                    if not len(own):
                        continue
                    place, first, last = place[own], first[own], last[own]
                    other = Hashed(np.frombuffer(data, dtype=np.uint8)[at : at + PIECE + length - 1], (1,))
                    shape = ((place - first) * 64 + last - first).astype(np.uint64)  # where the gram stands in it, and how long it is
                    held.add(len(own), n1=mix(hashed.of(0, first, last + length) ^ shape).view(np.int64), n2=_short(mix(other.of(1, first, last + length) ^ shape)), gram=_short(hashed.of(0, place, place + gram)), doc=doc, t=t, first=first + at, more=last - first)
                    if held.size > HELD:
                        yield _covered_here(held)
        if held.size:
            yield _covered_here(held)

    return rows.join(listed, "doc").select("doc", "t", "data", "firsts").mapInPandas(run, "n1 long, n2 int, gram int, doc long, t int, first int, more int")


def window_ranks(rows: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """Round 3 input: names of each single window of the stretches, doc, t, place."""
    listed = stretches.groupBy("doc", "t").agg(F.collect_list("first").alias("firsts"), F.collect_list("more").alias("mores"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Columns("n1", "n2", "doc", "t", "first")
        for pdf in batches:
            for doc, t, data, firsts, mores in zip(pdf["doc"], pdf["t"], pdf["data"], pdf["firsts"], pdf["mores"], strict=True):
                whole = np.frombuffer(data, dtype=np.uint8)
                firsts, count = firsts.astype(np.int64), mores.astype(np.int64) + 1
                starts = np.unique(np.repeat(firsts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                while len(starts):
                    at = int(starts[0])
                    cut = int(np.searchsorted(starts, at + PIECE))
                    own, starts = starts[:cut], starts[cut:]
                    hashed = Hashed(whole[at : int(own[-1]) + length])
                    held.add(len(own), n1=hashed.of(0, own - at, own - at + length).view(np.int64), n2=_short(hashed.of(1, own - at, own - at + length)), doc=doc, t=t, first=own)
                    if held.size > HELD:
                        yield _covered_here(held)
        if held.size:
            yield _covered_here(held)

    return rows.join(listed, ["doc", "t"]).select("doc", "t", "data", "firsts", "mores").mapInPandas(run, "n1 long, n2 int, doc long, t int, first int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, t (hash of the text), begins, ends: windows begins[i]..ends[i] of the text also start in an earlier document."""
    spark = docs.sparkSession
    rows = _rows(docs, key, text)

    left = _shared_grams(rows, length, gram)
    release(spark)  # of what a step has shuffled, once nothing names its frames any more
    two = stored(stretch_ranks(rows, left, length, gram))
    discard(left)
    release(spark)
    ranked = _by_stretch(two)
    discard(two)
    release(spark)
    settled = _merged(ranked.filter("settled").select("doc", "t", "first", (F.col("first") + F.col("more")).alias("last")))
    open_ = _unsettled(ranked)
    discard(ranked)
    release(spark)
    single = _by_window(rows, open_, length)
    discard(open_)
    release(spark)
    return settled.unionByName(single)


def _shared_grams(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Round 1: doc, first; speakers whose gram two documents have.

    One exchange serves both sides, as both need all of its columns.
    """
    one = gram_ranks(rows, length, gram).repartition(partitions(rows.sparkSession), "gram")
    several = one.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("first").alias("least")).filter("low < high or least < 0").select("gram", "low")
    place = F.when(F.col("first") < 0, -2 - F.col("first")).otherwise(F.col("first")).alias("first")
    position = (F.col("first") != TOLD) | F.col("low").isNull()  # names both sides, else it would go below one of them and make a second exchange
    return stored(one.join(several.hint("shuffle_hash"), "gram").filter(position).select("doc", place))


def _by_stretch(two: DataFrame) -> DataFrame:
    """Round 2: every stretch, whether an earlier document has it, and (where not yet known) the first document that has it. One exchange serves both sides."""
    dealt = two.repartition(partitions(two.sparkSession), "n1", "n2")
    least = dealt.groupBy("n1", "n2").agg(F.min("doc").alias("low"), F.max("gram").alias("g"), F.max("t").alias("any_t"), F.max("first").alias("any"), F.max("more").alias("end")).filter("g is not null and any_t is not null and any is not null and end >= 0").select("n1", "n2", "low")
    here = F.col("first") < 0
    return stored(dealt.join(least.hint("shuffle_hash"), ["n1", "n2"]).select("gram", "doc", "t", F.when(here, -1 - F.col("first")).otherwise(F.col("first")).alias("first"), F.col("more").cast("byte").alias("more"), (here | (F.col("low") < F.col("doc"))).alias("settled"), F.when(~here, F.col("low")).alias("low")))


def _unsettled(ranked: DataFrame) -> DataFrame:
    """The earliest stretches of their kind whose gram also stands in stretches of another kind and first document."""
    mixed = ranked.filter("low is not null").groupBy("gram").agg(F.min("low").alias("from"), F.max("low").alias("to")).filter("from < to").select("gram")
    return stored(ranked.filter("low = doc").join(mixed, "gram", "left_semi").select("doc", "t", "first", "more"))


def _by_window(rows: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """Round 3: single windows that an earlier document has, as runs."""
    three = window_ranks(rows, open_, length).repartition(partitions(rows.sparkSession), "n1", "n2")
    earliest = three.groupBy("n1", "n2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("first").alias("least"), F.max("t").alias("any_t")).filter("(low < high or least < 0) and any_t is not null").select("n1", "n2", "low")
    here = F.col("first") < 0
    place = F.when(here, -1 - F.col("first")).otherwise(F.col("first"))
    found = three.join(earliest.hint("shuffle_hash"), ["n1", "n2"]).filter(here | (F.col("low") < F.col("doc")))
    return _merged(found.select("doc", "t", place.alias("first"), place.alias("last")))


def _runs(firsts: np.ndarray, lasts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of intervals; those that lie at most ``gap`` apart are one."""
    order = np.argsort(firsts, kind="stable")
    begin, end = firsts[order], np.maximum.accumulate(lasts[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1] + gap]))
    return begin[new], end[np.concatenate([new[1:], [len(end)]]) - 1]


def _merged(windows: DataFrame) -> DataFrame:
    """doc, t, begins, ends: the windows first..last of each text as runs; of one text, so bounded by its length."""
    listed = windows.groupBy("doc", "t").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = [_runs(x, y, 1) for x, y in zip(pdf["firsts"], pdf["lasts"], strict=True)]
                yield pdf[["doc", "t"]].assign(begins=[x for x, _ in found], ends=[y for _, y in found])

    return stored(listed.mapInPandas(run, "doc long, t int, begins array<int>, ends array<int>"))


def remove_spans(docs: DataFrame, spans: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", kept_text: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept binary, for every row of ``docs``."""
    listed = spans.groupBy("doc", "t").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if kept_text else 5]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, data, begins, ends in zip(pdf["doc"], pdf["data"], pdf["begins"], pdf["ends"], strict=True):
                data = data or b""
                begin, end = _runs(begins, ends + length, 0) if begins is not None and len(begins) else (np.zeros(0, dtype=np.int64),) * 2
                kept = b"".join(data[i:j] for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            yield pd.DataFrame(out, columns=names).astype({"doc": "Int64"})

    joined = _rows(docs, key, text).join(listed, ["doc", "t"], "left").select("doc", "data", "begins", "ends")
    return joined.mapInPandas(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text).withColumnRenamed("doc", key)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return remove_spans(docs, repeated_spans(docs), kept_text=False)


ORACLE_OP1 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, o, least(o + 1024, windows) AS e, substr(h, CAST(2 * o + 1 AS BIGINT), 2146) AS h FROM (SELECT doc_id, h, length(h) // 2 - 49 AS windows, unnest(range(0, length(h) // 2 - 49, 1024)) AS o FROM b)),
w AS (SELECT doc_id, i, substr(h, CAST(2 * (i - o) + 1 AS BIGINT), 100) AS win FROM (SELECT doc_id, h, o, unnest(range(o, e)) AS i FROM blocks)),
m AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win),
c AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (win) WHERE low < doc_id),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
s AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM s),
k AS (SELECT doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (s - before) AS BIGINT)), '' ORDER BY s) AS head, max(e) AS e, count(*) AS n_spans FROM p JOIN b USING (doc_id) GROUP BY doc_id),
f AS (SELECT doc_id, h, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, CAST(2 * e + 1 AS BIGINT)) END AS kept FROM b LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(kept)) // 2 AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM f
"""
