"""Document fingerprints by randomised edit embedding.

Every text takes one shared random walk over its characters: at step j, standing
on character c, the walk writes c and moves on if the shared random bit for (j, c) is 1.
Two texts that differ by few edits fall back into step soon after each edit, so their
walks differ in few places (Hamming distance) where the texts differ by few edits.

How far two walks stay out of step after an edit has a heavy tail, so a text takes `WALKS`
walks of independent bits, and the best of them counts.

A fingerprint folds the whole of each walk: every `BLOCK` steps become one hexadecimal digit, four
bits of a hash of the characters written there. No step is left out and all weigh the same,
so a text of n characters has about ``2 * n / BLOCK`` digits a walk; walks are parted by a hyphen.
Many texts are walked side by side, each taking its next character at once.
Walks that differ in one block only keep an equal digit there, by chance, once in 16 times.

`likeness` is the share of digits, of the longer walk, on which two fingerprints
agree, corrected for agreement by chance, on the walk where it is largest. `near_pairs` groups
fingerprints by bands of sampled digits and verifies each candidate.

Defined results: null text is the empty text; an empty text has the empty
fingerprint, like only to other empty ones (likeness 1, else 0); equal texts have
equal fingerprints; one document alone is its own next; rows that repeat a doc_id are
ordered by text; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import discard, durable, partitions, release, stored, table
from inkgraph.llm.components import components
from inkgraph.llm.ngram_join import _bitmap

#: The random bits repeat after so many steps; a power of two.
PERIOD = 4096
#: Walk steps that are folded into one digit.
BLOCK = 8
WALKS = 2
#: Characters are told apart by one byte of a hash.
KINDS = 256
SEED = 20_240_101
PIECE = 1 << 15
#: Code points of the texts whose walks are taken side by side; longer texts are walked by themselves, piece by piece.
TOGETHER = 1 << 22
#: With fewer texts than this left, each goes on by itself.
FEW = 24
#: Lengths over which walks are banded grow by this factor.
STEP = 1.25
#: Share of pairs right at the threshold that may have no band in common; the number of bands follows from it.
MISSED = 0.01
#: Fingerprints that are compared with as many others at a time.
CHUNK = 256


def _walk_table(number: int) -> np.ndarray:
    """[kind, step mod PERIOD] -> step mod PERIOD at which walk ``number`` has moved on from that character."""
    bits = np.random.Generator(np.random.PCG64([SEED, number] if number else SEED)).integers(0, 2, size=(KINDS, PERIOD), dtype=np.int8)
    then = np.zeros((KINDS, PERIOD), dtype=np.int32)
    ahead = np.full(KINDS, PERIOD, dtype=np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):  # twice round, so that the far end knows the start
        ahead = np.where(bits[:, j % PERIOD] == 1, 1, ahead + 1)
        then[:, j % PERIOD] = (j + ahead) % PERIOD
    return then


_STATE: dict[str, object] = {}


def _tables() -> tuple[np.ndarray, list[list[list[int]]]]:
    """The tables of all walks end to end, an entry being the place of its step in the own table; and each as lists."""
    if not _STATE:
        steps = list(range(PERIOD))  # one object for each step keeps the lists in the cache
        tables = [_walk_table(number) for number in range(WALKS)]
        _STATE["all"] = np.concatenate([t.ravel() + number * KINDS * PERIOD for number, t in enumerate(tables)]).astype(np.int32)
        _STATE["lists"] = [[[steps[x] for x in row] for row in t.tolist()] for t in tables]
    return _STATE["all"], _STATE["lists"]


def kinds_of(text: str) -> bytes:
    """One byte for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
_WEIGHTS = np.random.Generator(np.random.PCG64([SEED, WALKS, BLOCK])).integers(0, 1 << 31, size=BLOCK, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def folded(written: np.ndarray) -> np.ndarray:
    """One digit for each BLOCK of written kinds (from 1, 0 for an absent step); their number is a multiple of BLOCK."""
    h = np.zeros(len(written) // BLOCK, dtype=np.uint32)
    for i, weight in enumerate(_WEIGHTS):
        h += written[i::BLOCK].astype(np.uint32) * weight
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return _DIGITS[h >> np.uint32(28)]


def _padded(written: np.ndarray) -> np.ndarray:
    return np.concatenate([written, np.zeros(-len(written) % BLOCK, dtype=written.dtype)])


def _steps(ends: np.ndarray, begin: int) -> np.ndarray:
    """How many steps the walk stays on each character."""
    return ((np.diff(ends.astype(np.int32), prepend=begin) - 1) & (PERIOD - 1)) + 1


class Walk:
    """The walks of one text, which can be copied, and continued with more text; piece by piece."""

    def __init__(self) -> None:
        self.steps = [0] * WALKS  # mod PERIOD
        self.digits: list[list[np.ndarray]] = [[] for _ in range(WALKS)]
        self.rest = [np.zeros(0, dtype=np.uint16)] * WALKS  # written, but not a block yet

    def copy(self) -> Walk:
        other = Walk()
        other.steps, other.digits, other.rest = list(self.steps), [list(x) for x in self.digits], list(self.rest)
        return other

    def take(self, kinds: bytes) -> Walk:
        for number, table in enumerate(_tables()[1]):
            for at in range(0, len(kinds), PIECE):
                part, begin = kinds[at : at + PIECE], self.steps[number]
                j = begin
                ends = np.array([j := row[j] for row in map(table.__getitem__, part)], dtype=np.int32)
                own = np.frombuffer(part, dtype=np.uint8).astype(np.uint16) + np.uint16(1)
                written = np.concatenate([self.rest[number], np.repeat(own, _steps(ends, begin))])
                whole = len(written) // BLOCK * BLOCK
                self.digits[number].append(folded(written[:whole]))
                self.rest[number] = written[whole:]
                self.steps[number] = j
        return self

    def fingerprint(self) -> str:
        if not any(len(rest) or digits for rest, digits in zip(self.rest, self.digits, strict=True)):
            return ""
        return b"-".join(np.concatenate([*digits, folded(_padded(rest))]).tobytes() for digits, rest in zip(self.digits, self.rest, strict=True)).decode()


def _side_by_side(kinds: np.ndarray, start: np.ndarray, length: np.ndarray, begin: list[np.ndarray]) -> list[np.ndarray]:
    """By walk, the step mod PERIOD after each character of many texts that lie in ``kinds``; all texts and walks take their i-th character at once."""
    table, lists = _tables()
    size = len(kinds)
    ends = np.zeros(WALKS * size, dtype=np.int16)
    row = kinds.astype(np.int32) * PERIOD
    every = np.tile(length, WALKS)
    order = np.argsort(-every, kind="stable")
    at, left = np.tile(start, WALKS)[order], every[order]
    number = np.repeat(np.arange(WALKS), len(start))[order]
    to = at + number * size
    j = (np.concatenate(begin)[order] + number * KINDS * PERIOD).astype(np.int32)
    i, n = 0, int((left > 0).sum())
    while n >= FEW:
        j[:n] = table.take(row.take(at[:n]) + j[:n])
        ends[to[:n]] = j[:n] & (PERIOD - 1)
        at[:n] += 1
        to[:n] += 1
        i += 1
        while n and left[n - 1] <= i:
            n -= 1
    for k in range(n):
        step, first, out, rest = int(j[k]) % PERIOD, int(at[k]), int(to[k]), int(left[k]) - i
        part = kinds[first : first + rest].tobytes()
        ends[out : out + rest] = [step := own[step] for own in map(lists[number[k]].__getitem__, part)]
    return [ends[w * size : (w + 1) * size] for w in range(WALKS)]


def _written(kinds: np.ndarray, start: np.ndarray, length: np.ndarray, begin: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """For each walk: of each text, what it writes, and the step after each character."""
    some = length > 0
    for ends, own in zip(_side_by_side(kinds, start, length, begin), begin, strict=True):
        before = np.empty_like(ends)
        before[1:] = ends[:-1]
        before[start[some]] = own[some]
        stay = ((ends - before - np.int16(1)) & np.int16(PERIOD - 1)) + np.int16(1)
        written = np.repeat(kinds.astype(np.uint16) + np.uint16(1), stay)
        total = np.zeros(len(stay) + 1, dtype=np.int32)  # TOGETHER characters stay some 2 * TOGETHER steps
        np.cumsum(stay, out=total[1:], dtype=np.int32)
        yield [written[total[a] : total[a + n]] for a, n in zip(start.tolist(), length.tolist(), strict=True)], [ends[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]


def _spell(parts: list[list[np.ndarray]]) -> list[bytes]:
    """Digits of each text from what its walk wrote, folded for all texts at once."""
    pieces, count = [], []
    for own in parts:
        n = sum(map(len, own))
        pieces += [*own, np.zeros(-n % BLOCK, dtype=np.uint16)]
        count.append(-(-n // BLOCK))
    digits = folded(np.concatenate(pieces)).tobytes() if pieces else b""
    out, at = [], 0
    for n in count:
        out.append(digits[at : at + n])
        at += n
    return out


def _named(walks: list[list[bytes]]) -> list[str]:
    """Fingerprints from the digits of each walk."""
    return [b"-".join(own).decode() if any(own) else "" for own in zip(*walks, strict=True)]


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(kinds_of("".join(texts)), dtype=np.uint8), np.cumsum(length) - length, length


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of many texts, walked side by side; the same as of each by itself."""
    kinds, start, length = _flat(texts)
    zero = [np.zeros(len(texts), dtype=np.int32)] * WALKS
    return _named([_spell([[w] for w in written]) for written, _ in _written(kinds, start, length, zero)])


def fingerprints_and_edited(texts: list[str], followings: list[str]) -> tuple[list[str], list[str]]:
    """Fingerprints of texts, and of each with its last quarter replaced from the one that follows: the walk goes on from where the two part."""
    kinds, start, length = _flat(texts)
    stay = (length - length // 4).tolist()
    zero = [np.zeros(len(texts), dtype=np.int32)] * WALKS
    own, heads, begin = [], [], []
    for written, ends in _written(kinds, start, length, zero):
        own.append(_spell([[w] for w in written]))
        begin.append(np.array([e[k - 1] if k else 0 for e, k in zip(ends, stay, strict=True)], dtype=np.int32))
        heads.append([w[: int(_steps(e[:k], 0).sum())] for w, e, k in zip(written, ends, stay, strict=True)])
    tails = _flat([f[: n - k] for f, n, k in zip(followings, length.tolist(), stay, strict=True)])
    other = [_spell([[h, m] for h, m in zip(head, more, strict=True)]) for head, (more, _) in zip(heads, _written(*tails, begin), strict=True)]
    return _named(own), _named(other)


def fingerprint(text: str | None) -> str:
    return Walk().take(kinds_of(text or "")).fingerprint()


def _shares(sizes: list[int]) -> Iterator[slice]:
    """Neighbours whose sizes add up to TOGETHER at most, or one that is larger."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > TOGETHER:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def all_fingerprints(texts: list[str]) -> list[str]:
    out = []
    for own in _shares([len(t) for t in texts]):
        out += fingerprints(texts[own]) if sum(map(len, texts[own])) <= TOGETHER else [fingerprint(t) for t in texts[own]]
    return out


def all_edited(texts: list[str], followings: list[str]) -> tuple[list[str], list[str]]:
    prints, others = [], []
    for own in _shares([len(t) for t in texts]):
        if sum(map(len, texts[own])) <= TOGETHER:
            x, y = fingerprints_and_edited(texts[own], followings[own])
        else:
            x, y = [], []
            for t, f in zip(texts[own], followings[own], strict=True):
                stay = len(t) - len(t) // 4
                begun = Walk().take(kinds_of(t[:stay]))
                x.append(begun.copy().take(kinds_of(t[stay:])).fingerprint())
                y.append(begun.take(kinds_of(f[: len(t) - stay])).fingerprint())
        prints += x
        others += y
    return prints, others


def likeness(a: str, b: str) -> float:
    """From 0 to 1: agreement over the longer walk, less what chance gives; of the walks that agree most."""
    if not a or not b:
        return float(a == b)
    best = 0.0
    for x, y in zip(a.encode().split(b"-"), b.encode().split(b"-"), strict=True):
        n, m = max(len(x), len(y)), min(len(x), len(y))
        same = int((np.frombuffer(x[:m], dtype=np.uint8) == np.frombuffer(y[:m], dtype=np.uint8)).sum())
        best = max(best, (same / n - 1 / 16) / (15 / 16))
    return best


def edited(text: str, following: str) -> tuple[str, int]:
    """``text`` with its last quarter replaced from ``following``; and how many code points stay."""
    quarter = len(text) // 4
    stay = len(text) - quarter
    return text[:stay] + following[:quarter], stay


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", near: DataFrame | None = None) -> DataFrame:
    """Rows (section, key, text, mark, near_id) so that sorting a section by (mark, key, text) gives every document and then its next.

    Keys are cut into sections at quantiles, far more than there are partitions. The first
    row of each section is repeated, marked 1, at the end of the section before it (that
    of the first section at the end of the last), so no order over all rows is needed and
    each text moves once. Rows (key, near_id) of ``near`` come without a text, before the documents of that key.
    """
    spark = docs.sparkSession
    count = 4 * partitions(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / count for i in range(1, count)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    section = F.lit(0) if not cuts else F.when(F.col("key").isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("key"))))
    rows = rows.withColumn("section", section)
    heads = rows.groupBy("section").agg(F.min(F.struct(F.col("key").isNotNull().alias("k"), "key")).alias("head"))
    firsts = sorted((r["section"], r["head"]["key"]) for r in heads.collect())  # a row for each section
    if not firsts:
        return rows.withColumn("mark", F.lit(0)).withColumn("near_id", F.lit(None).cast("string"))
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    keys = [k for _, k in firsts if k is not None]
    head_rows = rows.filter(F.col("key").isin(keys) | (F.col("key").isNull() if len(keys) < len(firsts) else F.lit(False)))
    least = head_rows.groupBy("section", "key").agg(F.min("text").alias("text"))
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    marked = least.select("key", "text", to[F.col("section")].alias("section"), F.lit(1).alias("mark"))
    out = rows.withColumn("mark", F.lit(0)).unionByName(marked).withColumn("near_id", F.lit(None).cast("string"))
    return out if near is None else out.unionByName(near.select(section.alias("section"), "key", F.lit(None).cast("string").alias("text"), F.lit(0).alias("mark"), F.col("near_id").cast("string").alias("near_id")))


def edit_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", near: DataFrame | None = None) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; with ``near`` (key, near_id) also near_id, which is the key where it has none."""
    spark = docs.sparkSession
    rows = with_next(docs, key, text, near)
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # (section, key, text, mark, near_id) of documents in order
        size = 0
        labelled = (None, None)  # (key, near_id) of the last row without a text

        def flush() -> pd.DataFrame:
            """All documents held but the last, which waits for its next."""
            texts = [r[2] for r in held]
            prints, others = all_edited(texts[:-1], texts[1:])
            prints += all_fingerprints(texts[-1:])
            out = []
            for i, (section, k, t, mark, near_id) in enumerate(held[:-1]):
                if not mark and held[i + 1][0] == section:
                    changed, _ = edited(t, texts[i + 1])
                    out.append((k, len(t), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), prints[i], others[i], likeness(prints[i], others[i]), likeness(prints[i], prints[i + 1]), near_id))
            del held[:-1]
            return pd.DataFrame(out, columns=names).astype({"key": "Int64", "near_id": "Int64"})

        for pdf in batches:
            for section, k, t, mark, label in zip(pdf["section"], pdf["key"], pdf["text"], pdf["mark"], pdf["near_id"], strict=True):
                if t is None:
                    labelled = (k, int(label))
                    continue
                held.append((section, k, t, mark, labelled[1] if labelled[0] == k else k))
                size += len(t)
                if size > TOGETHER:
                    yield flush()
                    size = len(held[0][2])
        if len(held) > 1:
            yield flush()

    dealt = rows.repartition(partitions(spark), "section").sortWithinPartitions("section", "mark", "key", "text")
    return dealt.mapInPandas(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long").withColumnRenamed("key", key).drop(*([] if near is not None else ["near_id"]))


_VALUE = np.array([int(chr(i), 16) if chr(i) in "0123456789abcdef" else 0 for i in range(256)], dtype=np.int64)


def blocks_of(text: str) -> list[bytes]:
    """The digits of each walk of a fingerprint."""
    return text.encode().split(b"-") if text else []


#: Shared lengths over which walks are banded.
BASES = [1]
while BASES[-1] < 1 << 40:
    BASES.append(max(BASES[-1] + 1, int(BASES[-1] * STEP)))


@functools.lru_cache(maxsize=4096)
def places(base: int, number: int, bands: int, digits: int) -> np.ndarray:
    """[band, digit] -> place, for the bands of walk ``number``, spread over the first ``base`` digits; one band of all of them where there are no more than ``digits``."""
    if base <= digits:
        return np.arange(base)[None, :]
    return np.array([np.random.Generator(np.random.PCG64([SEED, base, band])).choice(base, size=digits, replace=False) for band in range(number, bands, WALKS)])


def band_names(text: str, ratio: float, bands: int, digits: int) -> np.ndarray:
    """A number for each band of a fingerprint: shared length, band and digits.

    A walk is banded over several shared lengths, so that two walks, the shorter at least ``ratio`` of the longer, have one in common.
    """
    out = []
    for number, walk in enumerate(blocks_of(text)):
        row = _VALUE[np.frombuffer(walk, dtype=np.uint8)]
        for i in range(bisect_right(BASES, ratio * len(walk) / STEP), bisect_right(BASES, len(walk))):
            found = row[places(BASES[i], number, bands, digits)]
            band = np.arange(len(found)) * WALKS + number
            out.append((((i * (bands + WALKS) + band) << (4 * digits)) + (found << (4 * np.arange(found.shape[1]))).sum(axis=1)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def packed(text: str) -> bytes:
    """A fingerprint at two digits a byte, each walk after its number of digits."""
    walks = blocks_of(text)
    return b"".join(len(w).to_bytes(8, "big") + bytes.fromhex((w + b"0" * (len(w) % 2)).decode()) for w in walks)


def unpacked(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "big")
        size = (n + 1) // 2
        out.append(data[at + 8 : at + 8 + size].hex()[:n])
        at += 8 + size
    return "-".join(out)


def _packs(rows: DataFrame, of: Callable[[list[str]], list[str]]) -> DataFrame:
    """Rows (key, text) as a table (key, same, print): equal fingerprints have equal ``same``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            keys = pdf["key"].to_numpy()
            for own in _shares([len(t) for t in texts]):
                prints = of(texts[own])
                yield pd.DataFrame({"key": keys[own], "same": [hashlib.md5(x.encode()).digest() for x in prints], "print": [packed(x) for x in prints]})

    return stored(rows.filter("key is not null").mapInPandas(run, "key long, same binary, print binary"))


def _prints_of(keys: DataFrame, packs: DataFrame) -> DataFrame:
    """key, print of the keys (and few others): only these are moved by the join that follows."""
    shared = packs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(shared.value, dtype=np.int64)
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            pdf = pdf[(bits[cell >> 6] >> (cell & 63)) & 1 == 1]
            if len(pdf):
                yield pdf[["key", "print"]]

    return packs.select("key", "print", F.pmod(F.xxhash64("key"), F.lit(1 << 23)).alias("cell")).mapInPandas(asked, "key long, print binary")


def _verified(pairs: DataFrame, packs: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (class_key, key), those at least ``threshold`` alike, with their likeness. Only fingerprints of the pairs move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            like = np.array([likeness(unpacked(x), unpacked(y)) for x, y in zip(pdf["print"], pdf["class_print"], strict=True)], dtype=np.float64)
            yield pdf[["class_key", "key"]].assign(likeness=like)[like >= threshold]

    prints = _prints_of(pairs.select("key").unionByName(pairs.select(F.col("class_key").alias("key"))).distinct(), packs)
    named = prints.select(F.col("key").alias("class_key"), F.col("print").alias("class_print"))
    return pairs.join(prints, "key").join(named, "class_key").mapInPandas(run, "class_key long, key long, likeness double").groupBy("class_key", "key").agg(F.max("likeness").alias("likeness"))


def _alike(x: list[np.ndarray], y: list[list[np.ndarray]], threshold: float) -> np.ndarray:
    """Likeness of one fingerprint (digits by walk) to each of many."""
    best = np.zeros(len(y))
    for number, own in enumerate(x):
        for i, other in enumerate(y):
            n, m = max(len(own), len(other[number])), min(len(own), len(other[number]))
            if m < threshold * n:
                continue
            best[i] = max(best[i], (int((own[:m] == other[number][:m]).sum()) / n - 1 / 16) / (15 / 16))
    return best


def _across(left: DataFrame, packs: DataFrame, threshold: float) -> DataFrame:
    """Links between components inside bands that are still split.

    ``left``: band, key, label. The members of a band are dealt into chunks of about CHUNK, and chunks meet
    chunks: a row for each pair of chunks, never one for each pair of documents. All pairs of a chunk pair whose labels differ are compared.
    """
    spark = packs.sparkSession
    sizes = left.groupBy("band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("deals"))
    prints = _prints_of(left.select("key").distinct(), packs).dropDuplicates(["key"])
    dealt = left.join(sizes, "band").withColumn("deal", F.pmod(F.xxhash64("key"), F.col("deals")).cast("int"))
    chunks = stored(dealt.join(prints, "key").groupBy("band", "deal").agg(F.collect_list(F.struct("key", "label", "print")).alias("members")))
    first, second = chunks.select("band", "deal", "members"), chunks.select("band", F.col("deal").alias("deal2"), F.col("members").alias("members2"))
    met = first.join(second, "band").filter("deal <= deal2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digits = lambda data: [np.frombuffer(w, dtype=np.uint8) for w in blocks_of(unpacked(data))]
        for pdf in batches:
            for members, members2 in zip(pdf["members"], pdf["members2"], strict=True):
                other = [(m["key"], m["label"], digits(m["print"])) for m in members2]
                found = []
                for m in members:
                    own = digits(m["print"])
                    against = [o for o in other if o[1] != m["label"] and o[0] != m["key"]]
                    if own and against:
                        like = _alike(own, [o[2] for o in against], threshold)
                        found += [(min(m["key"], o[0]), max(m["key"], o[0]), x) for o, x in zip(against, like.tolist(), strict=True) if x >= threshold]
                yield pd.DataFrame(found, columns=["class_key", "key", "likeness"]).astype({"class_key": "int64", "key": "int64", "likeness": "float64"})

    links = durable(met.select("members", "members2").repartition(partitions(spark)).mapInPandas(run, "class_key long, key long, likeness double").groupBy("class_key", "key").agg(F.max("likeness").alias("likeness")))
    discard(chunks)
    return links


def _near(packs: DataFrame, threshold: float, bands: int | None, digits: int) -> tuple[DataFrame, DataFrame]:
    """Links (class_key, key, likeness), class_key < key, and their components (node, label).

    Of equal fingerprints the least key stands for all. A band is not paired within itself:
    each row meets the least key of the band, links close to components, and only
    bands still split are looked at again, chunk by chunk, across components.
    """
    spark = packs.sparkSession
    ratio = threshold * 15 / 16 + 1 / 16  # of lengths; with less, walks cannot be near enough
    bands = math.ceil(math.log(MISSED) / math.log1p(-(ratio**digits))) if bands is None else bands
    first = packs.groupBy("same").agg(F.min("key").alias("class_key"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = durable(packs.select("key", "same").join(first, "same").filter("key <> class_key").select("class_key", "key").distinct())

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = [band_names(unpacked(x), ratio, bands, digits) for x in pdf["print"]]
                yield pd.DataFrame({"key": np.repeat(pdf["key"].to_numpy(), [len(x) for x in found]), "band": np.concatenate(found)})

    banded = packs.select("key", "print").mapInPandas(names, "key long, band long")
    shared = banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("band")
    buckets = stored(banded.join(shared, "band").join(copies, "key", "left").select("band", F.coalesce("class_key", "key").alias("key")).distinct())
    pivots = buckets.groupBy("band").agg(F.min("key").alias("class_key"), F.max("key").alias("high")).filter("class_key < high").drop("high")
    firsts = durable(buckets.join(pivots, "band").filter("key <> class_key").select("class_key", "key").distinct())
    release(spark)
    links = durable(_verified(firsts, packs, threshold).unionByName(copies.withColumn("likeness", F.lit(1.0))))
    joined = links.select(F.col("class_key").alias("a"), F.col("key").alias("b"))
    labels = durable(components(joined))
    labelled = buckets.join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    # The pivot has met all of its band: it need not be looked at again, and a band is split only if the others are.
    others = labelled.join(pivots, "band").filter("key <> class_key").select("band", "key", "label")
    split = others.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("band")
    left = durable(others.join(split, "band"))
    release(spark)
    if not left.isEmpty():
        more = _across(left, packs, threshold)
        if not more.isEmpty():
            links = durable(links.unionByName(more).groupBy("class_key", "key").agg(F.max("likeness").alias("likeness")))
            labels = durable(components(links.select(F.col("class_key").alias("a"), F.col("key").alias("b"))))
    discard(buckets)
    return links, labels


def near_pairs(prints: DataFrame, key: str = "doc_id", column: str = "fingerprint", threshold: float = 0.8, bands: int | None = None, digits: int = 6) -> DataFrame:
    """(key, class key, likeness) for rows whose fingerprints are at least ``threshold`` alike, class key the less; links enough for all components.

    Without ``bands``, there are so many that a pair right at the threshold is missed once in a hundred times. Band b takes ``digits`` digits spread over the fingerprint at places fixed by b, of walk b mod WALKS.
    """

    rows = prints.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    links, _ = _near(_packs(rows, list), threshold, bands, digits)
    return links.select(F.col("key").alias(key), "class_key", "likeness")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int | None = None, digits: int = 6) -> DataFrame:
    """(key, near_id) of documents that are near another: the least key that near fingerprints lead to. Texts are not shuffled."""
    packs = _packs(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), all_fingerprints)
    _, labels = _near(packs, threshold, bands, digits)
    discard(packs)
    release(docs.sparkSession)
    return labels.select(F.col("node").alias("key"), F.col("label").alias("near_id"))


def op8_edit_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edit_fingerprints(docs, near=near_classes(docs))
