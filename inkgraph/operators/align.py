"""Mentions carried from the tokens of another tokeniser to the tokens of `functions.text.tokenize`.

Both streams of a chapter spell the same text, so they are aligned by what they have in common: ASCII letters and digits, whatever their case.
The n-th letter of one stream is the n-th letter of the other, so the alignment never goes backwards. A mention's first letter decides its first token,
its last letter its last token. Bracket names such as ``-LRB-`` count as punctuation in both.

A mention is not aligned, and says so by null positions, when its span has no letter or lies outside the stream, or when the letters found
do not agree with those of its own tokens (the streams then do not spell the same text; mentions before the first difference are not touched by it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["book_id", "chapter"]
#: Tokens in one row, and letters by which rows of the two streams find each other.
PIECE, BUCKET = 64, 512
#: What each byte of a token adds to the letters, 0 for nothing; names that add nothing.
SPELLED = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], dtype=np.uint8)
BRACKET = r"\A-[LlRr][RrSsCc][Bb]-(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"


def letters(token: Column) -> Column:
    """What a token adds to the common stream of letters."""
    plain = F.lower(F.regexp_replace(F.coalesce(token, F.lit("")), "[^A-Za-z0-9]+", ""))
    return F.when(token.rlike("^(?i)-[LR][RSC]B-$"), "").otherwise(plain)


def _letters_of(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`letters` of all tokens at once: their bytes one after the other, and where each begins, with the end of all."""
    texts = tokens.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    found = SPELLED[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    for i in np.flatnonzero(pc.match_substring_regex(texts, BRACKET).to_numpy(zero_copy_only=False)):
        found[at[i] : at[i + 1]] = 0
    kept = found != 0
    return found[kept], np.concatenate([[0], np.cumsum(kept)])[at]


def spelled_as(tokens: DataFrame, words: list[str]) -> DataFrame:
    """book_id, chapter, start, text: the tokens whose `letters` are one of the words, and where they stand."""
    of = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, count = batch["tokens"].flatten(), pc.list_value_length(batch["tokens"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            spelled, at = _letters_of(flat)
            long, found = np.diff(at), []
            for w in set(words):
                some = np.flatnonzero(long == len(w))
                for k, c in enumerate(w.encode()):
                    some = some[spelled[at[some] + k] == c]
                found.append(some)
            i = np.sort(np.concatenate(found))
            row = np.searchsorted(np.cumsum(count), i, side="right")
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(row)) for k in KEYS), pa.array((i - (np.cumsum(count) - count)[row]).astype(np.int32)), flat.take(pa.array(i))], names=[*KEYS, "start", "text"])

    return tokens.select(*KEYS, "tokens").mapInArrow(run, f"book_id {of['book_id']}, chapter {of['chapter']}, start int, text string")


def _cut(tokens: DataFrame) -> DataFrame:
    """book_id, chapter, stretch, first, offset, size, starts, spelled: stretches of `PIECE` tokens as letters; ``offset`` letters of the chapter come before them, ``starts`` of the stretch before each token.

    A chapter's tokens are one row, so they are counted where they are, and nothing gathers by chapter.
    """
    of = {f.name: f.dataType.simpleString() for f in tokens.schema}
    piece = PIECE

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = batch["tokens"]
        count = pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        spelled, at = _letters_of(held.flatten())
        before = np.concatenate([[0], np.cumsum(count)])
        parts = -(-count // piece)
        row = np.repeat(np.arange(len(count)), parts)
        stretch = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        low = before[row] + stretch * piece
        high = np.minimum(low + piece, before[row + 1])
        text = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.append(at[low], at[-1] if len(row) else 0).astype(np.int32)), pa.py_buffer(spelled)) if len(row) else pa.array([], pa.string())
        n = high - low
        ends = np.concatenate([[0], np.cumsum(n)])
        token = np.arange(int(ends[-1]))  # the tokens of all stretches are all tokens in order
        starts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((at[token] - np.repeat(at[low], n)).astype(np.int32)))
        keys = [batch[k].take(pa.array(row)) for k in KEYS]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x) for x in (stretch, stretch * piece, at[low] - at[before[row]], at[high] - at[low])), starts, text], names=[*KEYS, "stretch", "first", "offset", "size", "starts", "spelled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch)

    return tokens.select(*KEYS, "tokens").mapInArrow(run, f"book_id {of['book_id']}, chapter {of['chapter']}, stretch bigint, first bigint, offset bigint, size bigint, starts array<int>, spelled string")


def _points(asked: DataFrame, foreign: DataFrame) -> DataFrame:
    """book_id, chapter, start, end, last, at, word: the letter that stands for the first (last = false) or the last token of a mention, and the letters it is known by."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(False).alias("last")), F.struct(F.col("end").alias("pos"), F.lit(True).alias("last"))))
    points = asked.select(*KEYS, "start", "end", ends.alias("p")).select(*KEYS, "start", "end", "p.*").withColumn("stretch", F.floor(F.col("pos") / PIECE))
    i = (F.col("pos") - F.col("first")).cast("int")
    begin, end = F.get("starts", i), F.coalesce(F.get("starts", i + 1).cast("bigint"), F.col("size"))
    word = F.when(F.col("last"), F.substring("spelled", end.cast("int"), F.when(end > begin, 1).otherwise(0))).otherwise(F.substring("spelled", begin + 1, (end - begin).cast("int")))
    at = F.col("offset") + F.when(F.col("last"), end - 1).otherwise(begin)
    return points.join(_cut(foreign), [*KEYS, "stretch"]).filter(begin.isNotNull()).select(*KEYS, "start", "end", "last", at.alias("at"), word.alias("word")).filter("at >= 0")


def _landed(points: DataFrame, own: DataFrame) -> DataFrame:
    """book_id, chapter, start, end, last, at, own: the own token with the letter; null where its letters are others."""
    buckets = F.sequence(F.floor(F.col("offset") / BUCKET), F.floor((F.col("offset") + F.col("size") - 1) / BUCKET))
    ranges = _cut(own).filter("size > 0").select(*KEYS, "stretch", "offset", "size", F.explode(buckets).alias("bucket"))
    held = points.withColumn("bucket", F.floor(F.col("at") / BUCKET)).join(ranges, [*KEYS, "bucket"]).filter("at >= offset and at < offset + size").drop("bucket", "offset", "size")
    place = (F.col("at") - F.col("offset")).cast("int")
    i = F.size(F.filter("starts", lambda s: s <= F.col("place"))) - 1  # the last token that begins no later has the letter
    found = held.join(_cut(own), [*KEYS, "stretch"]).select(*KEYS, "start", "end", "last", "at", "word", "first", "spelled", "size", "starts", place.alias("place")).withColumn("i", i)
    room = F.coalesce(F.get("starts", F.col("i") + 1).cast("bigint"), F.col("size")) - F.col("place")
    rest = F.substring("spelled", F.col("place") + 1, F.least(room, F.length("word").cast("bigint")).cast("int"))
    return found.select(*KEYS, "start", "end", "last", "at", F.when(F.startswith("word", rest), F.col("first") + F.col("i")).alias("own"))


def align(entities: DataFrame, foreign: DataFrame, own: DataFrame) -> DataFrame:
    """``entities`` with own_start and own_end, both null where a mention is not aligned.

    ``foreign`` (the tokens that start and end count) and ``own``: book_id, chapter, tokens array<string>, a row for each chapter; entities and ``own`` are read twice, so they should be tables.
    Texts travel in stretches of `PIECE` tokens, once on each side, and meet only the positions asked for, each pair once. Null tokens count as
    punctuation; null positions, those outside the stream and chapters with no tokens on either side are not aligned; rows that repeat are aligned alike; no entities give no rows.
    """
    asked = entities.select(*KEYS, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).filter("start >= 0 and start <= end").distinct()
    side = lambda last, c: F.max(F.when(F.col("last") == last, F.col(c)))  # noqa: E731  one row each
    ids = [*KEYS, "start", "end"]
    ends = _landed(_points(asked, foreign), own).groupBy(*ids).agg(side(False, "own").alias("s_own"), side(True, "own").alias("e_own"), side(False, "at").alias("s_at"), side(True, "at").alias("e_at"))
    good = ends.filter("s_own is not null and e_own is not null and s_at <= e_at").select(*[F.col(c).alias(f"align_{c}") for c in ids], F.col("s_own").alias("own_start"), F.col("e_own").alias("own_end"))
    on = [entities[c].eqNullSafe(good[f"align_{c}"]) for c in KEYS] + [entities[c] == good[f"align_{c}"] for c in ("start", "end")]
    return entities.join(good, on, "left").select(*[entities[c] for c in entities.columns], "own_start", "own_end")


def carried_over(aligned: DataFrame) -> DataFrame:
    """The entities in own positions. Those not aligned get -1: they count as mentions and stand in no window."""
    kind = dict(aligned.dtypes)
    own = {c: F.coalesce(F.col(f"own_{c}"), F.lit(-1)).cast(kind[c]) for c in ("start", "end")}
    return aligned.withColumns(own).drop("own_start", "own_end")


def alignment_counts(aligned: DataFrame) -> DataFrame:
    """book_id, chapter, n_mentions, n_unaligned."""
    return aligned.groupBy(*KEYS).agg(F.count("*").alias("n_mentions"), F.count_if(F.col("own_start").isNull()).alias("n_unaligned"))
