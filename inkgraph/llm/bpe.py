"""Byte-level BPE over a public rank file: two-tier encoding, and decoding.

Tier 1: a minimal perfect hash over the vocabulary resolves a whole pre-token
that is itself in the vocabulary with two table reads and one comparison.
Tier 2: every other pre-token is merged from its bytes, held as a doubly linked
list, with a heap of candidate merges ordered by (rank, place).

The vocabulary has a fixed size (tens of thousands of entries), so the tables go
to workers in the closure of the function, read once on the driver. Each worker
process also remembers pre-tokens it has met, in a table of bounded size.

Defined results: null text encodes as empty; an empty text has no ids, the hash
of no bytes, and decodes to no bytes; every row is encoded on its own, so rows
that repeat give rows that repeat; a very long text is matched as a stream and
hashed piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import free_names, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of a worker's memory of pre-tokens; it is emptied when full.
REMEMBERED = 400_000
#: Matches taken at a time from one text.
PIECE = 50_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks must be 0, 1, 2 and so on."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks are not dense")
    return [tokens[i] for i in range(len(tokens))]


def _place(odd: int, high: int, d: int, n: int) -> int:
    return ((((high + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) * odd & 0xFFFFFFFFFFFFFFFF) >> 13) % n


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.m = m = n // per_bucket + 1
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            low, high = h & 0xFFFFFFFFFFFFFFFF, h >> 64
            buckets[low % m].append((low | 1, high, i))
        self.shift = [0] * m
        self.slot = slot = [-1] * n
        for g in sorted(range(m), key=lambda g: -len(buckets[g])):
            bucket = buckets[g]
            if len(bucket) < 2:
                break
            d = 1
            while True:
                places = [_place(a, b, d, n) for a, b, _ in bucket]
                if len(set(places)) == len(places) and all(slot[p] < 0 for p in places):
                    break
                d += 1
            self.shift[g] = d
            for p, (_, _, i) in zip(places, bucket, strict=True):
                slot[p] = i
        free = (p for p in range(n) if slot[p] < 0)
        for g in range(m):
            if len(buckets[g]) == 1:  # a lone key takes any free slot, named by a negative number
                p = next(free)
                self.shift[g], slot[p] = -p - 1, buckets[g][0][2]
        self.keys = keys

    def get(self, key: bytes) -> int:
        """The key's number, or -1 where it is not one of the keys."""
        h = xxhash.xxh3_128_intdigest(key)
        low = h & 0xFFFFFFFFFFFFFFFF
        d = self.shift[low % self.m]
        p = -d - 1 if d < 0 else _place(low | 1, h >> 64, d, self.n)
        i = self.slot[p]
        return i if self.keys[i] == key else -1


def merge(piece: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of a pre-token: lowest rank first, leftmost on ties.

    ``end[i]`` links the symbol that starts at i to the next; ``before`` links back.
    """
    n = len(piece)
    end = list(range(1, n + 2))
    before = list(range(-1, n))
    get = rank_of.get
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        rank, i, to = pop(heap)
        middle = end[i]
        if middle >= to or end[middle] != to:
            continue  # one of the two symbols has changed since
        end[i], end[middle] = to, n + 1
        if to < n:
            before[to] = i
            if (rank := get(piece[i : end[to]])) is not None:
                push(heap, (rank, i, end[to]))
        j = before[i]
        if j >= 0 and (rank := get(piece[j:to])) is not None:
            push(heap, (rank, j, to))
    ids, i = [], 0
    while i < n:
        ids.append(rank_of[piece[i : end[i]]])
        i = end[i]
    return ids


#: Code points from here on have the general pattern; below it a plain character class says the same and is faster.
LATIN_END = 0x250
NOT_LATIN = re.compile(f"[{chr(LATIN_END)}-\U0010ffff]")


def latin_pattern(pattern: str) -> re.Pattern:
    """``pattern`` with its Unicode classes spelt out for code points below ``LATIN_END``."""

    if re.search(r"\\[pP]\{(?![LN]\})|\\P|\\[dDwW]", pattern):
        return regex.compile(pattern)
    spelt = {"\\p{" + kind + "}": "".join(f"\\u{i:04x}" for i in range(LATIN_END) if unicodedata.category(chr(i)).startswith(kind)) for kind in "LN"} | {"\\s": "\\t-\\r \\x85\\xa0"}
    out, inside = [], False
    for part in re.findall(r"\\p\{.\}|\\.|.", pattern, re.DOTALL):
        if part == "\\S":
            out.append(f"[^{spelt['\\s']}]")
        elif part in spelt:
            out.append(spelt[part] if inside else f"[{spelt[part]}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out))


class Table:
    """Byte strings end to end, so that a sequence of their numbers is spelt out in one gather."""

    def __init__(self, items: list[bytes]):
        self.flat = np.frombuffer(b"".join(items), dtype=np.uint8)
        self.length = np.array([len(x) for x in items], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def spell(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        at = np.arange(end[-1] if len(end) else 0)
        at += np.repeat(self.start[ids] - end + length, length)
        return self.flat[at].tobytes()


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.name = hashlib.sha256(b"".join(b"%d:%b" % (len(t), t) for t in tokens) + pattern.encode()).hexdigest()
        self.hash = PerfectHash(tokens)
        self._ready()

    def _ready(self) -> None:
        self.find, self.find_latin = regex.compile(self.pattern), latin_pattern(self.pattern)
        self.known: dict[str, bytes] = {}
        self.rank_of = {t: i for i, t in enumerate(self.tokens)}
        self.token_table = Table(self.tokens)
        self.text_table = Table([b"%d," % i for i in range(len(self.tokens))])

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "name": self.name, "hash": self.hash}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.hash.get(piece)
        return [whole] if whole >= 0 else merge(piece, self.rank_of)

    def _learn(self, piece: str) -> bytes:
        ids = np.array(self.piece_ids(piece.encode("utf-8", "surrogatepass")), dtype=np.int32).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, in parts of ``PIECE`` pre-tokens where the text is very long."""
        find = self.find if NOT_LATIN.search(text) else self.find_latin
        if len(text) <= 16 * PIECE:
            pieces = [find.findall(text)] if text else []
        else:
            found = find.finditer(text)
            pieces = iter(lambda: [m.group() for m in islice(found, PIECE)], [])
        known = self.known.get
        for part in pieces:
            ids = list(map(known, part))
            if None in ids:
                ids = [x if x is not None else known(p) or self._learn(p) for x, p in zip(ids, part, strict=True)]
            yield np.frombuffer(b"".join(ids), dtype=np.int32)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for part in self.encode_parts(text or "") for x in part]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return self.token_table.spell(np.asarray(ids, dtype=np.int64))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids' decimal text, SHA-256 of the bytes decoded from the ids)."""
        hashed, back, n = hashlib.sha256(), hashlib.sha256(), 0
        for ids in self.encode_parts(text or ""):
            hashed.update((b"," if n else b"") + self.text_table.spell(ids)[:-1])
            n += len(ids)
            back.update(self.decode(ids))
        return n, hashed.hexdigest(), back.hexdigest()


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def public_codec(name: str = VOCABULARY) -> Codec:
    import public_tokenizers

    return codec(public_tokenizers.path(name), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, model: Codec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>: the ids of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is the vocabulary's

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _mine(shared)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "ids": [np.array(own.encode(t), dtype=np.int32) for t in pdf["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, model: Codec, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, data binary: the bytes that the ids stand for; null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _mine(shared)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "data": [own.decode(x if x is not None else []) for x in pdf["ids"]]})

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInPandas(run, f"key {kind}, data binary").withColumnRenamed("key", key)


_OWN: dict[str, Codec] = {}


def _mine(shared) -> Codec:
    """A worker process keeps one codec, and what it remembers, from task to task; another vocabulary takes its place."""
    own = shared.value
    if own.name not in _OWN:
        _OWN.clear()
        _OWN[own.name] = own
    return _OWN[own.name]


def digest_documents(docs: DataFrame, model: Codec, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text; key, n_tokens, ids_sha256, decoded_sha256 and the columns in ``keep``, which pass as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(key, *keep)
    if clash := {"n_tokens", "ids_sha256", "decoded_sha256"} & {c.lower() for c in chosen.columns}:
        raise ValueError(f"columns to keep are named as results: {sorted(clash)}")
    place = free_names(chosen.columns, "text_in")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _mine(shared)
        for batch in batches:
            found = [own.digest(t) for t in batch.column(place).to_pylist()]
            columns = [pa.array(x, kind) for x, kind in zip(list(zip(*found, strict=True)) or [[], [], []], (pa.int64(), pa.string(), pa.string()), strict=True)]
            rest = [batch.column(i) for i in range(1, batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *rest], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    names = [chosen.columns[0], "n_tokens", "ids_sha256", "decoded_sha256", *chosen.columns[1:]]
    return docs.select(key, *keep, F.col(text).alias(place)).mapInArrow(run, ", ".join([fields[0], "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *fields[1:]]))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded."""
    return digest_documents(table(spark, sf_dir, "documents"), public_codec())
