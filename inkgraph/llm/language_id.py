"""Language identification by prediction by partial matching (PPM).

For each language a variable-order context tree over all 256 byte values (orders ``ORDER`` to 0, then
uniform) is counted from labelled text and then frozen. A byte that a context has
seen n times in N costs -log2(n / (N + q)) bits, q being the number of distinct
bytes seen there; one that it has not seen costs the escape, -log2(q / (N + q)),
and then what the next shorter context says, with the bytes already excluded. A context never seen
costs nothing to leave. As the statistics are frozen, the exact cost of every byte after every context is
known once training ends: scoring a text is a sum of table look-ups, over the whole text.

Tables hold a row for each context that was seen, and a column for each byte value that was seen in training;
byte values that no training text has all cost the same (their share of the uniform rest), so one column serves
them without merging anything. Any number of languages is learned, ``GROUP`` of them to a table; a worker that has
several tables holds one at a time.

Training may use a bounded sample of the labelled rows, and does:
``docs_per_lang`` whole documents of each language, those with the smallest
hash of doc_id. All else covers all rows.

Results: lang_pred; score, the posterior of that language among the learned ones; excess, the bits a byte that the text costs
above what the language's own training texts cost on average (text of an unlearned language, or no language, costs more).

Defined results: null text, or text without a letter, gives ``und`` with score 0 and no excess;
equal code lengths go to the first language by name; no labelled rows at all
gives ``und`` for every row; rows that repeat are scored one by one; a very long
text is summed in pieces; input columns named as results stay as they are, and the results then
get an underscore more; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.llm.common import free_names, table

ORDER = 3
#: Languages to a table.
GROUP = 16
#: Keys of the training sample up to which they are broadcast.
BROADCAST_KEYS = 100_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = re.compile("[A-Za-z]")
PIECE = 1 << 20
#: The context before the first byte.
BEFORE = b" " * ORDER


@dataclass
class Model:
    """Languages of one table: symbol of each byte, number of each context, and by language a row for each number and bits[row, symbol]."""

    langs: list[str]
    symbol: np.ndarray
    number: np.ndarray
    rows: list[np.ndarray]
    bits: list[np.ndarray]
    level: list[float]

    def lengths(self, text: bytes) -> np.ndarray:
        """Code length of the whole text in bits, by language."""
        size = int(self.symbol.max()) + 1
        total = np.zeros(len(self.langs))
        before = self.symbol[np.frombuffer(BEFORE, dtype=np.uint8)]
        data = np.frombuffer(text, dtype=np.uint8)
        for at in range(0, len(data), PIECE):
            s = np.concatenate([before, self.symbol[data[at : at + PIECE]]])
            before = s[-ORDER:]
            n = len(s) - ORDER
            context = s[:n].copy()
            for i in range(1, ORDER):
                context *= size
                context += s[i : i + n]
            found = self.number.take(context)
            for k in range(len(self.langs)):
                total[k] += float(self.bits[k].take(self.rows[k].take(found) * size + s[ORDER:]).sum(dtype=np.float64))
        return total


def predict(models: list[Model], text: str | None, totals: np.ndarray | None = None) -> tuple[str, float, float | None]:
    """(language, score, excess); ``totals`` are the code lengths by all models, if known."""
    if text is None or not models or not (_ASCII_LETTER.search(text) or _LETTER.search(text)):
        return UNKNOWN, 0.0, None
    data = text.encode("utf-8", "surrogatepass")
    bits = np.concatenate([m.lengths(data) for m in models]) if totals is None else totals
    langs, levels = [x for m in models for x in m.langs], [x for m in models for x in m.level]
    best = min(range(len(langs)), key=lambda k: (bits[k], langs[k]))
    return langs[best], float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum()), float(bits[best] / len(data) - levels[best])


def ppm_bits(levels: list[np.ndarray], absent: int) -> np.ndarray:
    """Cost in bits of each symbol after each context: counts[context, symbol] of the context and of its ever shorter ends, longest first.

    Escape method C with exclusion. Column 0 stands for each of ``absent`` byte values that are in no counts.
    """
    bits = np.zeros(levels[0].shape)
    open_ = np.ones(levels[0].shape, dtype=bool)  # not coded yet, hence not excluded
    for counts in levels:
        seen = np.where(open_, counts, 0)
        total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        coded = seen > 0
        scale = np.maximum(total + kinds, 1)
        bits = np.where(coded, bits - np.log2(np.where(coded, seen, 1) / scale), np.where(open_ & (kinds > 0), bits - np.log2(np.maximum(kinds, 1) / scale), bits))
        open_ &= ~coded
    left = open_[:, 1:].sum(axis=1, keepdims=True) + absent
    return np.where(open_, bits + np.log2(np.maximum(left, 1)), bits).astype(np.float32)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The table of some languages from counts of (ORDER + 1)-byte cells: language -> (cells, numbers)."""
    langs = sorted(counts)
    used = np.zeros(256, dtype=bool)
    used[np.frombuffer(BEFORE, dtype=np.uint8)] = True
    for cells, _ in counts.values():
        for i in range(ORDER + 1):
            used[(cells >> (8 * i)) & 255] = True
    symbol = np.where(used, np.cumsum(used), 0).astype(np.int64)
    size = int(used.sum()) + 1
    absent = 256 - int(used.sum())
    own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}  # by language and order: contexts, and which row each count goes to
    for name, (cells, _) in counts.items():
        s = [symbol[(cells >> (8 * i)) & 255] for i in range(ORDER + 1)]  # s[0] the byte, s[1] the one before it, ...
        context, per = np.zeros(len(cells), dtype=np.int64), []
        for order in range(ORDER + 1):
            if order:
                context = context + s[order] * size ** (order - 1)
            per.append(np.unique(context, return_inverse=True) if order else (np.zeros(1, dtype=np.int64), np.zeros(len(cells), dtype=np.int64)))
        own[name] = per
    # Contexts of all languages together get one number each, by order; every context of full length gets the number of its longest known end.
    known = [np.unique(np.concatenate([own[name][order][0] for name in langs])) for order in range(ORDER + 1)]
    first = np.cumsum([0] + [len(x) for x in known])
    number = np.full(size**ORDER, first[0], dtype=np.int32)
    every = np.arange(size**ORDER, dtype=np.int64)
    for order in range(1, ORDER + 1):
        at = np.full(size**order, -1, dtype=np.int32)
        at[known[order]] = first[order] + np.arange(len(known[order]))
        end = at[every % size**order]
        number = np.where(end >= 0, end, number)
    rows, bits, level = [], [], []
    for name in langs:
        cells, n = counts[name]
        byte = symbol[cells & 255]
        tables = []
        for order in range(ORDER + 1):
            contexts, place = own[name][order]
            counted = np.zeros((len(contexts), size), dtype=np.float64)
            np.add.at(counted, (place, byte), n)
            tables.append((contexts, counted))
        parts, starts, start = [], [], 0
        for order in range(ORDER + 1):
            contexts, counted = tables[order]
            levels = [counted] + [tables[lower][1][np.searchsorted(tables[lower][0], contexts % size**lower)] for lower in range(order - 1, -1, -1)]
            parts.append(ppm_bits(levels, absent))
            starts.append(start)
            start += len(contexts)
        row = np.zeros(first[-1], dtype=np.int64)
        for order in range(ORDER + 1):
            ends = known[order]
            best = np.zeros(len(ends), dtype=np.int64)
            for lower in range(order + 1):
                contexts = tables[lower][0]
                if len(contexts):
                    at = np.minimum(np.searchsorted(contexts, ends % size**lower), len(contexts) - 1)
                    best = np.where(contexts[at] == ends % size**lower, starts[lower] + at, best)
            row[first[order] : first[order + 1]] = best
        rows.append(row)
        flat = np.concatenate(parts)
        bits.append(flat.ravel())
        spent = parts[ORDER][own[name][ORDER][1], byte]
        level.append(float((spent * n).sum() / max(n.sum(), 1)))
    return Model(langs, symbol, number, rows, bits, level)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def cells_of(text: str) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number."""
    s = np.frombuffer(BEFORE + text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    n = len(s) - ORDER
    return sum(s[i : i + n] << (8 * (ORDER - i)) for i in range(ORDER + 1))


def train(docs: DataFrame, docs_per_lang: int = 300, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Model]:
    """Count the cells of a bounded sample on the executors; only counts come to the driver, GROUP languages at a time.

    Rows for which `held_out` holds, or without a label or a text, are never learned from.
    """
    labelled = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("key").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    total = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(total)
    # First a hash threshold that leaves some 4 * docs_per_lang rows of a language however many it has, then the exact rank among those.
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, 4.0 * docs_per_lang / total[name])])[F.col("lang")] if langs else F.lit(0.0)
    few = labelled.select("key", "lang").filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < share * float(1 << 40))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 40)), "key")
    chosen = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs_per_lang).select("key", "lang").distinct()
    chosen = F.broadcast(chosen) if docs_per_lang * len(langs) <= BROADCAST_KEYS else chosen  # so many keys at most
    sample = labelled.join(chosen, ["key", "lang"]).select("lang", "text")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, dict[int, int]] = {}
        for pdf in batches:
            for name, t in zip(pdf["lang"], pdf["text"], strict=True):
                own = found.setdefault(name, {})
                for cell, n in zip(*(x.tolist() for x in np.unique(cells_of(t), return_counts=True)), strict=True):
                    own[cell] = own.get(cell, 0) + n
        for name, own in found.items():
            yield pd.DataFrame({"lang": name, "cell": list(own), "n": list(own.values())})

    models = []
    for at in range(0, len(langs), GROUP):
        own = langs[at : at + GROUP]
        counted = sample.filter(F.col("lang").isin(own)).mapInPandas(cells, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
        by_lang = {name: (part["cell"].to_numpy(), part["n"].to_numpy()) for name, part in counted.groupby("lang")}
        empty = (np.zeros(0, dtype=np.int64),) * 2  # a language of empty texts only
        models.append(build({name: by_lang.get(name, empty) for name in own}))
    return models


def identify(docs: DataFrame, models: list[Model], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of ``docs`` and lang_pred, score, excess. ``key`` is not an input of the prediction.

    The models are broadcast, GROUP languages each: their size is bounded by the training sample.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in models]
    added = free_names(docs.columns, "lang_pred", "score", "excess")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            if len(shared) < 2:
                found = [predict([s.value for s in shared], t) for t in texts]
            else:
                lengths, frames = [], []
                for s in shared:
                    own = s.value
                    lengths.append([own.lengths((t or "").encode("utf-8", "surrogatepass")) for t in texts])
                    frames.append(Model(own.langs, own.symbol, own.number[:0], [], [], own.level))
                    s.__dict__.pop("_value", None)  # one table at a time
                found = [predict(frames, t, np.concatenate([x[i] for x in lengths])) for i, t in enumerate(texts)]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
