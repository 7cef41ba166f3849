"""Co-occurrence of names inside a sliding position window.

A centre is a distinct position with at least one mention; its window reaches ``half`` to either
side, both ends included. A pair weighs as many centres as have both names in their windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions.numbers import BOUND, TICKS, round_div

KEYS = ["book_id", "chapter"]
#: Pairs of near mentions that one cell of a chapter should have, or one of so many cells of all chapters where that is more (what is exchanged grows with the parts); most parts that the names of a chapter are dealt to; tasks for each shuffle partition.
CELL_PAIRS, ALL_CELLS, MOST_PARTS, FINER = 30_000_000, 128, 1_000, 4
#: Pairs of mentions that are looked at together.
AT_ONCE = 250_000
#: How a chapter's text is held until all of it is there.
PACKED = pa.Codec("zstd", compression_level=1)
Scores = DataFrame | Callable[[DataFrame], DataFrame] | str | None


def in_range(mentions: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """Mentions at positions of the chapter. ``lengths``: book_id, chapter, n_tokens; None: any position."""
    if lengths is None:
        return mentions
    return mentions.join(lengths.select(*KEYS, "n_tokens"), KEYS).filter((F.col("pos") >= 0) & (F.col("pos") < F.col("n_tokens"))).drop("n_tokens")


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by the hash of the columns, kept as ``h``, to FINER tasks for each shuffle partition, so that a task holds that much less.

    Group by ``h`` too, or the rows are exchanged again, to as many tasks as there are shuffle partitions.
    """
    return rows.withColumn("h", F.xxhash64(*columns)).repartition(FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")


def stretch_of(half: int) -> int:
    """Positions in one stretch, where none are asked for."""
    return max(64 * (half + 1), 2 * half + 1)


def scored_stretch(half: int) -> int:
    """Positions in one stretch whose centres are scored: each centre looks through the hits of its stretch, so there are fewer."""
    return max(stretch_of(half) // 4, 2 * half + 1)


def windows(mentions: DataFrame, half: int, stretch: int | None = None) -> DataFrame:
    """book_id, chapter, bucket (its stretch), pos, cast: every centre and the sorted distinct names in its window.

    A chapter is cut into stretches of positions, and mentions within ``half`` of a border also
    go to the neighbour, so one long chapter is many tasks. All of it, up to the pair counts, rides one exchange.
    """
    stretch = max(stretch or stretch_of(half), 2 * half + 1)
    own = F.floor(F.col("pos") / stretch)
    near = F.array_distinct(F.array(own, F.floor((F.col("pos") - half) / stretch), F.floor((F.col("pos") + half) / stretch)))
    dealt = mentions.select(*KEYS, "name", "pos", own.alias("own"), F.explode(near).alias("bucket")).repartition(*KEYS, "bucket")
    at = dealt.groupBy(*KEYS, "bucket", "pos", "own").agg(F.collect_set("name").alias("names"))
    frame = Window.partitionBy(*KEYS, "bucket").orderBy("pos").rangeBetween(-half, half)
    cast = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names").over(frame))))
    return at.withColumn("cast", cast).filter("own = bucket").select(*KEYS, "bucket", "pos", "cast")


def pairs_of(cast: Column) -> Column:
    """array<struct<a,b>>, a < b, of a sorted array."""
    return F.flatten(F.transform(cast, lambda a, i: F.transform(F.slice(cast, i + 2, F.size(cast)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_events(mentions: DataFrame, half: int, lengths: DataFrame | None = None, scores: Scores = None) -> DataFrame:
    """One row for each (centre, pair); with ``scores`` each centre is scored once, before pairs are made.

    ``scores``: a table (book_id, chapter, pos, score_e4), or a function that adds score_e4 to the rows of `windows`.
    """
    found = windows(in_range(mentions, lengths), half, scored_stretch(half) if callable(scores) else None).filter(F.size("cast") >= 2)
    extra = []
    if callable(scores):
        found, extra = scores(found), ["score_e4"]
    elif scores is not None:
        found, extra = found.join(scores.select(*KEYS, "pos", "score_e4"), [*KEYS, "pos"], "left"), [F.coalesce("score_e4", F.lit(0).cast("bigint")).alias("score_e4")]
    return found.select(*KEYS, "pos", *extra, F.explode(pairs_of(F.col("cast"))).alias("p")).select(*KEYS, "pos", *[e if isinstance(e, str) else "score_e4" for e in extra], "p.a", "p.b")


def parts_of(mentions: DataFrame, half: int) -> DataFrame:
    """book_id, chapter, parts: into how many the names of a chapter are dealt, by about how many near mentions it has. A row for each chapter."""
    wide = 16
    at = mentions.groupBy(*KEYS, F.floor(F.col("pos") / (wide * (2 * half + 1))).alias("place")).agg(F.count("*").alias("n"))
    seen = at.groupBy(*KEYS).agg(F.sum(F.col("n") + F.col("n") * F.col("n") / wide).alias("seen"))
    every = F.sum("seen").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = F.ceil(F.sqrt(2 * F.col("seen") / F.greatest(F.lit(CELL_PAIRS), every / ALL_CELLS)))
    return seen.select(*KEYS, F.least(parts, F.lit(MOST_PARTS)).cast("int").alias("parts"))


def _spans(mentions: DataFrame, half: int, scores: DataFrame | str | None = None, stretch: int | None = None) -> DataFrame:
    """The rows of `covers` without ``parts``."""
    stretch = max(stretch or stretch_of(half), 2 * half + 1)
    if scores is None:
        scored = mentions.select(*KEYS, "name", "pos", F.lit(0).cast("bigint").alias("score"))
    elif isinstance(scores, str):
        scored = mentions.select(*KEYS, "name", "pos", F.col(scores).cast("bigint").alias("score"))
    else:
        scored = mentions.select(*KEYS, "name", "pos").join(scores.select(*KEYS, "pos", "score_e4"), [*KEYS, "pos"], "left").select(*KEYS, "name", "pos", F.coalesce("score_e4", F.lit(0)).cast("bigint").alias("score"))
    own = F.floor(F.col("pos") / stretch)
    near = F.array_distinct(F.array(own, F.floor((F.col("pos") - half) / stretch), F.floor((F.col("pos") + half) / stretch)))
    stretches = ["h", *KEYS, "bucket"]  # a book_id that is the same in all rows drops out of groupings, h does not
    once = dealt(scored.select("*", F.explode(near).alias("bucket")), *KEYS, "bucket").groupBy(*stretches, "name", "pos").agg(F.min("score").alias("score"))
    order = Window.partitionBy(*stretches).orderBy("pos")
    upto = lambda c, n: F.coalesce(F.sum(c).over(order.rangeBetween(Window.unboundedPreceding, n)), F.lit(0).cast("bigint"))
    first = (own == F.col("bucket")) & F.coalesce(F.lag("pos").over(order) < F.col("pos"), F.lit(True))
    at = once.withColumn("one", first.cast("bigint"))
    columns = {"lo": upto("one", -half - 1), "hi": upto("one", half)}
    if scores is not None:
        least = F.min("score").over(order.rangeBetween(0, 0))
        at = at.withColumn("worth", F.col("one") * F.coalesce(least, F.lit(0)))
        columns |= {"low": upto("worth", -half - 1), "high": upto("worth", half)}
    counted = at.select(*stretches, "name", "pos", *[c.alias(n) for n, c in columns.items()])
    same = Window.partitionBy(*stretches, "name").orderBy("pos")
    told = counted.withColumns({"was": F.lag("hi").over(same), **({"had": F.lag("high").over(same)} if scores is not None else {})})
    later = F.coalesce(F.col("was") > F.col("lo"), F.lit(False))
    if scores is not None:
        told = told.withColumn("low", F.when(later, F.col("had")).otherwise(F.col("low")))
    base = (F.col("bucket") * stretch).cast("bigint")
    mine = told.withColumn("lo", F.when(later, F.col("was")).otherwise(F.col("lo"))).filter("hi > lo AND name IS NOT NULL")
    return mine.select(*KEYS, "name", "pos", (F.col("lo") + base).alias("lo"), (F.col("hi") + base).alias("hi"), *(["low", "high"] if scores is not None else []))


def covers(mentions: DataFrame, half: int, scores: DataFrame | str | None = None, stretch: int | None = None) -> DataFrame:
    """book_id, chapter, name, pos, lo, hi [, low, high], parts: the centres that each mention adds to its name's, by number: those after ``lo`` up to ``hi``.

    Chapters are cut into stretches, and a mention near a border has a row in both. A stretch's centres are numbered in order, on from numbers that no other stretch has;
    ``low`` and ``high`` are the sums of the stretch's scores up to ``lo`` and ``hi``. What an earlier mention of the name covers is left out, so a
    name's covers are disjoint, and a pair weighs what its covers have in common. All of it rides one exchange. ``parts`` as in `parts_of`.
    """
    return _spans(mentions, half, scores, stretch).join(F.broadcast(parts_of(mentions, half)), KEYS)


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of each. Keys are not negative."""
    if not len(key):
        return key, *counts
    bits = len(key).bit_length()
    if int(key.max()) >> (62 - bits):
        order = np.argsort(key)
        key = key[order]
    else:  # one plain sort of key and place
        key = (key << bits) | np.arange(len(key))
        key.sort()
        order = key & ((1 << bits) - 1)
        key >>= bits
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    if len(first) == len(key):
        return key, *(c[order] for c in counts)
    return key[first], *(np.add.reduceat(c[order], first) for c in counts)


def _small(x: np.ndarray) -> np.ndarray:
    """In four bytes where they do."""
    return x.astype(np.int32) if x.dtype == np.int64 and len(x) and -(1 << 31) <= x.min() and x.max() < 1 << 31 else x


def _rounded(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """As `round_div`."""
    whole = (2 * np.abs(total) + weight) // (2 * weight)
    return np.where(total < 0, -whole, whole)


def _texts(x: np.ndarray, text: Callable[[int], str]) -> pa.Array:
    """``text`` of whole numbers, worked out once for each."""
    found, at = np.unique(x, return_inverse=True)
    return pa.array([text(int(v)) for v in found], pa.string()).take(pa.array(at))


def _sides(p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys of two lists of distinct ones, in order, and whether they are in the first and in the second."""
    both = np.concatenate([p << 1, (g << 1) | 1])
    both.sort()
    key, second = both >> 1, (both & 1).astype(bool)
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    again = np.concatenate([~new[1:], [False]])[: len(key)]  # the next is the same of the second list
    return key[new], ~second[new], (second | again)[new]


class _Met:
    """The near mentions of one side of one cell, by the names of its first part."""

    def __init__(self, c: dict[str, np.ndarray], cell: int, half: int, names: int, mirrored: bool = False):
        first_part, second_part = divmod(cell, MOST_PARTS)
        self.same, self.names, self.mirrored = first_part == second_part, names, mirrored
        order = np.argsort(c["pos"], kind="stable")
        right = order if self.same else order[c["part"][order] == second_part]
        left = order[c["part"][order] == first_part]
        left = left[np.argsort(c["code"][left], kind="stable")]
        pos = c["pos"][right]
        self.low, self.end = np.searchsorted(pos, c["pos"][left] - 2 * half), np.searchsorted(pos, c["pos"][left] + 2 * half, side="right")
        kept = {x: _small(y) for x, y in c.items() if x not in ("pos", "part", "listed", "second")}
        self.left, self.right = {x: y[left] for x, y in kept.items()}, {x: y[right] for x, y in kept.items()}
        #: How many mentions of the left, and how many near ones of the right, there are up to each name.
        self.rows = np.concatenate([[0], np.cumsum(np.bincount(self.left["code"], minlength=names))])
        self.upto = np.concatenate([[0], np.cumsum(self.end - self.low)])[self.rows]

    def pairs(self, begin: int, stop: int, at_once: int) -> tuple[np.ndarray, ...]:
        """The pairs (as one number: a * names + b) of the names of the left from the begin-th on, their weights and totals."""
        start, last = int(self.rows[begin]), int(self.rows[stop])
        n = self.end[start:last] - self.low[start:last]
        upto = np.concatenate([[0], np.cumsum(n)])
        found, k = [(np.zeros(0, dtype=np.int64),) * 3], 0
        while k < len(n):
            m = max(k + 1, int(np.searchsorted(upto, upto[k] + at_once, side="right")) - 1)
            found.append(_summed(*self._step(start + k, start + m)))
            k = m
        return found[1] if len(found) == 2 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _step(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        low, n = self.low[start:stop], self.end[start:stop] - self.low[start:stop]
        j = np.arange(int(n.sum())) + np.repeat(low - np.cumsum(n) + n, n)
        i = np.repeat(np.arange(start, stop), n)
        left, right = self.left, self.right
        if self.same:  # each pair once, or from both its ends
            good = right["code"][j] != left["code"][i] if self.mirrored else right["code"][j] > left["code"][i]
            i, j = i[good], j[good]
        hi1, hi2, lo1, lo2 = left["hi"][i], right["hi"][j], left["lo"][i], right["lo"][j]
        weight = np.minimum(hi1, hi2) - np.maximum(lo1, lo2)
        good = weight > 0
        if "marked" in left:
            good &= left["marked"][i] | right["marked"][j]
        i, j, weight = i[good], j[good], weight[good].astype(np.int64)
        total = np.zeros(len(weight), dtype=np.int64)
        if "high" in left:
            high = np.where((hi1 < hi2)[good], left["high"][i], right["high"][j])
            total = high.astype(np.int64) - np.where((lo1 > lo2)[good], left["low"][i], right["low"][j])
        a, b = left["code"][i].astype(np.int64), right["code"][j].astype(np.int64)
        return (a if self.same else np.minimum(a, b)) * self.names + (b if self.same else np.maximum(a, b)), weight, total


def _blocks(sides: list[_Met], names: int, at_once: int) -> Iterator[tuple[int, int]]:
    """Runs of names with about so many near mentions on all sides; a name by itself may have more."""
    upto = sum(x.upto for x in sides)
    begin = 0
    while begin < names and upto[begin] < upto[-1]:
        stop = min(names, max(begin + 1, int(np.searchsorted(upto, upto[begin] + at_once, side="right")) - 1))
        yield begin, stop
        begin = stop


class _Folded:
    """What is made of a cell's pairs: ``add`` takes those of a run of names, ``end`` says what is left when all were there; both give columns or nothing. Here: a row for each pair."""

    kinds = "weight bigint"
    #: What a row has of names. Whether a cell has all pairs of its part's names with later ones; with any others, so that a pair is met from both its ends; whether a chapter is one cell.
    named, whole, mirrored, alone = ("a", "b"), False, False, False

    def __init__(self, names: pa.Array):
        self.names = names

    def ends(self, key: np.ndarray) -> list[pa.Array]:
        n = max(len(self.names), 1)
        return [self.names.take(pa.array(key // n)), self.names.take(pa.array(key % n))]

    def add(self, key: np.ndarray, *sums: np.ndarray) -> list | None:
        return [*self.ends(key), *sums[: self.kinds.count(",") + 1]]

    def end(self) -> list | None:
        return None


class _Scored(_Folded):
    kinds = "weight bigint, total bigint"


class _Compared(_Folded):
    kinds = "p boolean, g boolean"


class _Heaviest(_Folded):
    """Only the ``most`` heaviest pairs of a cell, ties by names; those of a chapter are among them."""

    kinds = "weight bigint, total bigint"
    most = 1

    def __init__(self, names: pa.Array):
        super().__init__(names)
        self.best = (np.zeros(0, dtype=np.int64),) * 3

    def add(self, *sums: np.ndarray) -> None:
        key, weight, total = (np.concatenate(x) for x in zip(self.best, sums, strict=True))
        if len(weight) > self.most:
            some = weight >= np.partition(weight, -self.most)[-self.most]
            key, weight, total = key[some], weight[some], total[some]
        order = np.lexsort((key, -weight))[: self.most]
        self.best = key[order], weight[order], total[order]

    def end(self) -> list:
        return [*self.ends(self.best[0]), *self.best[1:]]


class _Totals(_Folded):
    """How many pairs a cell has, and the sum of their rounded sentiments."""

    kinds = "edge_count bigint, total bigint"
    named = ()

    def __init__(self, names: pa.Array):
        super().__init__(names)
        self.sums = [0, 0]

    def add(self, key: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        self.sums = [self.sums[0] + len(key), self.sums[1] + int(_rounded(total, weight).sum())]

    def end(self) -> list | None:
        return [[x] for x in self.sums] if self.sums[0] else None


class _Lengths(_Totals):
    """How many edges a cell has, and the characters of their lines in a GraphML document (`writers.graphml_lines`) but for what all lines have."""

    kinds = "edge_count bigint, n_chars bigint"

    def __init__(self, names: pa.Array):
        super().__init__(names)
        self.told = self.name_lengths(names)

    def name_lengths(self, names: pa.Array) -> np.ndarray:
        """Of whole numbers, which have nothing to escape."""
        return pc.utf8_length(names.cast(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, key: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        a, b = np.divmod(key, max(len(self.names), 1))
        sentiment = _rounded(total, weight)
        size = np.abs(sentiment)
        decimals = 4 - (size % 10 == 0).astype(np.int64) - (size % 100 == 0) - (size % 1000 == 0)
        signs = np.where(sentiment > BOUND, len("positive"), np.where(sentiment < -BOUND, len("negative"), len("neutral")))
        chars = self.told[a].sum() + self.told[b].sum() + _digits(weight).sum() + _digits(size // TICKS).sum() + decimals.sum() + (sentiment < 0).sum() + signs.sum()
        self.sums = [self.sums[0] + len(key), self.sums[1] + int(chars)]


def _digits(x: np.ndarray) -> np.ndarray:
    """Digits of whole numbers from 0 on."""
    return 1 + np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), x, side="right")


class _EdgeLines(_Folded):
    """The lines of the edges of one weight from one name to later ones, in one text; the lines of a chapter's edge list in order are these texts by weight and name."""

    kinds = "heavy bigint, text string"
    named, whole = ("a",), True

    def __init__(self, names: pa.Array):
        super().__init__(names)
        self.told = names.cast(pa.string())

    def add(self, key: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list | None:
        a, b = np.divmod(key, max(len(self.names), 1))
        order = np.lexsort((-weight, a))
        a, b, weight, sentiment = a[order], b[order], weight[order], _rounded(total, weight)[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (weight[1:] != weight[:-1])])[: len(a)])
        return [self.names.take(pa.array(a[first])), -weight[first], self.joined(self.lines(a, b, weight, sentiment), first, "\n")]

    def lines(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray, sentiment: np.ndarray) -> pa.Array:
        signs = pa.array([f", polarity={x}" for x in ("negative", "neutral", "positive")]).take(pa.array(1 + (sentiment > BOUND).astype(int) - (sentiment < -BOUND)))
        return pc.binary_join_element_wise(self.told.take(pa.array(a)), "--", self.told.take(pa.array(b)), _texts(weight, lambda w: f": weight={w:.4g}"), signs, "")

    def joined(self, lines: pa.Array, first: np.ndarray, between: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(lines)), pa.int32()), lines), between)


class _NodeLines(_EdgeLines):
    """The line of each name in its chapter's adjacency list: its neighbours, heaviest first (ties by name)."""

    kinds = "text string"
    mirrored = True

    def add(self, key: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list | None:
        a, b = np.divmod(key, max(len(self.names), 1))
        order = np.lexsort((-weight, a))
        a, b, weight, sentiment = a[order], b[order], weight[order], _rounded(total, weight)[order]
        told, tenths = self.told, (np.abs(sentiment) + TICKS // 20) // (TICKS // 10)
        signs = pa.array(["(-", "(+"]).take(pa.array((sentiment >= 0).astype(int)))
        each = pc.binary_join_element_wise(told.take(pa.array(b)), signs, _texts(tenths, lambda t: f"{t // 10}.{t % 10},w="), _texts(weight, str), ")", "")
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
        return [self.names.take(pa.array(a[first])), pc.binary_join_element_wise(told.take(pa.array(a[first])), self.joined(each, first, ", "), ": ")]


class _EdgeText(_EdgeLines):
    """`snapshot.edge_list` of a whole chapter. Its lines are held packed, those of a weight together, until all are there; pairs come by names, so lines of one weight do too."""

    kinds = "snapshot string"
    named, alone = (), True

    def __init__(self, names: pa.Array):
        super().__init__(names)
        self.held: dict[int, list[tuple[int, pa.Buffer]]] = {}

    def add(self, key: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        order = np.argsort(-weight, kind="stable")
        a, b = np.divmod(key[order], max(len(self.names), 1))
        weight, sentiment = weight[order], _rounded(total, weight)[order]
        first = np.flatnonzero(np.concatenate([[True], weight[1:] != weight[:-1]])[: len(a)])
        for heavy, text in zip((-weight[first]).tolist(), self.joined(self.lines(a, b, weight, sentiment), first, "\n"), strict=True):
            self.hold(heavy, text.as_buffer())

    def hold(self, place: int, text: pa.Buffer) -> None:
        self.held.setdefault(place, []).append((text.size, PACKED.compress(text)))

    def end(self) -> list | None:
        """One text, made in the memory that it leaves in; what is packed goes as it is told. A text has less than 2^31 bytes; a longer one fails."""
        size = sum(n + 1 for x in self.held.values() for n, _ in x) - 1
        if size < 0:
            return None
        if size >= 1 << 31:
            raise ValueError(f"a snapshot of {size} bytes is more than one string can hold")
        told, at = pa.allocate_buffer(size), 0
        into = np.frombuffer(told, dtype=np.uint8)
        for place in sorted(self.held):
            for n, packed in self.held.pop(place):
                if at:
                    into[at] = 10
                    at += 1
                into[at : at + n] = np.frombuffer(PACKED.decompress(packed, n), dtype=np.uint8)
                at += n
        return [pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, size], dtype=np.int32)), told)]


class _NodeText(_EdgeText, _NodeLines):
    """`snapshot.flat` of a whole chapter; names come in order, so their lines do."""

    mirrored = True

    def add(self, *sums: np.ndarray) -> None:
        lines = _NodeLines.add(self, *sums)[1]
        if len(lines):
            self.hold(0, self.joined(lines, np.zeros(1, dtype=np.int64), "\n")[0].as_buffer())


class _SideCounts(_Totals):
    """How many pairs of a cell both sides have, and how many the first and the second."""

    kinds = "both bigint, n_pred bigint, n_gold bigint"

    def __init__(self, names: pa.Array):
        super().__init__(names)
        self.sums = [0, 0, 0]

    def add(self, key: np.ndarray, p: np.ndarray, g: np.ndarray) -> None:
        self.sums = [x + int(y.sum()) for x, y in zip(self.sums, (p & g, p, g), strict=True)]

    def end(self) -> list | None:
        return [[x] for x in self.sums] if any(self.sums) else None


def _in_cells(covered: DataFrame, half: int, min_freq: int, extra: list[str], folded: type[_Folded]) -> DataFrame:
    """book_id, chapter [, a, b] and the columns of ``folded``: the pairs of the rows of `covers`, made and counted in the task that holds their chapter's cell.

    Names are dealt to ``parts``, and a pair's parts are its cell. Mentions, not pairs, are exchanged: each goes to the cells of its part. A task
    holds the mentions of one cell at a time, and the pairs of a run of its names. ``extra``: low and high (scores), listed (only pairs of which one is a name of such a row, which covers nothing itself), second (the sides are compared).
    """
    n = FINER * int(covered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if folded.alone:
        covered = covered.withColumn("parts", F.lit(1))
    elif folded.whole:  # about as many cells
        covered = covered.withColumn("parts", F.least(F.ceil(F.col("parts") * F.col("parts") / 2), F.lit(MOST_PARTS)).cast("int"))
    part = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j * MOST_PARTS + j) if folded.whole else F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("part", j) * MOST_PARTS + F.greatest("part", j))
    columns = ["pos", "lo", "hi", "part", *extra]
    dealt = covered.withColumn("part", part).select(*KEYS, "name", *columns, F.explode(cells).alias("cell")).repartition(n, *KEYS, "cell").sortWithinPartitions(*KEYS, "cell")
    of = {f.name: f.dataType.simpleString() for f in dealt.schema}
    ends = "".join(f"{x} {of['name']}, " for x in folded.named)
    schema, at_once = f"book_id {of['book_id']}, chapter {of['chapter']}, {ends}{folded.kinds}", AT_ONCE

    def pairs_in(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = rows["name"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(names.dictionary)
        values, rank = names.dictionary.take(order), np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        c = {x: rows[x].to_numpy() for x in columns} | {"code": rank[names.indices.to_numpy()]}
        cell, chosen = rows["cell"][0].as_py(), [np.ones(len(rows), dtype=bool)]
        if "listed" in c:
            chosen, c["marked"] = [~c["listed"]], np.isin(c["code"], c["code"][c["listed"]])
        if "second" in c:
            chosen = [~c["second"], c["second"]]
        sides = [_Met({x: y[side] for x, y in c.items()}, cell, half, len(values), folded.mirrored) for side in chosen]
        same, fold = [rows[k][0] for k in KEYS], folded(values)

        def batch(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.repeat(k, len(found[0])) for k in same), *(x if isinstance(x, pa.Array) else pa.array(x) for x in found)], names=[x.split()[0] for x in schema.split(", ")])

        if hasattr(fold, "meet"):
            yield batch(fold.meet(sides, min_freq, at_once))
            return
        for begin, stop in _blocks(sides, len(values), at_once):
            found = []
            for side in sides:
                key, *sums = side.pairs(begin, stop, at_once)
                often = sums[0] >= min_freq
                found.append((key[often], *(x[often] for x in sums)))
            if len(sides) == 2:
                found = [_sides(found[0][0], found[1][0])]
            if (out := fold.add(*found[0])) is not None:
                yield batch(out)
        if (out := fold.end()) is not None:
            yield batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            new = np.zeros(len(rows), dtype=bool)
            for k in (*KEYS, "cell"):
                new[1:] |= pc.not_equal(rows[k][1:], rows[k][:-1]).to_numpy()
                new[0] |= bool(held) and held[-1][k][-1] != rows[k][0]
            starts = np.flatnonzero(new).tolist()
            for start, stop in zip([0, *starts], [*starts, len(rows)], strict=True):
                if start in starts[:1] and held or start in starts[1:]:
                    yield from pairs_in(pa.concat_tables(held))
                    held = []
                if stop > start:
                    held.append(rows[start:stop])
        if held:
            yield from pairs_in(pa.concat_tables(held))

    return dealt.mapInArrow(run, schema)


def compared(predicted: DataFrame, gold: DataFrame, half: int, min_freq: int = 3, counted: bool = False) -> DataFrame:
    """book_id, chapter, a, b, p, g: the edges of two tables of mentions, with whether they are of the first and of the second.

    Both go to the same cells, so edges meet where they are made and only mentions are exchanged. ``counted``: book_id, chapter, both, n_pred, n_gold
    instead, for chapters with edges; only counts leave a cell.
    """
    both = _spans(predicted, half).withColumn("second", F.lit(False)).unionByName(_spans(gold, half).withColumn("second", F.lit(True)))
    most = parts_of(predicted, half).unionByName(parts_of(gold, half)).groupBy(*KEYS).agg(F.max("parts").alias("parts"))
    found = _in_cells(both.join(F.broadcast(most), KEYS), half, min_freq, ["second"], _SideCounts if counted else _Compared)
    return found.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("both", "n_pred", "n_gold")]) if counted else found


def met_whole(first: DataFrame, second: DataFrame, half: int, min_freq: int, folded: type[_Folded]) -> DataFrame:
    """book_id, chapter and the columns of ``folded``, whose ``meet`` takes a chapter's mentions of both tables at once."""
    both = _spans(first, half).withColumn("second", F.lit(False)).unionByName(_spans(second, half).withColumn("second", F.lit(True)))
    return _in_cells(both, half, min_freq, ["second"], folded)


def edge_counts(mentions: DataFrame, half: int, min_freq: int, scores: DataFrame | str) -> DataFrame:
    """book_id, chapter, edge_count, total (of the rounded sentiments) of the chapters that `edges` has edges of; only these sums leave a cell."""
    return _in_cells(covers(mentions, half, scores), half, min_freq, ["low", "high"], _Totals).groupBy(*KEYS).agg(F.sum("edge_count").alias("edge_count"), F.sum("total").alias("total"))


def graphml_lengths(mentions: DataFrame, half: int, min_freq: int, scores: DataFrame | str) -> DataFrame:
    """book_id, chapter, edge_count, n_chars: how many edges a chapter has, and the characters of their names, weights, sentiments and polarities as GraphML tells them. Names are whole numbers; only these sums leave a cell."""
    if mentions.schema["name"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("names of lengths counted in cells are whole numbers")
    return _in_cells(covers(mentions, half, scores), half, min_freq, ["low", "high"], _Lengths).groupBy(*KEYS).agg(F.sum("edge_count").alias("edge_count"), F.sum("n_chars").alias("n_chars"))


def edge_lines(mentions: DataFrame, half: int, min_freq: int, scores: DataFrame | str) -> DataFrame:
    """book_id, chapter, a, heavy, text: the lines of `snapshot.edge_list` of each name and weight; a chapter's list are its texts by heavy and a.

    Every mention of a chapter goes to all its cells, and a cell has all pairs of its part's names with later ones.
    """
    return _in_cells(covers(mentions, half, scores), half, min_freq, ["low", "high"], _EdgeLines)


def node_lines(mentions: DataFrame, half: int, min_freq: int, scores: DataFrame | str) -> DataFrame:
    """book_id, chapter, a, text: the lines of `snapshot.flat`; a chapter's list are its texts by a. Cells as in `edge_lines`, but a pair is met from both its ends."""
    return _in_cells(covers(mentions, half, scores), half, min_freq, ["low", "high"], _NodeLines)


def edge_texts(mentions: DataFrame, half: int, min_freq: int, scores: DataFrame | str) -> DataFrame:
    """book_id, chapter, snapshot: `snapshot.edge_list` of a chapter's edges. A chapter is one task, as its text is one string; its mentions are all that is exchanged."""
    return _in_cells(_spans(mentions, half, scores), half, min_freq, ["low", "high"], _EdgeText)


def node_texts(mentions: DataFrame, half: int, min_freq: int, scores: DataFrame | str) -> DataFrame:
    """book_id, chapter, snapshot: `snapshot.flat` of a chapter's edges, as in `edge_texts`."""
    return _in_cells(_spans(mentions, half, scores), half, min_freq, ["low", "high"], _NodeText)


def edges(mentions: DataFrame, half: int, min_freq: int = 3, lengths: DataFrame | None = None, scores: Scores = None, raw: bool = False, among: DataFrame | None = None, heaviest: int | None = None) -> DataFrame:
    """book_id, chapter, a, b, weight [, sentiment_e4 [, raw_scores]]: pairs seen at ``min_freq`` centres or more.

    ``among``: book_id, chapter, name; only pairs of which at least one is there. ``scores`` may also name a column of the mentions: a position's score is its least.
    ``heaviest``: with such scores, only some edges, among them so many of the heaviest of each chapter (ties by names).
    """
    if isinstance(scores, str) and raw:
        scores = mentions.groupBy(*KEYS, "pos").agg(F.min(scores).alias("score_e4"))
    if callable(scores) or raw:
        events = pair_events(mentions, half, lengths, scores)
        aggs = [F.count("*").alias("weight"), F.sum("score_e4").alias("total"), *([F.collect_list("score_e4").alias("raw_scores")] if raw else [])]
        found = events.groupBy(*KEYS, "a", "b").agg(*(aggs if scores is not None else aggs[:1])).filter(F.col("weight") >= min_freq)
        if among is not None:
            cast = among.select(*KEYS, "name").distinct()
            ends = found.withColumn("name", F.explode(F.array("a", "b"))).join(cast, [*KEYS, "name"], "left_semi").drop("name")
            found = ends.dropDuplicates([*KEYS, "a", "b"])
    else:
        placed = in_range(mentions, lengths)
        covered = _spans(placed, half, scores)
        extra = ["low", "high"] if scores is not None else []
        if among is not None:  # who is there is told in each cell by rows that cover nothing
            none = [F.lit(0).cast("bigint").alias(c) for c in ("pos", "lo", "hi", *extra)]
            covered = covered.withColumn("listed", F.lit(False)).unionByName(among.select(*KEYS, "name", *none, F.lit(True).alias("listed")).filter("name IS NOT NULL"))
            extra = [*extra, "listed"]
        covered = covered.join(F.broadcast(parts_of(placed, half)), KEYS)
        folded = _Scored if scores is not None else _Folded
        if heaviest is not None:
            folded = type("_Heaviest", (_Heaviest,), {"most": heaviest})
        found = _in_cells(covered, half, min_freq, extra, folded)
    if scores is None:
        return found
    return found.withColumn("sentiment_e4", round_div(F.col("total"), F.col("weight"))).drop("total")


def bag_edges(mentions: DataFrame, min_freq: int = 1) -> DataFrame:
    """The case of half = 0: names at the same position. No window is needed."""
    found = dealt(mentions.select(*KEYS, "pos", "name"), *KEYS, "pos").groupBy(*KEYS, "pos", "h").agg(F.array_sort(F.collect_set("name")).alias("cast")).filter(F.size("cast") >= 2)
    pairs = dealt(found.select(*KEYS, F.explode(pairs_of(F.col("cast"))).alias("p")).select(*KEYS, "p.a", "p.b"), *KEYS, "a", "b")
    return pairs.groupBy(*KEYS, "a", "b", "h").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_freq).drop("h")
