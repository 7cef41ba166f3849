"""Spelling variants: words one edit apart, by bands of a bitmask of letter parities.

A word's mask has a bit for each letter it holds an odd number of times. One inserted or deleted letter flips one bit,
one replaced letter flips two, so of the three bands of a mask at least one stays as it is: two, where a letter
came or went or was replaced by one of its own band; one, where it was replaced by a letter of another band. A band that stays has not
lost or gained a letter, so its letters stand in the same order too. Words are therefore dealt out by

- two equal bands (and the letters in them), with equal lengths or lengths one apart;
- one equal band (and its letters), equal lengths, and one letter more in one of the other bands;

and each pair one edit apart meets exactly once, in the rows of its own kind. The bits that differ outside the equal bands
are counted next, and what is left is verified by edit distance.

Only distinct words leave the tasks that read texts. A word's form has at least twice its occurrences, so chains of forms are no
longer than the logarithm of the largest count; they are followed by doubling.

Defined results: a null text has no words, an empty one none; a null doc_id counts as the text 'null'; very long texts are read whole and a
very long run is one word; rows that repeat count each; ties go to the least word in code-point order; an empty table gives no
rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import durable, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every letter a word may hold, the commonest first; dealt to the bands in turn, so that each has its share of common ones.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
BANDS = 3
#: Letters up to which the edit distance function, whose time grows with the square of the length, does the verification.
SHORT = 64
BAND_BITS = -(-len(LETTERS) // BANDS)


def occurrences(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the distinct words of ``docs`` with at least ``least`` occurrences.

    Maximal runs of letters, A-Z in lower case; a run whose checksum with its document ``every`` divides loses one letter (a planted misspelling).
    """
    runs = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("null")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(rf"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    run = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    named = runs.select(run.alias("run"), F.crc32(F.concat("doc", F.lit(":"), run).cast("binary")).alias("sum"))
    at = (F.col("sum") % F.length("run")).cast("int")
    word = F.when(F.col("sum") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return named.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def band_letters(word: Column, band: int) -> Column:
    """The letters of the band, in the word's order."""
    return F.translate(word, "".join(c for i, c in enumerate(LETTERS) if i % BANDS != band), "")


def parities(letters: Column) -> Column:
    """Bits of the letters of one band that occur an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor((F.call_function("instr", F.lit(LETTERS), c) - 1) / BANDS).cast("int"))
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether b, as long as a or one letter longer, is one edit from a: what follows the first difference is the same. In time almost linear."""
    grow = lambda p, k: p + F.when((p + k <= F.length(a)) & (F.substring(a, p + 1, k) == F.substring(b, p + 1, k)), k).otherwise(0)
    start = F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), grow)
    rest = lambda x, at: F.substring(x, at, F.length(x))
    ends = F.transform(F.array(start), lambda p: F.when(F.length(a) == F.length(b), (a != b) & (rest(a, p + 2) == rest(b, p + 2))).otherwise(rest(a, p + 1) == rest(b, p + 2)))
    return F.element_at(ends, 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each unordered pair of words one edit apart, once. ``words``: distinct word, n."""
    banded = words.select("word", "n", F.length("word").alias("size"), *[band_letters(F.col("word"), i).alias(f"s{i}") for i in range(BANDS)])
    banded = banded.select("*", *[parities(F.col(f"s{i}")).alias(f"m{i}") for i in range(BANDS)])

    def place(changed: int | None, kept: int | None, size: Column, more: Column | int) -> Column:
        """Equal for words that meet: which bands stay, their bits and letters, and how long the rest is."""
        stay = [i for i in range(BANDS) if i != changed] if kept is None else [kept]
        bits = F.col(f"m{stay[0]}") if len(stay) == 1 else F.call_function("shiftleft", F.col(f"m{stay[0]}"), F.lit(BAND_BITS)).bitwiseOR(F.col(f"m{stay[1]}"))
        rest = [i for i in range(BANDS) if i not in stay]
        change = lambda i: F.col(f"m{rest[i]}") if i < len(rest) else F.lit(0).cast("bigint")
        return F.struct(
            F.lit(changed if kept is None else BANDS + kept).cast("byte").alias("kind"), size.cast("int").alias("long"), (more if isinstance(more, Column) else F.lit(more)).cast("int").alias("more"),
            bits.alias("bits"), F.concat_ws(" ", *[F.col(f"s{i}") for i in stay]).alias("letters"), change(0).alias("first"), change(1).alias("second"),
        )

    size = F.col("size")
    other = lambda kept: F.length(f"s{min(i for i in range(BANDS) if i != kept)}")
    one = [place(i, None, size, 0) for i in range(BANDS)]
    left = one + [place(None, i, size, other(i)) for i in range(BANDS)]
    right = one + [place(i, None, size - 1, 0) for i in range(BANDS)] + [place(None, i, size, other(i) - 1) for i in range(BANDS)]
    keys = ["kind", "long", "more", "bits", "letters"]
    rows = lambda places, side: banded.select("word", "n", F.explode(F.array(*places)).alias("at")).select("at.*", F.col("word").alias(side), F.col("n").alias(f"n_{side}")).withColumnsRenamed({"first": f"first_{side}", "second": f"second_{side}"})
    flips = lambda part: F.bit_count(F.col(f"{part}_a").bitwiseXOR(F.col(f"{part}_b")))
    crossed = F.col("kind") >= BANDS
    longer = F.length("b") > F.length("a")
    bits = F.when(crossed, (flips("first") == 1) & (flips("second") == 1)).when(longer, flips("first") == 1).otherwise((F.col("a") < F.col("b")) & (flips("first") == 2))
    short = F.length("b") <= SHORT
    met = rows(left, "a").join(rows(right, "b"), keys).filter(bits & F.when(short, F.levenshtein("a", "b", 1) == 1).otherwise(True))
    pair = F.struct("a", "b", "n_a", "n_b")
    return met.select(F.explode(F.when(short | one_edit(F.col("a"), F.col("b")), F.array(pair))).alias("p")).select("p.*")


def forms(words: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: the form is the near word with most occurrences, if it has ``times`` the word's."""
    pairs = near_pairs(words)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.m") >= times * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root for the words that have a form: the last word that following forms leads to. Each round doubles the steps taken."""
    now = durable(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = durable(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with their occurrences."""
    formed = durable(forms(words, times))
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(stored(occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"))))


# The checksum over UTF-8 bytes by its table; near words by the forms with one letter left out or left open.
ORACLE_OP11 = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS t),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY 1, 2),
sums AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM runs, crc WHERE length(run) >= 5),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM sums) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gone AS (SELECT DISTINCT word, n, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM cuts),
open AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM cuts),
near AS (SELECT g.word, w.word AS other, w.n AS m FROM gone g JOIN words w ON g.rest = w.word UNION ALL SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word
  UNION ALL SELECT x.word, y.word, y.n FROM open x JOIN open y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word AND length(x.word) = length(y.word)),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
picked AS (SELECT word, min(other) AS other FROM near JOIN best USING (word, m) GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word) LEFT JOIN picked USING (word)),
chain AS (SELECT word, word AS root, form AS up FROM formed UNION ALL SELECT c.word, c.up, f.form FROM chain c JOIN formed f ON f.word = c.up)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE up IS NULL) USING (word)
"""
