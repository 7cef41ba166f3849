"""Mixing sources to target weights by Poisson replication.

A source with target weight w should fill the share w of the mix. Its mean
repetition rate is ``budget * w / size``; each document draws a hash-seeded uniform
number, inverts the Poisson distribution of that mean, and is repeated so many
times. The copies are then put in one global order given by a hash.

The draw depends on the seed and ``doc_id`` alone, so lost tasks redo the same
draw and a rerun gives the same mix.

Defined results: a null source is a source of its own (named '' in `rates`); a
source of weight 0 or absent from explicit weights is left out; rows that repeat
a doc_id draw the same number; a null doc_id draws as the text 'null'; an empty table gives no
rows. Null and empty texts have size 0 and are still drawn. A source of size 0
has rate 0. Very long texts count in full. A small source of great weight repeats as often as its rate asks, up
to a mean of 10^9 (`MAX_RATE`); above that the run stops and says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import free_names, partitions, table

#: Sources up to which the rates are broadcast; with more they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Copies of a document that are counted out at once; a row never holds an array of more.
BLOCK = 65_536
#: Mean repetition rate above which a run stops: nobody mixes a document a billion times, and copies are counted in an int.
MAX_RATE = 1e9


def uniform(key: Column, seed: str) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, budget: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """mix_source, rate: target repetitions of a document of each source.

    Sizes are characters over all rows, partially aggregated before the shuffle. Without
    explicit weights the target share is the source's own size to the power ``temperature``.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("size"))
    if weights is None:
        want = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(F.lit(0.0))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        want = F.when(F.col("size") > 0, F.coalesce(given[F.col("mix_source")].cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    wanted = sizes.withColumn("want", want)
    total = wanted.agg(F.sum("size").alias("all_size"), F.sum("want").alias("all_want"))
    share = F.when(F.col("want") > 0, F.lit(budget) * F.col("all_size") * F.col("want") / F.col("all_want") / F.col("size")).otherwise(F.lit(0.0))
    return wanted.join(F.broadcast(total), F.lit(True)).select("mix_source", share.alias("rate"))  # one row


def poisson_quantile(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u, of a Poisson distribution: how often a document is repeated.

    Probabilities are summed one by one from 12 standard deviations below the mean (what lies before is less than 1e-30) to as many above
    it; nothing is kept but the sum, so a rate of a million takes some 24,000 steps. The first is a logarithm, by Stirling's series where it does not start at 0.
    """
    reach = 12 * F.sqrt(rate) + 30
    low, high = F.greatest(F.floor(rate - reach), F.lit(0)).cast("bigint"), F.ceil(rate + reach).cast("bigint")
    first = F.when(low == 0, -rate).otherwise(low * F.log1p((rate - low) / low) - (rate - low) - F.log(2 * math.pi * low) / 2 - 1 / (12 * low))
    start = F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("total"), low.alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log_p = F.when(k == low, first).otherwise(acc["log_p"] + F.log(rate / k))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), (acc["n"] + (total <= u).cast("bigint")).alias("n"))

    counted = F.aggregate(F.sequence(low, high), start, step, lambda acc: acc["n"])
    return F.when(rate > MAX_RATE, F.raise_error(F.concat(F.lit("a mean repetition rate above 10^9: "), rate.cast("string"))).cast("bigint")).when(rate > 0, counted).otherwise(F.lit(0).cast("bigint"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, budget: float = 1.0, seed: str = "mix-1", source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with columns mix_copy (from 0), mix_copies and mix_key added; one row for each copy.

    Input columns of these names stay as they are; the added ones then get an underscore more. Rows come in
    global order of mix_key, hash-random over all sources. The rates have a row for each source: they are broadcast
    after their number has been checked, and joined by a shuffle that adaptive execution can split where there
    are too many. Keys are uniform hexadecimal numbers, so the cuts of the global order are known without sampling.
    """
    spark = docs.sparkSession
    copy, copies, name = free_names(docs.columns, "mix_copy", "mix_copies", "mix_key")
    rate = rates(docs, weights, temperature, budget, source, text).select("mix_source", F.col("rate").alias("mix_rate"))
    few = docs.select(source).distinct().count() <= BROADCAST_SOURCES
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), F.col(key).alias("mix_doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source"))
    drawn = (
        held.join(F.broadcast(rate) if few else rate, "mix_source")
        .withColumn("mix_u", uniform(F.col("mix_doc"), seed))
        .withColumn("mix_copies", poisson_quantile(F.col("mix_rate"), F.col("mix_u")).cast("int"))
        .filter("mix_copies > 0")
        .select("mix_row", "mix_doc", "mix_copies", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1, F.lit(BLOCK))).alias("mix_from"))
        .select("mix_row", "mix_doc", "mix_copies", F.explode(F.sequence("mix_from", F.least(F.col("mix_from") + (BLOCK - 1), F.col("mix_copies") - 1))).alias("mix_copy"))
    )
    called = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("mix_doc").cast("string"), F.lit("null")), F.col("mix_copy").cast("string"))
    keyed = drawn.withColumn("mix_key", F.substring(F.md5(called), 1, 16))
    n = partitions(spark)
    part = (F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("bigint") * n / F.lit(1 << 32)).cast("int")
    ordered = keyed.repartitionById(n, part).sortWithinPartitions("mix_key", "mix_doc")
    return ordered.select("mix_row.*", F.col("mix_copy").alias(copy), F.col("mix_copies").alias(copies), F.col("mix_key").alias(name))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", F.col("mix_copies").alias("n_copies"), F.col("mix_copy").alias("copy"), "mix_key", "text")


ORACLE_OP4 = """
WITH sizes AS (SELECT coalesce(source, '') AS s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1),
wanted AS (SELECT s, size, CASE WHEN size > 0 THEN pow(size, 0.7) ELSE 0 END AS want FROM sizes),
rates AS (SELECT s, CASE WHEN want > 0 THEN 1.0::DOUBLE * (SELECT sum(size) FROM wanted) * want / (SELECT sum(want) FROM wanted) / size ELSE 0 END AS rate FROM wanted),
terms AS (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(400) r(k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 30)),
cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, source, text, coalesce(source, '') AS s, CAST(CAST('0x' || substr(md5('mix-1:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM documents),
counted AS (SELECT doc_id, source, text, (SELECT count(*) FROM cdf WHERE cdf.s = drawn.s AND c <= u) AS n FROM drawn)
SELECT doc_id, source, CAST(n AS INT) AS n_copies, CAST(copy AS INT) AS copy, substr(md5('mix-1:' || doc_id || ':' || copy), 1, 16) AS mix_key, text
FROM (SELECT *, unnest(range(n)) AS copy FROM counted WHERE n > 0)
"""
