"""Books, chapters, annotation tables and gold graphs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.functions import text as T

ENTITY_SCHEMA = "coref int, start int, end int, text string, etype string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "").alias("stem"), T.unix_lines(F.col("value")).alias("text"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the file's stem), text; bytes that are no UTF-8 are replaced."""
    return _files(spark, path).withColumnRenamed("stem", "book_id")


def split_chapters(books: DataFrame) -> DataFrame:
    """book_id, chapter, text: from each heading to the next, the last to the end, stripped.

    What stands before the first heading goes; chapters count headings from 1, and empty ones leave gaps. A book
    without headings has no chapters; `require_chapters` makes that an error.
    """
    parts = books.select("book_id", F.posexplode(T.chapter_parts(F.col("text"))).alias("chapter", "part"))
    return parts.filter("chapter > 0").select("book_id", "chapter", T.strip(F.col("part")).alias("text")).filter("text <> ''")


def require_chapters(books: DataFrame) -> DataFrame:
    """``books``, failing at run time on one that has no heading."""
    none = F.size(T.chapter_parts(F.col("text"))) < 2
    return books.withColumn("text", F.when(none, F.raise_error(F.concat(F.lit("no chapter headings in "), "book_id"))).otherwise(F.col("text")))


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """book_id, chapter, text from files named ``{book_id}_ch{NN}``; other names are skipped."""
    named = _files(spark, path).withColumn("chapter", T.chapter_number(F.col("stem")))
    return named.filter("chapter is not null").select(F.regexp_replace("stem", r"_ch[^_]*$", "").alias("book_id"), "chapter", "text")


def _lines(files: DataFrame) -> DataFrame:
    named = files.withColumn("chapter", T.chapter_number(F.regexp_replace("stem", "$", ".x")))
    return named.select(F.regexp_replace("stem", r"_ch[^_]*$", "").alias("book_id"), "chapter", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def read_tokens(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    """book_id, chapter, tokens array<string>: field ``column`` of each row, in row order. Quotes mean nothing."""
    lines = _lines(_files(spark, path))
    fields = F.split("line", "\t", -1)
    good = lines.filter((T.strip(F.col("line")) != "") & ~F.col("line").startswith("token_id") & (F.size(fields) > column))
    rows = good.groupBy("book_id", "chapter").agg(F.sort_array(F.collect_list(F.struct("line_no", fields[column].alias("tok")))).alias("t"))
    return rows.select("book_id", "chapter", F.transform("t", lambda x: x["tok"]).alias("tokens"))


def read_entities(spark: SparkSession, path: str, order: tuple[int, int, int, int, int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """book_id, chapter, line_no, coref, start, end, text, etype; ``order`` says where each of the five fields stands."""
    lines = _lines(_files(spark, path))
    fields = F.split("line", "\t", -1)
    good = lines.filter((T.strip(F.col("line")) != "") & ~F.col("line").startswith("COREF") & (F.size(fields) >= 5))
    number = lambda i: F.trim(fields[order[i]]).try_cast("int")
    return good.select("book_id", "chapter", "line_no", number(0).alias("coref"), number(1).alias("start"), number(2).alias("end"), fields[order[3]].alias("text"), fields[order[4]].alias("etype")).filter("coref is not null and start is not null and end is not null")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files: stem, name, mention_count; stem, a, b, weight, sentiment, polarity, label, is_carry.

    Attributes are found by the names that the file's own keys give them. Missing files give empty tables
    where the path is a pattern.
    """
    data = "data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("stem", stem)
    keys = read("key", "_id STRING, `_attr.name` STRING, _for STRING").select("stem", F.col("_id").alias("key"), F.col("`_attr.name`").alias("attr"), F.col("_for").alias("domain"))

    def wide(rows: DataFrame, ids: list[str], domain: str, attrs: list[str]) -> DataFrame:
        each = rows.select("stem", *ids, F.explode_outer("data").alias("d")).select("stem", *ids, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        named = each.join(keys.filter(F.col("domain") == domain).select("stem", "key", "attr"), ["stem", "key"], "left")
        return named.groupBy("stem", *ids).agg(*[F.max(F.when(F.col("attr") == a, F.col("value"))).alias(a) for a in attrs])

    nodes = wide(read("node", f"_id STRING, {data}").withColumnRenamed("_id", "id"), ["id"], "node", ["mention_count"])
    edges = wide(read("edge", f"_source STRING, _target STRING, {data}").withColumnsRenamed({"_source": "source", "_target": "target"}), ["source", "target"], "edge", ["weight", "sentiment", "polarity", "label", "is_carry"])
    return (
        nodes.select("stem", F.col("id").alias("name"), F.coalesce(F.col("mention_count").cast("bigint"), F.lit(0)).alias("mention_count")),
        edges.select("stem", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("sentiment").cast("double"), F.lit(0.0)).alias("sentiment"), F.coalesce("polarity", F.lit("neutral")).alias("polarity"), "label", F.lower("is_carry").cast("boolean").alias("is_carry")),
    )
