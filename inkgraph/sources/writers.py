"""Graphs and records to files."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.functions.numbers import TICKS

NODE_KEYS = [("n0", "name", "string"), ("n1", "mention_count", "long")]
EDGE_KEYS = [("e0", "weight", "double"), ("e1", "sentiment", "double"), ("e2", "polarity", "string"), ("e3", "label", "string"), ("e4", "is_carry", "boolean")]


def graphml(header: dict, nodes: list[dict], edges: list[dict]) -> str:
    """One graph as a GraphML document."""
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    heads = [(f"g{i}", k, "string") for i, k in enumerate(header)]
    for domain, keys in (("graph", heads), ("node", NODE_KEYS), ("edge", EDGE_KEYS)):
        out += [f'  <key id="{i}" for="{domain}" attr.name="{n}" attr.type="{t}" />' for i, n, t in keys]
    out.append('  <graph edgedefault="undirected">')
    out += [f'    <data key="{i}">{escape(str(header[k]))}</data>' for i, k, _ in heads]

    def data(row: dict, keys: list) -> str:
        return "".join(f'<data key="{i}">{escape(str(row[n]))}</data>' for i, n, _ in keys if row.get(n) is not None)

    out += [f"    <node id={quoteattr(str(n['name']))}>{data(n, NODE_KEYS)}</node>" for n in nodes]
    out += [f"    <edge source={quoteattr(str(e['a']))} target={quoteattr(str(e['b']))}>{data(e, EDGE_KEYS)}</edge>" for e in edges]
    return "\n".join([*out, "  </graph>", "</graphml>"])


def graphml_documents(nodes: DataFrame, edges: DataFrame, keys: list[str] = ["book_id", "chapter"]) -> DataFrame:  # noqa: B006
    """keys, xml: a document for each graph. One graph is gathered on one task, as one file demands."""
    n = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("name").cast("string").alias("name"), "mention_count"))).alias("nodes"))
    one = F.struct(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), (F.col("weight_e4") / TICKS).alias("weight"), (F.col("sentiment_e4") / TICKS).alias("sentiment"), "polarity", "label", "is_carry")
    e = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("edges"))
    rows = n.join(e, keys, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda x: x if isinstance(x, dict) else x.asDict()
        for pdf in batches:
            texts = [graphml({k: getattr(r, k) for k in keys}, [plain(x) for x in r.nodes], [plain(x) for x in (r.edges if r.edges is not None else [])]) for r in pdf.itertuples(index=False)]
            yield pdf[keys].assign(xml=texts)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInPandas(run, f"{fields}, xml string")


def _escaped(value: Column, kind: str, pairs: list[tuple[str, str]]) -> Column:
    """As in `escape`; numbers have nothing to escape."""
    text = value.cast("string")
    for old, new in pairs if kind == "string" else []:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_TEXT = [("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")]


def _quoted(value: Column, kind: str) -> Column:
    """As in `quoteattr`."""
    text = _escaped(value, kind, [*_TEXT, ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")])
    double = F.concat(F.lit('"'), text, F.lit('"'))
    if kind != "string":
        return double
    single, all_double = F.concat(F.lit("'"), text, F.lit("'")), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(~F.contains(text, F.lit('"')), double).when(F.contains(text, F.lit("'")), all_double).otherwise(single)


def _decimal(ticks: Column) -> Column:
    """Ticks as the text of a number: whole part, point, and the decimals that it needs, one at least."""
    size = F.abs(ticks)
    four = F.lpad((size % TICKS).cast("string"), 4, "0")
    left = F.when(size % TICKS == 0, "0").when(size % 10 != 0, four).otherwise(F.rtrim(four, F.lit("0")))
    return F.concat(F.when(ticks < 0, "-").otherwise(""), ((size - size % TICKS) / TICKS).cast("bigint").cast("string"), F.lit("."), left)


def graphml_lines(nodes: DataFrame, edges: DataFrame, keys: list[str] = ["book_id", "chapter"]) -> DataFrame:  # noqa: B006
    """keys, place (0 head, 1 node, 2 edge, 3 foot), a, b, line: the lines of the documents of `graphml_documents`, in order of place, a, b; a head is several lines in one.

    No graph is gathered anywhere, so a graph may have more edges than one text can hold. Edges of a graph without nodes belong to no document: it has no head.
    """
    kind = dict(nodes.dtypes) | dict(edges.dtypes)
    none = F.lit(None).cast("string")

    def data(columns: list[tuple[str, Column]]) -> Column:
        return F.concat(*[F.coalesce(F.concat(F.lit(f'<data key="{i}">'), text, F.lit("</data>")), F.lit("")) for i, text in columns])

    top = graphml({}, [], []).split("  <graph ")[0].split("\n")
    declared = [f'  <key id="g{i}" for="graph" attr.name="{k}" attr.type="string" />' for i, k in enumerate(keys)]
    head = F.concat(F.lit("\n".join([*top[:2], *declared, *top[2:-1], '  <graph edgedefault="undirected">'])), *[F.concat(F.lit(f'\n    <data key="g{i}">'), _escaped(F.col(k), kind[k], _TEXT), F.lit("</data>")) for i, k in enumerate(keys)])
    of_node = data([("n0", _escaped(F.col("name"), kind["name"], _TEXT)), ("n1", F.col("mention_count").cast("string"))])
    node = F.concat(F.lit("    <node id="), _quoted(F.col("name"), kind["name"]), F.lit(">"), of_node, F.lit("</node>"))
    carry = F.when(F.col("is_carry"), "True").when(~F.col("is_carry"), "False")
    of_edge = data([("e0", _decimal(F.col("weight_e4"))), ("e1", _decimal(F.col("sentiment_e4"))), ("e2", _escaped(F.col("polarity"), "string", _TEXT)), ("e3", _escaped(F.col("label"), "string", _TEXT)), ("e4", carry)])
    edge = F.concat(F.lit("    <edge source="), _quoted(F.col("a"), kind["a"]), F.lit(" target="), _quoted(F.col("b"), kind["b"]), F.lit(">"), of_edge, F.lit("</edge>"))
    graphs = nodes.select(*keys).distinct()
    heads = graphs.select(*keys, F.lit(0).alias("place"), none.alias("a"), none.alias("b"), head.alias("line"))
    feet = graphs.select(*keys, F.lit(3).alias("place"), none.alias("a"), none.alias("b"), F.lit("  </graph>\n</graphml>").alias("line"))
    n = nodes.select(*keys, F.lit(1).alias("place"), F.col("name").cast("string").alias("a"), none.alias("b"), node.alias("line"))
    e = edges.select(*keys, F.lit(2).alias("place"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), edge.alias("line"))
    return heads.unionByName(n).unionByName(e).unionByName(feet)


def graphml_sizes(lines: DataFrame, keys: list[str] = ["book_id", "chapter"]) -> DataFrame:  # noqa: B006
    """keys, n_chars: characters of each document of `graphml_lines`."""
    sized = lines.groupBy(*keys).agg((F.sum(F.length("line") + 1) - 1).alias("n_chars"), F.count_if(F.col("place") == 0).alias("heads"))
    return sized.filter("heads > 0").drop("heads")


def graphml_sizes_of(nodes: DataFrame, counted: DataFrame, keys: list[str] = ["book_id", "chapter"]) -> DataFrame:  # noqa: B006
    """`graphml_sizes` of plain edges between whole numbers that are counted already (`cooccur.graphml_lengths`): what all edge lines have is told once a graph, by a line whose parts have one character each."""
    kind = dict(nodes.dtypes)
    given = nodes.sparkSession.range(1).select(*[F.lit(None).cast(kind[k]).alias(k) for k in keys], F.lit("a").alias("a"), F.lit("b").alias("b"), F.lit(TICKS).cast("bigint").alias("weight_e4"), F.lit(0).cast("bigint").alias("sentiment_e4"), F.lit("").alias("polarity"), F.lit("co-occurrence").alias("label"), F.lit(None).cast("boolean").alias("is_carry"))
    none = given.limit(0)
    parts = len("a") + len("b") + len("1") + len("0") + len("0")
    one = graphml_lines(nodes, given, keys).filter("place = 2").agg((F.first(F.length("line")) + 1 - parts).alias("same"))
    rest = graphml_sizes(graphml_lines(nodes, none, keys), keys)
    n = F.coalesce(F.col("edge_count") * F.col("same") + F.col("chars"), F.lit(0).cast("bigint"))
    return rest.join(counted.withColumnRenamed("n_chars", "chars"), keys, "left").crossJoin(F.broadcast(one)).select(*keys, (F.col("n_chars") + n).alias("n_chars"))


def write_graphml(documents: DataFrame, path: str, keys: list[str] = ["book_id", "chapter"]) -> None:  # noqa: B006
    """A folder for each graph with one file in it, through Spark's committed writer."""
    documents.repartition(*keys).write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", 1).text(path)


def write_chapters(chapters: DataFrame, path: str) -> None:
    chapters.write.mode("overwrite").partitionBy("book_id").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, one record each; ``partitionBy`` alpha where there is one."""
    writer = records.write.mode("overwrite")
    (writer.partitionBy("alpha") if "alpha" in records.columns else writer).json(path)


def table_text(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Console table: one formatted line for each row; ``columns``: name -> printf format."""
    return rows.select(F.format_string(" ".join(columns.values()), *[F.col(c) for c in columns]).alias("line"))
