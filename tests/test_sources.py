import json


from inkgraph.operators import graph
from inkgraph.plans import cli
from inkgraph.sources import annotate, readers, writers
from inkgraph.streaming import decay_stream

TEXT = "Ann met Tom . Ann saw Tom and Eve here today . Tom liked Eve very much ."


def files(tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"my_book_ch{k:02d}.txt").write_text(TEXT)
        rows = ["COREF\tstart_token\tend_token\ttext\tentity_type"]
        for i, word in enumerate(TEXT.split()):
            if word in ("Ann", "Tom", "Eve") and not (k == 3 and word == "Eve"):
                rows.append(f"{('Ann', 'Tom', 'Eve').index(word)}\t{i}\t{i}\t{word}\tPER")
        rows += ["x\t1\t1\tbad\tPER", "", "1\t2"]
        (tmp_path / f"my_book_ch{k:02d}.entities").write_text("\n".join(rows))
        (tmp_path / f"my_book_ch{k:02d}.tokens").write_text("\n".join(["token_id\ttoken\tPOS", *(f"{9 - i}\t{w}\tX" for i, w in enumerate(['"', "b", "c"])), "", "5"]))


def test_readers(spark, tmp_path):
    files(tmp_path)
    chapters = readers.read_chapters(spark, str(tmp_path / "*.txt"))
    assert {(r.book_id, r.chapter) for r in chapters.collect()} == {("my_book", 1), ("my_book", 2), ("my_book", 3)}
    tokens = readers.read_tokens(spark, str(tmp_path / "*.tokens")).filter("chapter = 1").first()
    assert tokens.tokens == ['"', "b", "c"]
    ents = readers.read_entities(spark, str(tmp_path / "*.entities"))
    assert ents.filter("chapter = 1").count() == 7
    assert ents.filter("text = 'bad'").isEmpty()


def test_line_ends_are_translated(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"Chapter 1\r\nx\ry\n")
    assert readers.read_books(spark, str(tmp_path / "b.txt")).first().text == "Chapter 1\nx\ny\n"


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("b", 1, "A & <B>", 2), ("b", 1, 'C "q"', 1)], "book_id string, chapter int, name string, mention_count long")
    edges = graph.plain_edges(spark.createDataFrame([("b", 1, "A & <B>", 'C "q"', 3, 1234)], "book_id string, chapter int, a string, b string, weight long, sentiment_e4 long"))
    xml = writers.graphml_documents(nodes, edges).first().xml
    (tmp_path / "b_ch01.graphml").write_text(xml)
    n, e = readers.read_graphml(spark, str(tmp_path / "*.graphml"))
    assert {(r.stem, r.name, r.mention_count) for r in n.collect()} == {("b_ch01", "A & <B>", 2), ("b_ch01", 'C "q"', 1)}
    row = e.first()
    assert (row.a, row.b, row.weight, row.sentiment, row.polarity, row.label, row.is_carry) == ("A & <B>", 'C "q"', 3.0, 0.1234, "positive", "co-occurrence", None)


def test_cached_annotations_are_kept(spark):
    chapters = spark.createDataFrame([("b", 1, TEXT), ("b", 2, TEXT)], "book_id string, chapter int, text string")
    cached = spark.createDataFrame([("b", 1, 0, 0, 0, 0, "Old", "PER")], "book_id string, chapter int, line_no int, coref int, start int, end int, text string, etype string")
    forms = spark.createDataFrame([("Ann", 1), ("Tom", 2)], "form string, coref int")
    got = annotate.annotate_missing(chapters, cached, annotate.Dictionary(forms))
    assert got.filter("chapter = 1").count() == 1
    assert got.filter("chapter = 2").count() == 5


def test_command_line(spark, tmp_path):
    files(tmp_path)
    base = ["--chapters", str(tmp_path / "*.txt"), "--entities", str(tmp_path / "*.entities"), "--window", "10", "--min_freq", "1"]
    assert cli.main(["plain", *base, "--out", str(tmp_path / "plain")]) == 0
    rows = [json.loads(x) for f in (tmp_path / "plain/summary").glob("*.json") for x in f.read_text().splitlines()]
    assert {r["chapter"]: r["node_count"] for r in rows} == {1: 3, 2: 3, 3: 2}
    assert cli.main(["carried", *base, "--out", str(tmp_path / "carried")]) == 0
    rows = [json.loads(x) for f in (tmp_path / "carried/summary").glob("*.json") for x in f.read_text().splitlines()]
    assert {r["chapter"]: r["node_count"] for r in rows} == {1: 3, 2: 3, 3: 3}
    gold = tmp_path / "gold"
    gold.mkdir()
    for k in (1, 2, 3):
        (xml,) = [f.read_text() for f in (tmp_path / f"plain/graphs/book_id=my_book/chapter={k}").glob("*.txt")]
        (gold / f"my_book_ch{k:02d}.graphml").write_text(xml)
    assert cli.main(["plain", *base, "--out", str(tmp_path / "again"), "--gold", str(gold / "*.graphml"), "--evaluate"]) == 0
    rows = [json.loads(x) for f in (tmp_path / "again/evaluation").glob("*.json") for x in f.read_text().splitlines()]
    assert len(rows) == 3
    assert all(r["f1_e4"] == r["jaccard_e4"] == r["agreement_e4"] == 10_000 and r["ged"] == 0 for r in rows)
    assert cli.main(["sweep", *base, "--out", str(tmp_path / "sweep"), "--gold", str(gold / "*.graphml")]) == 0
    assert spark.read.json(str(tmp_path / "sweep/sweep")).count() == 4
    assert cli.main(["carried", *base, "--out", "x", "--alpha", "1.5"]) == 1


def test_streamed_decay_equals_the_fold(spark, tmp_path):
    from inkgraph.operators import decay

    obs = [(1, 1, 2, 10, 5000), (1, 3, 4, 1, 0), (2, 1, 2, 4, -5000), (4, 3, 4, 6, 100)]
    schema = "k int, a long, b long, weight long, sentiment_e4 long"
    for k in (1, 2, 3, 4):
        spark.createDataFrame([r for r in obs if r[0] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = decay_stream.run(spark, stream, str(tmp_path / "out"))
    query.processAllAvailable()
    query.stop()
    edges = spark.createDataFrame([("b", k, a, b, w, s) for k, a, b, w, s in obs], "book_id string, chapter int, a long, b long, weight long, sentiment_e4 long")
    chapters = spark.createDataFrame([("b", k) for k in range(1, 5)], "book_id string, chapter int")
    want = {(r.k, r.a, r.weight_e4, r.sentiment_e4) for r in decay.decayed(edges, chapters).collect()}
    got = set()
    for k in range(4):
        got |= {(r.k, r.a, r.weight_e4, r.sentiment_e4) for r in spark.read.parquet(str(tmp_path / f"out/state-{k}")).collect()}
    assert got == want


def test_graphml_lines_make_the_documents(spark):
    """Before, a document was made in one task and one row; a graph of more edges than a text can hold could not be."""
    from pyspark.sql import functions as F

    from inkgraph.sources import writers

    names = ["plain", "a&b <c>", "it's", 'say "so"', "both ' and \"", "tab\tnew\nline", "é"]
    nodes = spark.createDataFrame([("b<k", c, n, i + c) for c in (1, 2) for i, n in enumerate(names)] + [("b<k", 3, "alone", 1)], "book_id string, chapter int, name string, mention_count long")
    worth = [(10_000, 0), (25_000, -1), (123_450_000, 9_999), (1, -12_345), (70_000, 500), (30_500, 10_000)]
    made = [("b<k", c, a, b, w, s, "neutral", "co-occurrence", flag) for c, flag in ((1, None), (2, True), (4, False)) for a, b, (w, s) in zip(names, names[1:], worth, strict=False)]
    edges = spark.createDataFrame(made, "book_id string, chapter int, a string, b string, weight_e4 long, sentiment_e4 long, polarity string, label string, is_carry boolean")
    want = {r.chapter: r.xml for r in writers.graphml_documents(nodes, edges).collect()}
    lines = writers.graphml_lines(nodes, edges)
    got = {}
    for r in sorted(lines.collect(), key=lambda r: (r.chapter, r.place, r.a or "", r.b or "")):
        got.setdefault(r.chapter, []).append(r.line)
    assert {c: "\n".join(x) for c, x in got.items() if c != 4} == want
    assert {r.chapter: r.n_chars for r in writers.graphml_sizes(lines).collect()} == {c: len(x) for c, x in want.items()}
    assert "MapInPandas" not in lines.agg(F.count("line"))._jdf.queryExecution().executedPlan().toString()
