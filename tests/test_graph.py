import itertools
import random
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from inkgraph.functions.numbers import TICKS
from inkgraph.operators import cooccur, decay, graph, mentions, metrics, snapshot, sweep
from inkgraph.plans import catalog

M = "book_id string, chapter int, name string, pos long"
E = "book_id string, chapter int, a string, b string, weight long, sentiment_e4 long"


def pairs(df):
    return {(r.a, r.b): r.weight for r in df.collect()}


def mention_rows(spark, rows, chapter=1):
    return spark.createDataFrame([("b", chapter, n, p) for n, p in rows], M)


G7 = [("A", 0), ("A", 2), ("B", 3), ("C", 7)]


def test_windows(spark):
    m = mention_rows(spark, G7)
    assert pairs(cooccur.edges(m, 5, 1)) == {("A", "B"): 4, ("A", "C"): 3, ("B", "C"): 3}
    assert pairs(cooccur.edges(m, 5, 4)) == {("A", "B"): 4}
    lengths = spark.createDataFrame([("b", 1, 7)], "book_id string, chapter int, n_tokens int")
    assert pairs(cooccur.edges(m, 5, 1, lengths=lengths)) == {("A", "B"): 3}


def test_windows_equal_brute_force_on_any_stretch(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ABCDEF"), rnd.randint(0, 400)) for _ in range(150)]
    for half in (0, 3, 11):
        want = {}
        for c in {p for _, p in rows}:
            cast = sorted({n for n, p in rows if abs(p - c) <= half})
            for i, a in enumerate(cast):
                for b in cast[i + 1 :]:
                    want[a, b] = want.get((a, b), 0) + 1
        m = mention_rows(spark, rows)
        assert pairs(cooccur.edges(m, half, 1)) == want
        for stretch in (1, 30, 1000):
            got = {}
            for r in cooccur.windows(m, half, stretch).collect():
                for i, a in enumerate(r.cast):
                    for b in r.cast[i + 1 :]:
                        got[a, b] = got.get((a, b), 0) + 1
            assert got == want
    assert pairs(cooccur.bag_edges(m)) == pairs(cooccur.edges(m, 0, 1))


def test_sentiment_is_scored_once_for_each_centre(spark):
    scores = spark.createDataFrame([("b", 1, 0, 1000), ("b", 1, 2, 2000), ("b", 1, 3, -500)], "book_id string, chapter int, pos long, score_e4 long")
    rows = {(r.a, r.b): (r.weight, r.sentiment_e4, sorted(r.raw_scores)) for r in cooccur.edges(mention_rows(spark, G7), 5, 1, scores=scores, raw=True).collect()}
    assert rows["A", "B"] == (4, 625, [-500, 0, 1000, 2000])


@pytest.mark.parametrize(
    ("forms", "name"),
    [("she Lizzy Eliza Eliza Lizzy she she".split(), "Lizzy"), (["he", "him", "he"], "he"), ([" ", ""], "UNKNOWN"), ([" Tom ", "Tom", "Ann"], "Tom"), (["", "it", ""], "it")],
)
def test_canonical_names(spark, forms, name):
    df = spark.createDataFrame([(1, f, i) for i, f in enumerate(forms)], "coref int, text string, line_no int")
    assert mentions.canonical_names(df, ["coref"]).first().name == name


def test_clusters_of_one_name_merge(spark):
    rows = [("b", 1, 0, 7, 5, 5, "Ann", "PER"), ("b", 1, 1, 8, 2, 2, "Ann", "person"), ("b", 1, 2, 8, 2, 2, "she", "PER"), ("b", 1, 3, 9, 4, 4, "Rome", "LOC"), ("b", 1, 4, 10, 0, 1, " ", "PER")]
    ents = spark.createDataFrame(rows, "book_id string, chapter int, line_no int, coref int, start int, end int, text string, etype string")
    tokens = spark.createDataFrame([("b", 1, ["old", "Tom", "x"])], "book_id string, chapter int, tokens array<string>")
    m = mentions.character_positions(mentions.fill_spans(ents, tokens))
    assert {r.name: r.positions for r in mentions.positions(m).collect()} == {"Ann": [2, 2, 5], "old Tom": [0]}
    assert {r.name: r.mention_count for r in mentions.mention_counts(m).collect()} == {"Ann": 3, "old Tom": 1}


def nearest(n, d):
    whole = (2 * abs(n) + d) // (2 * d)
    return -whole if n < 0 else whole


def folded(spark, seen, last, percent=70, least=0.5, whole=100):
    edges = spark.createDataFrame([("b", k, "A", "B", n, s) for k, (n, s) in seen.items()], E)
    chapters = spark.createDataFrame([("b", k) for k in range(1, last + 1)], "book_id string, chapter int")
    rows = decay.decayed(edges, chapters, [percent], least, whole=whole).orderBy("k").collect()
    return [(r.k, r.weight_e4, r.sentiment_e4, r.polarity, r.label, r.is_carry) for r in rows]


def test_fold_goldens(spark):
    fold = partial(folded, spark)
    assert fold({1: (10, 5000), 2: (4, -5000)}, 2)[1] == (2, 82_000, 2000, "positive", "co-occurrence-markov", False)
    assert fold({1: (10, 5000)}, 2)[1] == (2, 70_000, 3500, "positive", "co-occurrence-markov", True)
    assert fold({2: (3, 1000)}, 2) == [(2, 9_000, 300, "neutral", "co-occurrence-markov", False)]
    assert fold({2: (5, 0)}, 2, percent=100)[0][1] == 0
    assert fold({1: (5, 0)}, 1) == [(1, 50_000, 0, "neutral", "co-occurrence", None)]
    assert len(fold({2: (2, 0)}, 3)) == 1  # 0.6 -> 0.42 is pruned
    assert fold({2: (2, 0), 4: (2, 0)}, 4)[1][1] == 6_000  # born again from nothing


def test_fold_equals_a_loop_over_chapters(spark):
    rnd = random.Random(9)
    obs = {(k, p): (rnd.randint(1, 9), rnd.randint(-9999, 9999)) for k in range(1, 13) for p in "uvwxyz" if rnd.random() < 0.35}
    want, state = set(), {}
    for k in range(1, 13):
        new = {}
        for p in "uvwxyz":
            w, s = state.get(p, (0, 0))
            if (k, p) in obs:
                c, n = obs[k, p]
                new[p] = (c * TICKS, n) if k == 1 else (nearest(70 * w + 30 * c * TICKS, 100), nearest(70 * s + 30 * n, 100))
            elif p in state and 70 * w >= 500_000:
                new[p] = (nearest(70 * w, 100), nearest(70 * s, 100))
        state = new
        want |= {(k * 10, p, *v) for p, v in state.items()}
    edges = spark.createDataFrame([("b", k * 10, p, p + "z", c, s) for (k, p), (c, s) in obs.items()], E)
    chapters = spark.createDataFrame([("b", k * 10) for k in range(1, 13)], "book_id string, chapter int")
    got = decay.decayed(edges, chapters)
    assert {(r.chapter, r.a, r.weight_e4, r.sentiment_e4) for r in got.collect()} == want
    floats = decay.decayed(edges, chapters, exact_python=True)
    assert abs(floats.count() - got.count()) <= 2
    zero = decay.decayed(edges, chapters, [0])
    assert {(r.chapter, r.a) for r in zero.collect()} == {(k * 10, p) for k, p in obs}


def test_alpha_is_checked(spark):
    with pytest.raises(ValueError, match="alpha"):
        decay.decayed(spark.createDataFrame([], E), spark.createDataFrame([], "book_id string, chapter int"), [101])


def test_ghost_nodes(spark):
    m = mention_rows(spark, [("A", 0), ("B", 0), ("B", 1)]).unionByName(mention_rows(spark, [("C", 0)], 2)).unionByName(mention_rows(spark, [("C", 0)], 3))
    linked = decay.decayed(spark.createDataFrame([("b", 1, "A", "B", 0, 0)], E), m)
    nodes = {(r.chapter, r.name): r.mention_count for r in decay.carried_nodes(m, linked).collect()}
    assert nodes == {(1, "A"): 1, (1, "B"): 2, (2, "C"): 1, (2, "A"): 0, (2, "B"): 0, (3, "C"): 1}


def test_segments_restart_after_failure(spark):
    df = spark.createDataFrame([("b", k, k == 3) for k in range(1, 6)], "book_id string, chapter int, failed boolean")
    parts = decay.segments(df)
    assert {r.chapter: r.segment for r in parts.collect()} == {1: 0, 2: 0, 4: 1, 5: 1}
    edges = spark.createDataFrame([("b", 2, "A", "B", 9, 0), ("b", 4, "A", "B", 3, 0)], E)
    for binary in (False, True):
        got = {(r.chapter, r.weight_e4, r.is_carry) for r in decay.decayed(edges, parts, exact_python=binary).collect()}
        assert got == {(2, 27_000, False), (4, 30_000, None), (5, 21_000, True)}  # nothing passes the failed chapter


def linked(spark, names, chapter=1, polarity=None):
    rows = [("b", chapter, x[0], x[1], (polarity or {}).get(x)) for x in names]
    return spark.createDataFrame(rows, "book_id string, chapter int, a string, b string, polarity string")


def test_metrics(spark):
    row = metrics.precision_recall_f1(linked(spark, ["AB", "AC"]), linked(spark, ["BA", "BC", "CD"])).first()
    assert (row.precision_e4, row.recall_e4, row.f1_e4, row.jaccard_e4) == (5000, 3333, 4000, 2500)
    chapter = spark.createDataFrame([("b", 1)], "book_id string, chapter int")
    row = metrics.precision_recall_f1(linked(spark, []), linked(spark, []), chapters=chapter).first()
    assert (row.precision_e4, row.recall_e4, row.f1_e4, row.jaccard_e4) == (0, 0, 0, 10_000)
    p = linked(spark, ["AB", "AC", "BC"], polarity={"AB": "positive", "BC": "positive"})
    g = linked(spark, ["AB", "CA", "BC"], polarity={"AB": "positive", "CA": "neutral", "BC": "negative"})
    assert metrics.polarity_agreement(p, g).first().agreement_e4 == 6667


def test_edit_distance(spark):
    triangle, path = (["a", "b", "c"], [("a", "b"), ("b", "c"), ("a", "c")]), (["x", "y", "z"], [("x", "y"), ("y", "z")])
    assert metrics.edit_distance(triangle, path) == 1
    assert metrics.edit_distance(path, triangle) == 1
    assert metrics.edit_distance(triangle, triangle) == 0
    assert metrics.edit_distance(triangle, ([], [])) == 6
    assert metrics.edit_distance((["a"], []), (["a", "b"], [("a", "b")])) == 2
    assert metrics.edit_distance((["a"], [("a", "a")]), (["a"], [])) == 1
    nodes = spark.createDataFrame([("b", 1, x) for x in "ABC"], "book_id string, chapter int, name string")
    assert metrics.graph_edit_distance(nodes, linked(spark, ["AB", "BC"]), nodes, linked(spark, ["AB"])).first().ged == 1


def test_summary(spark):
    nodes = spark.createDataFrame([("b", 1, n, c, i) for i, (n, c) in enumerate([("A", 2), ("B", 5), ("C", 2), ("D", 1)])] + [("b", 2, "A", 1, 0)], "book_id string, chapter int, name string, mention_count long, first int")
    edges = graph.plain_edges(spark.createDataFrame([("b", 1, "A", "B", 3, 1000), ("b", 1, "B", "C", 3, -1000), ("b", 1, "C", "D", 4, 501)], E))
    got = {r.chapter: r for r in graph.summary_records(nodes, edges).collect()}
    assert (got[1].density_e6, got[1].edge_count, got[1].avg_sentiment_e4, got[1].carried_edges) == (500_000, 3, 167, 0)
    assert [x.name for x in got[1].top_characters] == ["B", "A", "C", "D"]
    assert (got[2].density_e6, got[2].avg_sentiment_e4) == (0, 0)


def test_snapshots(spark):
    edges = graph.plain_edges(spark.createDataFrame([("b", 1, "A", "B", 47, 2000)], E))
    assert snapshot.serialize(edges, "flat").first().snapshot == "A: B(+0.2,w=47)\nB: A(+0.2,w=47)"
    more = graph.plain_edges(spark.createDataFrame([("b", 1, "A", "B", 5, 2000), ("b", 1, "C", "D", 9, 0)], E))
    cast = spark.createDataFrame([("b", 1, "A")], "book_id string, chapter int, name string")
    assert snapshot.serialize(more, "topN", 1, cast).first().snapshot == "A--B: weight=5, polarity=positive"
    assert snapshot.serialize(more, "edges").first().snapshot == "C--D: weight=9, polarity=neutral\nA--B: weight=5, polarity=positive"
    assert snapshot.serialize(more.limit(0), "edges").isEmpty()
    with pytest.raises(ValueError, match="unknown strategy"):
        snapshot.serialize(edges, "other")


def test_best_alpha_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 30, 5000), ("b", 50, 6000), ("b", 70, 6000)], "book_id string, alpha int, f1_e4 long")
    assert sweep.best_alpha(df).first().best_alpha == 50


def test_continuity(spark):
    m = mention_rows(spark, [("A", 0), ("B", 1)]).unionByName(mention_rows(spark, [("B", 0), ("C", 1), ("D", 2)], 5))
    assert [tuple(r) for r in decay.continuity(m).collect()] == [("b", 5, 1, 2, 1)]


def test_cooccurrence_rides_one_exchange(spark):
    plan = cooccur.edges(mention_rows(spark, G7), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(book_id") + plan.count("hashpartitioning(book_id") >= 1
    assert "BroadcastNestedLoopJoin" not in plan


def test_edit_distance_query_takes_whole_graphs(spark):
    sf = "/root/testdata/sf0.001"
    nodes, links = {}, {}
    for r in graph.plain_nodes(catalog.events_mentions(spark, sf)).select("chapter", "name").collect():
        nodes.setdefault(r.chapter, []).append(str(r.name))
    for r in catalog._event_edges(spark, sf).select("chapter", "a", "b").collect():
        links.setdefault(r.chapter, []).append((str(r.a), str(r.b)))
    got = {r.chapter: r for r in catalog.graph_edit_distance(spark, sf).collect()}
    assert set(got) == set(nodes) | {c - 1 for c in nodes}
    for c, r in got.items():
        want = metrics.edit_bounds((nodes.get(c, []), links.get(c, [])), (nodes.get(c + 1, []), links.get(c + 1, [])))
        assert (r.ged, r.ged_lower, r.exact) == (*want, want[0] == want[1])
    assert got[0].ged == len(nodes[1]) + len(links.get(1, []))


def test_edit_bounds_tell_exact_from_upper_bound():
    ring = (list("abcdef"), [(x, y) for x, y in zip("abcdef", "bcdefa", strict=True)])
    two = (list("abcdef"), [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d")])
    assert metrics.edit_bounds(ring, two) == (4.0, 4.0)
    upper, lower = metrics.edit_bounds(ring, two, budget=8)
    assert lower == 0.0 < 4.0 <= upper
    many = [str(i) for i in range(1_200)]
    assert metrics.edit_bounds((many, []), (many, []))[0] == 0.0


def test_alpha_keeps_all_its_digits():
    from inkgraph.plans import pipelines

    assert pipelines.alpha_parts(0.7) == (70, 100)
    assert pipelines.alpha_parts(1.0) == (100, 100)
    assert pipelines.alpha_parts(0.705) == (705, 1000)
    with pytest.raises(ValueError, match="alpha"):
        pipelines.alpha_parts(1 / 3)


def test_fold_in_any_number_of_parts(spark):
    seen = {1: (10, 5000), 2: (4, -5000)}
    assert [x[1] for x in folded(spark, seen, 2, 705, whole=1000)] == [100_000, 82_300]
    assert [x[1] for x in folded(spark, seen, 2, 705_000_000, whole=10**9)] == [100_000, 82_300]  # beyond 64 bits on the way


def test_command_line_annotates_and_shows_a_table(spark, tmp_path, capsys):
    from inkgraph.plans import cli

    for n in (1, 2, 3):
        (tmp_path / f"book_ch0{n}.txt").write_text("Ann met Bob and Ann loved Bob there. " * 4)
    (tmp_path / "names.tsv").write_text("ann\t1\nbob\t2\n")
    (tmp_path / "words.tsv").write_text("loved\t3.0\n")
    args = ["carried", "--chapters", str(tmp_path / "*.txt"), "--dictionary", str(tmp_path / "names.tsv"), "--lexicon", str(tmp_path / "words.tsv"), "--alpha", "0.705", "--out", str(tmp_path / "out")]
    assert cli.main(args) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].split() == list(cli.SUMMARY)
    assert [x.split()[:4] for x in lines[1:4]] == [["book", str(n), "2", "1"] for n in (1, 2, 3)]
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).filter("sentiment_e4 > 0").count() == 3
    assert cli.main(["plain", "--chapters", "x", "--out", "y"]) == 1


def test_pairs_by_cells_exchange_mentions_and_equal_brute_force(spark, monkeypatch):
    """Before, every pair of a centre was a row, and pairs were exchanged. Names repeat, stand at one position, and lie across stretches."""
    monkeypatch.setattr(cooccur, "CELL_PAIRS", 40)  # many cells
    monkeypatch.setattr(cooccur, "AT_ONCE", 7)
    rng = random.Random(5)
    rows = [("b", c, f"n{rng.randrange(9)}", rng.randrange(-300, 900)) for c in (1, 2, 3) for _ in range(150)]
    df = spark.createDataFrame(rows, "book_id string, chapter int, name string, pos bigint")
    scores = df.groupBy("book_id", "chapter", "pos").agg(F.max(F.col("pos") * 7 % 50 - 20).alias("score_e4"))
    value, want = {(r.chapter, r.pos): r.score_e4 for r in scores.collect()}, {}
    for chapter in (1, 2, 3):
        for pos in {r[3] for r in rows if r[1] == chapter}:
            cast = sorted({r[2] for r in rows if r[1] == chapter and abs(r[3] - pos) <= 3})
            for a, b in itertools.combinations(cast, 2):
                n, total = want.get((chapter, a, b), (0, 0))
                want[chapter, a, b] = n + 1, total + value[chapter, pos]
    tenth = lambda t, n: (1 if t >= 0 else -1) * ((2 * abs(t) + n) // (2 * n))
    often = {k: v for k, v in want.items() if v[0] >= 2}
    assert cooccur.covers(df, 3).agg(F.max("parts")).first()[0] > 2
    assert {(r.chapter, r.a, r.b): (r.weight, r.sentiment_e4) for r in cooccur.edges(df, 3, 2, scores=scores).collect()} == {k: (n, tenth(t, n)) for k, (n, t) in often.items()}
    found = cooccur.edges(df, 3, 2)
    assert {(r.chapter, r.a, r.b) for r in cooccur.edges(df, 3, 2, among=df.select("book_id", "chapter", F.lit("n3").alias("name"))).collect()} == {k for k in often if "n3" in k[1:]}
    gold = df.withColumn("chapter", F.col("chapter") - 1)
    sides = {(r.chapter, r.a, r.b): (r.p, r.g) for r in cooccur.compared(df, gold, 3, 2).collect()}
    assert sides == {k: (k in often, (k[0] + 1, *k[1:]) in often) for k in {*often, *((c - 1, a, b) for c, a, b in often)}}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]


def test_bag_edges_are_dealt_to_many_tasks(spark):
    rows = mention_rows(spark, [(f"n{(p * 7 + i) % 40}", p) for p in range(200) for i in range(3)])
    for found in (cooccur.bag_edges(rows), decay.decayed(cooccur.bag_edges(rows), rows)):
        tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) > 8  # before: no more than the shuffle partitions


def test_sweep_equals_the_folded_edges(spark, monkeypatch):
    rnd = random.Random(5)
    names = "abcdefg"
    make = lambda: spark.createDataFrame([("b", k, *p, rnd.randint(1, 5), 0) for k in range(1, 15) for p in itertools.permutations(names, 2) if rnd.random() < 0.1], E)
    edges, gold = make(), make().filter("chapter <> 9")
    chapters = spark.createDataFrame([("b", k, int(k > 6)) for k in range(1, 14) if k != 5], "book_id string, chapter int, segment int")
    monkeypatch.setattr(sweep, "AT_ONCE", 20)  # several tables of whole pairs in a task
    for places in (chapters.drop("segment"), chapters):
        linked = decay.decayed(edges, places, sweep.ALPHAS)
        judged = {r.chapter for r in gold.collect()} & {r.chapter for r in places.collect()}
        wanted = {k: {frozenset(r[2:4]) for r in gold.collect() if r.chapter == k} for k in judged}
        for row in sweep.sweep(edges, places, gold).collect():
            mine = {k: {frozenset((r.a, r.b)) for r in linked.collect() if (r.chapter, r.alpha) == (k, row.alpha)} for k in judged}
            recall = [nearest(len(mine[k] & wanted[k]) * 10_000, len(wanted[k])) for k in judged]
            precision = [nearest(len(mine[k] & wanted[k]) * 10_000, len(mine[k])) if mine[k] else 0 for k in judged]
            assert (row.chapters, row.recall_e4, row.precision_e4) == (len(judged), nearest(sum(recall), len(judged)), nearest(sum(precision), len(judged)))


def test_edit_bounds_set_up_in_linear_time():
    rnd, names = random.Random(2), [f"n{i}" for i in range(4_000)]
    first, second = ((names, [tuple(rnd.sample(names, 2)) for _ in range(30_000)]) for _ in range(2))
    start = time.perf_counter()
    upper, lower = metrics.edit_bounds(first, second, 5_000)
    assert lower < upper < 2 * 34_000
    assert time.perf_counter() - start < 20  # nodes times edges took minutes


def test_counts_and_heaviest_leave_a_cell_without_its_pairs(spark, monkeypatch):
    """Before, every pair of a day left its cell to be counted or ranked, and scores were a table of their own to be joined."""
    monkeypatch.setattr(cooccur, "CELL_PAIRS", 40)
    monkeypatch.setattr(cooccur, "AT_ONCE", 7)
    rng = random.Random(8)
    rows = [("b", c, f"n{rng.randrange(9)}", rng.randrange(-300, 900), rng.randrange(-900, 900)) for c in (1, 2, 4) for _ in range(150)]
    df = spark.createDataFrame([*rows, ("b", 9, "n1", 5, 1)], "book_id string, chapter int, name string, pos bigint, score_e4 bigint")
    scores = df.groupBy("book_id", "chapter", "pos").agg(F.min("score_e4").alias("score_e4"))
    found = sorted(map(tuple, cooccur.edges(df, 3, 2, scores=scores).collect()))
    assert found and found == sorted(map(tuple, cooccur.edges(df, 3, 2, scores="score_e4").collect()))
    counts = {r.chapter: (r.edge_count, r.total) for r in cooccur.edge_counts(df, 3, 2, "score_e4").collect()}
    assert counts == {c: (sum(r[1] == c for r in found), sum(r[5] for r in found if r[1] == c)) for c in (1, 2, 4)}
    some = sorted(map(tuple, cooccur.edges(df, 3, 2, scores="score_e4", heaviest=4).collect()))
    assert set(some) <= set(found)
    for c in (1, 2, 4):
        top = lambda edges: sorted((-r[4], r[2], r[3], r[5]) for r in edges if r[1] == c)[:4]  # noqa: B023, E731
        assert top(some) == top(found)
    gold = df.withColumn("chapter", F.col("chapter") - 1)
    sides = cooccur.compared(df, gold, 3, 2)
    want = sides.groupBy("book_id", "chapter").agg(F.count_if(F.col("p") & F.col("g")), F.count_if("p"), F.count_if("g"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, cooccur.compared(df, gold, 3, 2, counted=True).collect()))


def test_lines_meet_their_orders_in_finer_tasks(spark):
    """Before, in as many tasks as there are shuffle partitions, or fewer."""
    rows = catalog.orders_mentions(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() == cooccur.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_snapshots_from_cells_equal_those_of_edges(spark, monkeypatch):
    """Texts leave the cells, one for each name (and weight), and no edge is a row; what is joined from them is what the edges give."""
    monkeypatch.setattr(cooccur, "CELL_PAIRS", 300)
    monkeypatch.setattr(cooccur, "AT_ONCE", 100)
    rnd = random.Random(9)
    rows = [("b", rnd.choice((1, 1, 2)), rnd.choice(["é", "x--y", "B", "a", "", "10", "9", *map(str, range(20, 45))]), rnd.randint(0, 150), rnd.randint(-2000, 2500)) for _ in range(900)]
    rows = [(b, k, n, p, -(p * 37 % 1900) + 900) for b, k, n, p, _ in rows]
    m = spark.createDataFrame(rows, "book_id string, chapter int, name string, pos bigint, score_e4 bigint")
    assert m.count() and cooccur.parts_of(m, 5).agg({"parts": "max"}).first()[0] > 2
    edges = graph.plain_edges(cooccur.edges(m, 5, 2, scores="score_e4")).cache()
    lines, nodes = cooccur.edge_lines(m, 5, 2, "score_e4").cache(), cooccur.node_lines(m, 5, 2, "score_e4")
    told = lambda df: sorted(map(tuple, df.select("book_id", "chapter", "snapshot").collect()))
    assert told(snapshot.joined_lines(lines, ["heavy", "a"])) == told(snapshot.serialize(edges, "edges"))
    assert told(snapshot.joined_lines(nodes, ["a"])) == told(snapshot.serialize(edges, "flat"))
    assert lines.count() == edges.select("chapter", "a", "weight_e4").distinct().count() < edges.count()
    assert {r.polarity for r in edges.select("polarity").distinct().collect()} == {"negative", "neutral", "positive"}
    assert told(snapshot.joined_lines(lines.filter("chapter = 7"), ["heavy", "a"])) == []


def test_a_day_is_told_where_its_pairs_are(spark, monkeypatch):
    """Before, the lines of a day's edges were exchanged: text that grows with the square of its mentions."""
    monkeypatch.setattr(cooccur, "AT_ONCE", 50)
    rnd = random.Random(10)
    rows = [("b", k, n, p, p * 37 % 1900 - 900) for k, n, p in ((rnd.choice((1, 1, 2)), rnd.choice(["é", "x--y", "", "10", "9", *map(str, range(20, 45))]), rnd.randint(0, 150)) for _ in range(900))]
    m = spark.createDataFrame([*rows, ("b", 5, "alone", 3, 0)], "book_id string, chapter int, name string, pos bigint, score_e4 bigint")
    edges = graph.plain_edges(cooccur.edges(m, 5, 2, scores="score_e4")).cache()
    told = lambda df: sorted(map(tuple, df.select("book_id", "chapter", "snapshot").collect()))
    for texts, kind in ((cooccur.edge_texts(m, 5, 2, "score_e4"), "edges"), (cooccur.node_texts(m, 5, 2, "score_e4"), "flat")):
        assert len(told(texts)) == 2 and told(texts) == told(snapshot.serialize(edges, kind))
        assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    for query in (catalog.edge_snapshot, catalog.adjacency_snapshot):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0]


def test_edit_distance_exchanges_mentions_and_holds_no_graph(spark, monkeypatch):
    """Before, all edges of both days were exchanged and gathered in a row. Graphs compared as sets, as held arrays and made when asked for have the same bounds."""
    rnd = random.Random(11)
    m = spark.createDataFrame([("b", rnd.choice((1, 1, 2, 4)), f"n{rnd.randrange(24)}", rnd.randrange(250)) for _ in range(160)] + [("b", None, "n1", None), ("b", 8, None, 3)], M)
    later = m.withColumn("chapter", F.col("chapter") - 1)
    nodes, edges = graph.plain_nodes(m), cooccur.edges(m, 3, 2)
    told = lambda df: sorted(map(tuple, df.select("chapter", "ged", "ged_lower", "exact").collect()), key=str)
    want = told(metrics.graph_edit_distance(nodes, edges, graph.plain_nodes(later), cooccur.edges(later, 3, 2), budget=60, bounds=True))
    assert len(want) == 9 and any(not r[3] for r in want)
    for limits in ((2_000_000, 1_000), (0, 1_000), (0, 0)):
        monkeypatch.setattr(metrics, "AS_SETS", limits[0])
        monkeypatch.setattr(metrics, "HELD", limits[1])
        monkeypatch.setattr(metrics, "KEPT", 20)
        found = metrics.edit_distance_of_mentions(m, later, 3, 2, budget=60)
        assert told(found) == want


def test_parts_grow_no_more_once_there_are_cells_enough(spark, monkeypatch):
    """Before, cells had a fixed size, so a mention went to ever more of them: what was exchanged grew with the square of a day's mentions."""
    rows = [("b", c, f"n{i % 17}", i % 90) for c in (1, 2, 3, 4) for i in range(400)]
    m = spark.createDataFrame(rows, M)
    want = sorted(map(tuple, cooccur.edges(m, 5, 2).collect()))
    monkeypatch.setattr(cooccur, "CELL_PAIRS", 5)
    monkeypatch.setattr(cooccur, "ALL_CELLS", 16)
    assert cooccur.parts_of(m, 5).agg(F.max("parts")).first()[0] == 3
    assert sorted(map(tuple, cooccur.edges(m, 5, 2).collect())) == want


def test_graphml_is_measured_where_its_edges_are(spark, monkeypatch):
    """Before, a line was made for every edge, to be measured."""
    from inkgraph.sources import writers

    rnd = random.Random(12)
    rows = [("b", rnd.choice((1, 1, 2)), rnd.choice((-3, 7, 12, 4567, 10**12, 55)), rnd.randint(0, 3000), p * rnd.choice((1, 100, 1000))) for p in range(-900, 900)]
    m = spark.createDataFrame([*rows, ("b", 5, 8, 3, 0)], "book_id string, chapter int, name bigint, pos bigint, score_e4 bigint")
    nodes, edges = graph.plain_nodes(m), graph.plain_edges(cooccur.edges(m, 9, 2, scores="score_e4"))
    told = lambda df: sorted(map(tuple, df.select("chapter", "n_chars").collect()))
    want = told(writers.graphml_sizes(writers.graphml_lines(nodes, edges)))
    assert len(want) == 3 and told(writers.graphml_sizes_of(nodes, cooccur.graphml_lengths(m, 9, 2, "score_e4"))) == want
    sf = "/root/testdata/sf0.001"
    days = catalog.events_mentions(spark, sf)
    lines = writers.graphml_lines(graph.plain_nodes(days), catalog._event_edges(spark, sf))
    assert told(catalog.graphml_documents(spark, sf)) == told(writers.graphml_sizes(lines))
