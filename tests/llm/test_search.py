"""Dedup, joins, neighbours and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgraph.llm import additive_ann, edit_fingerprint, ngram_join, suffix_dedup
from inkgraph.llm.components import components
from inkgraph.llm.shingles import shingle_set, word_hashes
from tests.llm.helpers import DOCS, LONG, brute_components, clashing, mutated, odd_rows, shingles

SF = "/root/testdata/sf0.001"


def brute_dedup(rows, length=50):
    seen, out = set(), []
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append((t or "").encode())
    for d in sorted(by_id):
        new = set()
        for b in by_id[d]:
            covered = bytearray(len(b))
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                new.add(w)
                if w in seen:
                    covered[p : p + length] = b"\1" * length
            kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
            spans = sum(1 for i in range(len(covered)) if covered[i] and (i == 0 or not covered[i - 1]))
            out.append((d, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
        seen |= new
    return sorted(out)


def dedup(docs):
    got = suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs)).drop("kept")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_suffix_dedup_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = suffix_dedup.op1_suffix_dedup(spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == brute_dedup(rows)


def test_suffix_dedup_odd_rows(spark):
    rnd = random.Random(5)
    words = ["ab", "a" * 30, "the quick brown fox ", "é", "zz top ", "0123456789" * 6, "x"]
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is not None] + [(100 + i // 2, "".join(rnd.choice(words) for _ in range(rnd.randint(0, 20)))) for i in range(60)]
    assert dedup(clashing(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute_dedup(rows), key=repr)
    null = dedup(spark.createDataFrame([(1, "y" * 80), (None, "y" * 80), (2, "y" * 80)], "doc_id long, text string"))
    assert [(r[0], r[2]) for r in null] == [(1, 0), (2, 80), (None, 0)]
    assert dedup(spark.createDataFrame([], DOCS)) == []


@pytest.mark.parametrize("held", [1 << 20, 300])
def test_suffix_dedup_of_a_line_in_a_third_of_the_documents(spark, monkeypatch, held):
    """However few rows a task aggregates at a time."""
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    rnd = random.Random(6)
    line = "This line stands in every third document of the whole collection, at any place. "
    rows = []
    for i in range(240):
        words = [rnd.choice(["alpha ", "beta ", "gamma ", "delta ", "epsilon "]) + str(rnd.randint(0, 999)) for _ in range(rnd.randint(5, 60))]
        if i % 3 == 0:
            words.insert(rnd.randrange(len(words)), line)
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[i][1]) for i in range(0, 40)]
    assert dedup(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute_dedup(rows), key=repr)


def test_pieces_of_long_texts_agree(monkeypatch):
    data = LONG[:30_000].encode()
    whole = [(at + f.tolist()[i], at + p.tolist()[i]) for at, _, p, f, _ in suffix_dedup.speakers(data) for i in range(len(f))]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    cut = {w: at + q for at, _, p, f, last in suffix_dedup.speakers(data) for q, a, b in zip(p.tolist(), f.tolist(), last.tolist(), strict=True) for w in range(at + a, at + b + 1)}
    assert len(cut) == len(data) - 49
    assert all(cut[w] == q for w, q in whole)


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, words, num):
    rows = mutated(300) + [(10_000 + (r[0] or 0), r[1]) for r in odd_rows() if r[0] not in (None, 2)]
    got = ngram_join.jaccard_components(clashing(spark.createDataFrame(rows, "doc_id long, text string")), words, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, words, num)


def test_ngram_join_chain_and_repeats(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [(i, " ".join([f"x{j}" for j in range(i)] + base[i:])) for i in range(12)]  # neighbours are near, the ends are not
    rows = [*chain, (3, chain[3][1]), (None, chain[3][1])]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert len(got) == 14
    assert {r.component_id for r in got if r.doc_id is not None} == {0}
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(98, None)]
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_divide_skip():
    rnd = random.Random(1)
    for _ in range(60):
        q = np.unique(np.array([rnd.randint(0, 80) for _ in range(rnd.randint(1, 60))], dtype=np.uint64))
        sets = [np.unique(np.array([x for x in q.tolist() if rnd.random() < 0.9] + [rnd.randint(0, 99) for _ in range(rnd.randint(0, 6))] or [1], dtype=np.uint64)) for _ in range(rnd.randint(1, 40))]
        for num in (50, 80, 90):
            want = [i for i, s in enumerate(sets) if 100 * len(set(q.tolist()) & set(s.tolist())) >= num * len(set(q.tolist()) | set(s.tolist()))]
            assert ngram_join.divide_skip(q, sets, num, 100) == want


def test_part_filter_misses_no_link():
    rnd = random.Random(2)
    bands = ngram_join.Bands(80, 100)
    for _ in range(300):
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(rnd.randint(1, 120))], dtype=np.uint64))
        b = a.tolist()
        for _ in range(rnd.randint(0, 12)):
            if rnd.random() < 0.5 and len(b) > 1:
                b.pop(rnd.randrange(len(b)))
            else:
                b.append(rnd.getrandbits(64))
        b = np.unique(np.array(b, dtype=np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert set(ngram_join.part_hashes(a, bands).tolist()) & set(ngram_join.part_hashes(b, bands).tolist())


def test_sketches_let_every_link_through(spark):
    rnd = np.random.default_rng(6)
    rows, must = [], {}
    for i, n in enumerate([1, 7, 500, 512, 520, 1030, 9000, 15000]):
        base = rnd.integers(0, 1 << 62, n).astype(np.uint64)
        for j, (other, link) in enumerate([(base, True), (base[: -(-n * 4 // 5)], True), (np.concatenate([base, base[: n // 4] + np.uint64(1)]), True), (rnd.integers(0, 1 << 62, n).astype(np.uint64), False)]):
            a, b = ngram_join.sketch(base), ngram_join.sketch(other)
            rows.append((10 * i + j, n, len(other), a.tolist(), b.tolist()))
            must[10 * i + j] = link
            assert len(a) * 64 >= min(n, 64 * ngram_join.SKETCH[1])
    pairs = spark.createDataFrame(rows, "id int, n_query int, n_key int, s_query array<long>, s_key array<long>")
    kept = {r.id for r in pairs.filter(ngram_join._linkable(80, 100)).collect()}
    assert kept >= {i for i, link in must.items() if link} and not any(i in kept for i, link in must.items() if not link and i >= 20)


def test_shingles(monkeypatch):
    for text in ("", "a", "A b", "a b c", "A  B\tc\nd e f a b c", "é É", LONG[:5000]):
        assert len(shingle_set(text, 3)) == len(shingles(text, 3))
    assert (shingle_set("A b C d", 3) == shingle_set("a\nb c  d", 3)).all()
    assert not np.intersect1d(shingle_set("a b", 3), shingle_set("a b x", 3)).size
    from inkgraph.llm import shingles as module

    whole = word_hashes(LONG)
    monkeypatch.setattr(module, "PIECE", 100)
    assert (word_hashes(LONG) == whole).all()


def test_components(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 8), (20, 20), *[(100, i) for i in range(101, 140)], *[(i, i + 1) for i in range(200, 240)]]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in range(200, 241)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ann_recall_and_scores(spark):
    pdf = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(pdf.embedding.to_numpy()).astype(float), pdf.vec_id.to_numpy()
    got = additive_ann.op2_additive_ann(spark, "/root/testdata/sf0.01").toPandas()
    hit = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        exact = x @ x[i]
        best = [j for j in np.lexsort((ids, -exact)) if j != i][:20]
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, exact[np.searchsorted(ids, own.vec_id)], atol=1e-12)
        hit, n = hit + len(set(ids[best]) & set(own.vec_id)), n + 20
    assert hit / n >= 0.9


def test_ann_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (0, [1.0, 0.0]), (9, [-1.0, 0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in additive_ann.nearest(df).collect())
    assert [r for r in got if r[0] == 0] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (0, 4, 9, -1.0)]
    assert {r[0] for r in got} == {0, 20}
    assert additive_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ann_does_not_depend_on_the_files(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows.repartition(13).write.parquet(str(tmp_path / "many"))
    own = {tuple(r) for r in additive_ann.nearest(rows, shortlist=40).collect()}
    assert {tuple(r) for r in additive_ann.nearest(spark.read.parquet(str(tmp_path / "many")), shortlist=40).collect()} == own


def test_ann_misses_none_of_the_nearest_on_other_rows(spark):
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(3000, 96)) * 0.01 + rng.normal(size=96), rng.standard_t(2, size=(3000, 96)), rng.normal(size=(3000, 160))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        got = additive_ann.nearest(df, every=250, shortlist=40).toPandas().groupby("query_id")
        for i in range(0, 3000, 250):
            exact = np.delete(x @ x[i], i)
            assert np.allclose(got.get_group(i).sort_values("rank").score, np.sort(exact)[::-1][:20], rtol=1e-9)


def test_ann_broadcasts_and_collects_no_vectors(spark):
    """Before, the queries, copied for every group, were taken for a small table and broadcast; every task sent its own sample to the driver."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = additive_ann.nearest(df)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = additive_ann.usable(df)
    want = np.stack(rows.orderBy(F.xxhash64("key"), "key").limit(40).toPandas()["v"].to_numpy())
    assert np.array_equal(additive_ann.sample_rows(rows, 40), want)


def test_best_of_keeps_the_first_of_equals():
    assert sorted(additive_ann.best_of(np.array([1.0, 3, 3, 3, 2]), 2).tolist()) == [1, 2]


def test_fingerprints(spark):
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] not in (None, 2)]
    got = {r.doc_id: r for r in edit_fingerprint.edit_fingerprints(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    ordered = sorted(rows)
    assert set(got) == {d for d, _ in rows}
    for (d, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, nxt = t or "", nxt or ""
        changed, _ = edit_fingerprint.edited(t, nxt)
        r = got[d]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (edit_fingerprint.fingerprint(t), edit_fingerprint.fingerprint(changed))
        assert 0 <= r.near_next <= 1
        assert 0 <= r.near_edited <= 1
    assert got[8].fingerprint == got[9].fingerprint
    assert edit_fingerprint.edit_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = edit_fingerprint.edit_fingerprints(spark.createDataFrame([(4, "alone in here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert edit_fingerprint.edit_fingerprints(spark.createDataFrame(odd_rows(), DOCS)).count() == len(odd_rows())


def test_edits_are_near_and_other_texts_far(spark):
    got = edit_fingerprint.op8_edit_fingerprint(spark, SF).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.99
    rnd = random.Random(8)
    text = LONG[:4000]
    edited = list(text)
    for _ in range(8):
        edited[rnd.randrange(len(edited))] = "#"
    a, b = edit_fingerprint.fingerprint(text), edit_fingerprint.fingerprint("".join(edited))
    assert edit_fingerprint.likeness(a, b) > 0.5
    prints = spark.createDataFrame([(1, a), (2, b), (3, a), (4, edit_fingerprint.fingerprint(text[::-1]))], "doc_id long, fingerprint string")
    pairs = {(r.doc_id, r.class_key) for r in edit_fingerprint.near_pairs(prints, threshold=0.5).collect()}
    assert (3, 1) in pairs
    assert not any(4 in p for p in pairs)


def test_texts_side_by_side_walk_as_each_by_itself(monkeypatch):
    rnd = random.Random(31)
    texts = ["", "a", LONG[:30_000], "日本語 \U0001f600", *("".join(rnd.choice("abc é\n") for _ in range(rnd.randint(0, 400))) for _ in range(80))]
    want = [edit_fingerprint.fingerprint(t) for t in texts]
    changed = [edit_fingerprint.fingerprint(edit_fingerprint.edited(t, f)[0]) for t, f in zip(texts[:-1], texts[1:], strict=True)]
    for together in (1 << 20, 2000, 10):
        monkeypatch.setattr(edit_fingerprint, "TOGETHER", together)
        assert edit_fingerprint.all_fingerprints(texts) == want
        assert edit_fingerprint.all_edited(texts[:-1], texts[1:]) == (want[:-1], changed)


def test_fingerprints_cover_the_whole_text():
    text = LONG[:100_000]
    whole = edit_fingerprint.fingerprint(text)
    rnd = random.Random(11)
    places = [rnd.randrange(len(text)) for _ in range(40)] + [len(text) - 1 - i for i in range(0, 400, 20)]
    changed = [edit_fingerprint.fingerprint(text[:p] + "~~~" + text[p + 3 :]) for p in places]
    assert sum(c != whole for c in changed) >= 0.95 * len(places)
    tail = edit_fingerprint.fingerprint(text[:75_000] + text[75_000:][::-1])
    assert 0.7 < edit_fingerprint.likeness(whole, tail) < 0.8


def test_near_pairs_are_looked_for_across_the_whole_fingerprint(spark):
    rnd = random.Random(21)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    head = "".join(rnd.choice("ijklmnop ") for _ in range(600)) + text[600:]
    prints = {k: edit_fingerprint.fingerprint(t) for k, t in [(1, text), (2, head), (3, "".join(rnd.choice("abcdefgh ") for _ in range(6000)))]}
    threshold = edit_fingerprint.likeness(prints[1], prints[2]) - 0.01
    assert threshold > 0.3
    frame = spark.createDataFrame(list(prints.items()), "doc_id long, fingerprint string")
    assert {(r.doc_id, r.class_key) for r in edit_fingerprint.near_pairs(frame, threshold=threshold).collect()} == {(2, 1)}


def test_near_pairs_give_a_second_look_past_the_pivot(spark):
    rnd = random.Random(22)
    walk = [rnd.choice("0123456789abcdef") for _ in range(400)]

    def turned(places):  # the same walk, some digits another
        return "-".join("".join("0123456789abcdef"[(int(c, 16) + 1) % 16] if i in places else c for i, c in enumerate(walk)) for _ in range(edit_fingerprint.WALKS))

    # 1 is 0.6 like 2 and less like 3, which are 0.8 like each other; all digits of bands are the same, so 1 is the pivot of every band.
    used = {int(i) for base in edit_fingerprint.BASES if base <= 400 for number in range(edit_fingerprint.WALKS) for i in edit_fingerprint.places(base, number, 2, 2).ravel() if base > 150}
    free = [i for i in range(400) if i not in used]
    rows = [(1, turned(set(free[:160]))), (2, turned(set())), (3, turned(set(free[-80:])))]
    like = {(a, b): edit_fingerprint.likeness(x, y) for a, x in rows for b, y in rows if a < b}
    assert like[1, 2] < 0.7 and like[1, 3] < 0.7 and like[2, 3] > 0.75
    got = edit_fingerprint.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string"), threshold=0.75, bands=2, digits=2)
    assert {(r.doc_id, r.class_key) for r in got.collect()} == {(3, 2)}


def test_op8_names_the_least_near_document(spark):
    got = {r.doc_id: r for r in edit_fingerprint.op8_edit_fingerprint(spark, SF).select("doc_id", "fingerprint", "near_id").collect()}
    keys = sorted(got)
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if edit_fingerprint.likeness(got[a].fingerprint, got[b].fingerprint) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {k: got[k].near_id for k in keys} == {k: find(k) for k in keys}
    assert any(k != got[k].near_id for k in keys)
