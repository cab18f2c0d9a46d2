"""Toxicity, nearest neighbours, mixing, line dedup, decontamination, components and the pipeline."""

import random

import brute
import numpy as np
from lakeloom.llm import ann, decontaminate, line_dedup, mixing, toxicity
from lakeloom.llm.shared import Scratch, components
from pyspark.sql import functions as F


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 2000 + i) for i in range(300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert not components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count()


def _toxic_corpus(n=400):
    rng = random.Random(4)
    calm = [f"w{i}" for i in range(300)]
    bad = ["idiot", "scumbag", "moronic", "vile", "trashy"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 120))]
        k = 0 if i % 3 else rng.randint(2, 9)
        for _ in range(k):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), k))
        labels.append((i, 1, int(k > 0)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = _toxic_corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in docs] + [(None, None, "x"), (9999, "", "x"), (3, docs[3][1], "x")], "doc_id long, text string, toxic string")
    held_out = spark.createDataFrame([x for x in labels if x[0] < 300] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, held_out)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(table, model).collect()
    assert len(got) == len(docs) + 3
    rest = {r.doc_id: r for r in got if r.doc_id is not None and 300 <= r.doc_id < 400}
    assert np.mean([rest[i].toxic == (k > 0) for i, _, k in docs[300:]]) > 0.97
    few, many = ([rest[i].severity for i, _, k in docs[300:] if k in ks] for ks in ((2, 3), (7, 8, 9)))
    assert np.mean(many) > np.mean(few) + 0.5
    assert all(r.toxic == 0 for r in got if r.doc_id in (None, 9999))
    kept = toxicity.clean(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.toxic == 0 for r in got)


def test_toxicity_sample_is_bounded_by_rows(spark):
    """An id that stands in many rows is one row of the sample."""
    docs, labels = _toxic_corpus(120)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(3, f"copy {k}") for k in range(3000)], "doc_id long, text string")
    seen, real = [], toxicity.fit
    toxicity.fit = lambda rows, feats, values, grades, *a, **k: seen.append(len(grades)) or real(rows, feats, values, grades, *a, **k)
    try:
        toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    finally:
        toxicity.fit = real
    assert seen == [120]


def test_toxicity_of_empty_and_very_long_texts(spark, none):
    docs, labels = _toxic_corpus(120)
    model = toxicity.train(spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not toxicity.score(none, model).count()
    long = spark.createDataFrame([(1, "idiot scumbag vile " * 100_000), (2, "w1 w2 w3 " * 200_000)], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in toxicity.score(long, model).collect()} == {1: 1, 2: 0}


def test_toxicity_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, empty) is None
    assert toxicity.score(docs, None).agg(F.sum("severity"), F.count("*")).first()[1] == docs.count()


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    grades = np.searchsorted([-1.0, 0.5, 1.5], x * 2 + rng.logistic(size=2000) * 0.5)
    w, theta = toxicity.fit(np.arange(2000), np.zeros(2000, int), x, grades, 1, l2=0, steps=1500)
    assert 3 < w[0] < 5 and np.allclose(theta, np.array([-1, 0.5, 1.5]) * 2, atol=0.4)


def _vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[200:600] = x[200]  # many rows of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [1.0, None] + [0.0] * 22), (2060, [float("nan")] * 24), (2080, [1.0, 2.0]), (None, x[0].tolist()), (40, x[40].tolist())]
    return rows


def test_ann_recall_and_scores(spark):
    rows = _vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, block=256, rerank=64).collect()
    x = {i: np.array(v, np.float64) for i, v in rows[:1500]}
    ids = np.array(list(x))
    m = np.stack([x[i] for i in ids])
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == [i for i in range(0, 1500, 20)]
    hits = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in [r.vec_id for r in rs] and len({r.vec_id for r in rs}) == 20
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        score = m @ x[q]
        for r in rs:
            assert abs(r.score - score[r.vec_id]) < 1e-9
        score[ids == q] = -np.inf
        hits += len({r.vec_id for r in rs} & set(ids[np.lexsort((ids, -np.round(score, 9)))[:20]].tolist()))
    assert hits / (20 * len(by)) > 0.95


def test_ann_recall_in_a_tight_cluster(spark):
    """A third of the rows in one cluster: the codes hardly tell its members apart, the exact scores do."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1800, 32))
    x[:600] = x[0] + rng.normal(size=(600, 32)) * 0.02
    table = spark.createDataFrame([(i, v.tolist(), "clash", 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, query_id string, score double")
    got = {}
    for r in ann.search(table, block=1024, rerank=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1800, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * 90) > 0.97


def test_ann_of_very_long_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3000))
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    for q in (0, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert [got[q, r] for r in range(1, 21)] == np.argsort(-score)[:20].tolist()


def test_ann_edges(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(table).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert not ann.search(table.limit(0)).count()


def test_mixing_meets_targets(spark):
    docs, labels = _toxic_corpus(300)
    labels = [(i, int(i % 2), t) for i, _, t in labels]
    table = spark.createDataFrame([(i, t, 0.5) for i, t, _ in docs] + [(None, None, 0.5), (7, "", 0.5)], "doc_id long, text string, p double")
    want = {"plain": 0.4, "good": 0.4, "toxic": 0.2}
    out = mixing.mix(table, spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int"), targets=want)
    got = out.collect()
    assert len(got) == 302 and all(r.rate >= 0 for r in got) and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    n = np.array([r.n_tokens for r in got])
    sums = (np.array([r.rate for r in got]) * n) @ np.array([r.p for r in got]) / n.sum()
    assert np.allclose(sums, [want[d] for d in mixing.DOMAINS], atol=1e-4)


def test_mixing_agrees_with_plain_projection(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 50, 200)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    moves = mixing.fit_rates(rows, {"plain": 0.7, "good": 0.2, "toxic": 0.1})
    r, want = np.ones(200), np.array([0.7, 0.2, 0.1])
    for c in moves:
        r = np.maximum(0, r - p @ np.array(c))
    assert np.allclose((r * n) @ p / n.sum(), want, atol=1e-6)
    spark_r = [x[0] for x in rows.select(mixing.rate(moves)).collect()]
    assert np.allclose(spark_r, r)


def test_mixing_keeps_other_columns(spark, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b " * 50_000, 0.5, "x", 7, "y"), (2, None, 0.5, None, 8, "z"), (2, None, 0.5, None, 8, "z")], "doc_id long, text string, p double, _s0 string, rate int, _buckets string")
    out = mixing.mix(docs, labels)
    assert set(out.columns) == {*docs.columns, "n_tokens"} and dict(out.dtypes)["p"] == "array<double>"
    assert sorted((r.doc_id, r._s0, r._buckets, r.n_tokens) for r in out.collect() if r._s0) == [(1, "x", "y", 100_000)] and out.count() == 3
    assert not mixing.mix(none, labels).count() and mixing.mix(docs, labels.limit(0)).count() == 3


def test_mixing_posteriors_are_those_of_naive_bayes(spark):
    """Against a plain classifier over words, buckets taken from Spark's hash."""
    docs, labels = _toxic_corpus(60)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = [(i, i % 2, t) for i, _, t in labels[:40]]
    out = {r.doc_id: r for r in mixing.mix(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    words = sorted({w for _, t, _ in docs for w in t.split()})
    spot = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) as b").collect()}
    kind = {i: 2 if t else q for i, q, t in labels}
    counts = np.full((3, mixing.BUCKETS), 0.5)
    for i, t, _ in docs:
        for w in t.split() if i in kind else ():
            counts[kind[i], spot[w]] += 1
    likely = np.log(counts / counts.sum(axis=1, keepdims=True))
    prior = np.log((np.bincount(list(kind.values()), minlength=3) + 1) / (len(kind) + 3))
    for i, t, _ in docs:
        at = [spot[w] for w in t.split()]
        s = prior + likely[:, at].sum(axis=1) * mixing.EVIDENCE / (mixing.EVIDENCE + len(at))
        p = np.exp(s - s.max())
        assert np.allclose(out[i].p, p / p.sum(), atol=1e-4)


def test_mixing_runs_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    plan = mixing.mix(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[doc_id", "")


def _line_docs():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 30)))
    common = [line() for _ in range(20)]
    docs = []
    for i in range(60):
        ls = [line() for _ in range(5)] + ["", "  "]
        for c in rng.sample(common, 4):
            ls.append(c if rng.random() < 0.5 else c.upper() if rng.random() < 0.3 else c[:-2] + "zz")
        rng.shuffle(ls)
        docs.append((i, "\n".join(ls)))
    return docs + [(100, None), (101, ""), (102, "ab"), (103, "AB "), (104, "\n\n"), (105, "x" * 5000), (106, "x" * 4999 + "y")]


def test_line_dedup(spark, none):
    docs = _line_docs()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    cols = ("doc_id", "n_lines", "n_removed", "kept_sha256")
    want = sorted(brute.fuzzy_lines(docs))
    for tile in (2048, 4):
        # enough bands that no pair is left out by chance
        assert sorted(tuple(r) for r in line_dedup.dedup(table, bands=30, band_rows=3, tile=tile).select(*cols).collect()) == want
    kept = {r.doc_id: r.text for r in line_dedup.clean(table, bands=30, band_rows=3).collect()}
    assert kept[100] is None and kept[103] == "" and len(kept) == len(docs)
    assert not line_dedup.dedup(none).count()


def test_line_dedup_recall(spark):
    docs = _line_docs()
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).agg(F.sum("n_removed")).first()[0]
    want = sum(x[2] for x in brute.fuzzy_lines(docs))
    assert want >= got >= 0.97 * want


def test_line_dedup_of_odd_rows(docs, corpus):
    assert line_dedup.dedup(docs).count() == len(corpus)


def test_smith_waterman():
    a = np.array([1, 2, 3, 4, 5, 6])
    score = lambda b: decontaminate.smith_waterman(a, np.array(b))
    assert score([9, 1, 2, 3, 4, 5, 6, 9]) == 12 and score([1, 2, 9, 4, 5, 6]) == 9 and score([1, 2, 3, 9, 4, 5, 6]) == 11 and score([7, 8]) == 0 and score([1, 2, 4, 5, 6]) == 9

    def plain(x, y):
        h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x, 1):
            for j, v in enumerate(y, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if u == v else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontaminate.smith_waterman(x, y) == plain(x.tolist(), y.tolist())


def test_decontamination(spark, none):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(25)) for i in range(12)] + [(50, "too short"), (None, text(20)), (3, text(22)), (60, None)]
    docs = [(i, text(120)) for i in range(40)]
    docs += [(100 + i, f"{text(30)} {items[i][1]} {text(40)}") for i in range(8)]
    docs += [(200, f"{text(30)} {items[1][1].upper().replace(' ', ', ')} {text(10)}"), (300, None), (301, ""), (200, text(30))]
    edited = items[2][1].split()
    edited[6], edited[13] = "changed", "also"
    del edited[20]
    docs.append((201, f"{text(9)} {' '.join(edited)} {text(9)}"))
    docs += [(400 + i, items[5][1]) for i in range(150)]  # a leak in most documents is no common phrase
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(table, bench).collect()
    assert len(got) == len(docs)
    found = {(r.doc_id, tuple(r.item_ids)) for r in got if r.contaminated}
    want = {(100 + i, (i,)) for i in range(8)} | {(200, (1,)), (201, (2,))} | {(400 + i, (5,)) for i in range(150)}
    assert found == want
    kept = decontaminate.clean(table, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, _ in docs[:40]] + [200, 300, 301])
    assert not decontaminate.report(none, bench).count()
    assert decontaminate.report(table, bench.limit(0)).filter("contaminated = 1").count() == 0


def test_edited_leak_in_many_documents(spark):
    """Edits that leave less than half of an item's seeds make the rest look common; they count all the same."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(40).split()
    edited = [f"new{i}" if i in (18, 22, 26, 30, 34, 38) else w for i, w in enumerate(item)]
    half = item[:20]  # scores just the threshold
    docs = [(i, f"{text(60)} {' '.join(edited)} {text(60)}") for i in range(300)]
    docs += [(1000 + i, " ".join(edited)) for i in range(300)]  # the same words in each
    docs += [(2000 + i, f"{text(60)} {' '.join(half)} {text(60)}") for i in range(100)]
    docs += [(3000 + i, text(100)) for i in range(50)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, text(30))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(table, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {i for i, _ in docs if i < 3000}
    assert all(r.item_ids == [7] for r in got.values() if r.contaminated)
    assert got[1000].best_score == (34 * 2 - 6) / 80


def test_decontamination_agrees_with_alignment_of_all_pairs(spark):
    """Against Smith-Waterman of each whole document with each item: what scores the threshold there is found, but for copies without a seed."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(4, 40))) for i in range(10)]
    docs = [(i, text(rng.randint(0, 150)), "clash", 3) for i in range(30)]
    for i in range(60):
        w = items[i % 10][1].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edited"
        docs.append((100 + i, f"{text(rng.randint(0, 90))} {' '.join(w)} {text(20)}", "clash", 3))
    docs.append((300, text(30_000) + " " + items[3][1], "clash", 3))
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int")
    got = {r.doc_id: r for r in decontaminate.report(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    number = {w: k for k, w in enumerate([*words, "edited"])}
    code = lambda t: np.array([number[w] for w in t.split()], np.int64)
    found = missed = 0
    for i, t, *_ in docs:
        d = t.split()
        for k, x in items:
            if len(d) and decontaminate.smith_waterman(code(x), code(t)) / (2 * len(x.split())) >= decontaminate.THRESHOLD:
                seeds = {tuple(x.split()[j : j + 4]) for j in range(len(x.split()) - 3)}
                if seeds & {tuple(d[j : j + 4]) for j in range(len(d) - 3)}:
                    assert k in got[i].item_ids
                    found += 1
                else:
                    missed += 1
            else:
                assert k not in got[i].item_ids
    assert found > 30 and missed <= 0.1 * found


def test_alignments_of_many_passages():
    rng = np.random.default_rng(3)
    item = rng.integers(0, 6, 12)
    passages = [rng.integers(0, 6, n) for n in (1, 30, 5, 12, 70_000, 12, 2)]
    assert decontaminate.alignments(item, passages).tolist() == [decontaminate.smith_waterman(item, p) for p in passages]


def test_pipeline_stage_drops_near_copies(spark):
    """Copies with changed words, of a five-word Jaccard similarity of 0.8 or more, mostly differ in more than two bits."""
    import corpus_pipeline

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    shared = " ".join(rng.choice(words) for _ in range(12))
    docs, changed = [], []
    for i in range(150):
        text = f"{shared} {' '.join(rng.choice(words) for _ in range(rng.randint(60, 250)))}"
        docs.append((i, text))
        for k in range(rng.randint(1, 3)):
            w = text.split()
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = "other"
            changed.append((1000 * (k + 1) + i, " ".join(w)))
    docs += changed + [(9000 + i, t) for i, t in enumerate(["", None, "Few words", "few  WORDS", "a b c d"])]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in docs]
    alike = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    near = brute.simhash(docs)
    root = {c: c for *_, c in near}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((find(near[i][2]), find(near[j][2])))
                root[b] = a
    want = {find(c) for *_, c in near}
    got = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "").collect()}
    assert got == want and len(want) < len({c for *_, c in near})


def test_near_copies_in_small_tiles(spark):
    from lakeloom.llm import near_copies
    from lakeloom.llm.repeats import prepared

    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    docs = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(60) for k in [rng.randrange(100)]] + [(100, " ".join(base[::-1]))]
    scratch = Scratch(spark, "test")
    placed, found = near_copies.links(prepared(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"), scratch, tile=8)
    roots = components(found, scratch)
    assert roots.select("root").distinct().count() == 1 and roots.count() == 60 and placed.count() == 61


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null texts and ids, repeated rows, clashing columns; and empty tables."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, did string, score double"
    rows = [(i, f"calm words number {i} of a text " + "idiot vile " * (6 if i % 3 == 0 else 0), "en", "s", 5, "d", 0.5) for i in range(30)]
    rows += [(None, None, None, None, None, None, None), (None, "", "en", "s", 0, "d", 0.5), rows[1], rows[1], (99, "x " * 60_000, "en", "s", 9, "d", 0.5)]
    for name, docs in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(20) if docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "a benchmark item of some words"), (2, None)][: len(docs)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "text", "did", "score", "rate"} <= set(out.columns)
        assert out.count() <= len(docs)
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) == len(set(ids))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and 0 < out.count() < docs.count()
    assert set(docs.columns) <= set(out.columns)
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in state.collect()}
        state = stage(spark, state, "/root/testdata/sf0.001").cache()
        assert state.columns == docs.columns
        after = {r.doc_id: r for r in state.collect()}
        assert set(after) <= set(before)
        if name == "line dedup":
            want = {i: (n, c) for i, n, _, c in brute.fuzzy_lines([(r.doc_id, r.text) for r in before.values()])}
            same = sum(__import__("hashlib").sha256(after[i].text.encode()).hexdigest() == want[i][1] for i in after)
            assert len(after) == len(before) and same >= 0.98 * len(after)
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "simhash near-dedup":
            assert set(after) == {c for *_, c in brute.simhash([(r.doc_id, r.text) for r in before.values()])}
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
            assert not [i for i, r in after.items() if any(x in r.text for x in items)]
