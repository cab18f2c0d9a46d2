"""License scan, secret scan, SimHash, substring and suffix-array dedup against plain versions."""

import random

import brute
import numpy as np
import pytest
from lakeloom.llm import kernel, lcp_merge, license_scan, secret_scan, simhash, substring_dedup, suffix_dedup


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_license_scan(docs, corpus, none):
    out = license_scan.summary(license_scan.scan(docs))
    got = rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *brute.license_base(t)) for i, t in corpus), key=str)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert not license_scan.summary(license_scan.scan(none)).count()


def test_license_text_with_edits_is_found(spark):
    text = next(t for n, _, _, t in license_scan.TEMPLATES if n == "mit-grant").split()
    text[10:11] = ["some", "inserted"]
    del text[30]
    docs = spark.createDataFrame([(1, "Intro. " + " ".join(text) + " end"), (2, "nothing here at all")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score > 0.6
    assert got[2].labels == "" and got[2].score == 0


def test_repeated_grams_are_no_license(spark, corpus):
    """Each template position counts once and in order; the plain version knows no diagonals."""
    rng = random.Random(3)
    texts = ["this program is " * 14 + "free software foundation", "redistribution and use " * 14 + "conditions are met", "source and binary forms with " * 40]
    for _, _, _, t in license_scan.TEMPLATES:
        w = t.split()
        for _ in range(4):
            edited = [x for x in w if rng.random() > 0.04]
            for _ in range(rng.randint(0, 2)):
                edited.insert(rng.randrange(len(edited) + 1), "inserted")
            texts.append(" ".join(["lead"] * rng.randint(0, 9) + edited + ["tail"]))
        texts.append(" ".join(rng.sample(w, len(w))))
        half = w[: len(w) // 2]
        texts.append(" ".join(w[len(half) :] + half))
    texts += [t for _, t in corpus if t and len(t) < 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert [got[i].labels for i in range(3)] == ["", "", ""] and all(got[i].score < 0.5 for i in range(3))
    assert [got[i].labels for i in range(len(texts))] == [brute.license_labels(t, license_scan.TEMPLATES) for t in texts]


def test_secret_scan(docs, corpus, none):
    got = rows(secret_scan.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for i, t in corpus:
        counts, sha = brute.secrets_base(t)
        want.append((i, *counts, sha))
    assert got == sorted(want, key=str)
    assert not secret_scan.scan(none).count()


def test_secret_entropy_and_allow_list():
    key = "q8Zr2LwX0vTn5BkYc7JdH3mP9sGf1aQe"
    base, more = secret_scan.spans_of(f"é {key} end".encode())
    assert not base and more and more[0][0] >= 2 and more[-1][2] <= 2 + len(key)
    for calm in ("3f2504e0-4f89-11d3-9a0c-0305e82c3301", "0123456789abcdefghijklmnop", "averylongwordwithoutdigits", "getUserAccountSettingsAndDate", "some/path/to/a/long/file-name", "2024-01-01_12-30-00_000000"):
        assert not secret_scan.spans_of(f"x {calm} y".encode())[1], calm
    # the allow-list hides windows, not what stands beside them
    for beside in (f"/example/{key}", f"3f2504e0-4f89-11d3-9a0c-0305e82c3301-{key}", f"EXAMPLE{key}"):
        text = f"x {beside} y"
        more = secret_scan.spans_of(text.encode())[1]
        assert more and text[more[0][0] : more[-1][2]].strip("/-") in key, beside
    assert secret_scan.spans_of(b"x qZrwLxXvTnBkYcJdHmPsGfVe y")[1]  # no digit
    long = "q8Zr2LwX0vTn5BkYc7JdH3mP9sGf1aQe" * 3000
    assert secret_scan.spans_of(long.encode())[1] == [(0, 3, len(long))]
    run = "aabbccddeeffgghh1122"
    for i, h in enumerate(secret_scan.window_entropies(run, 8)):
        p = np.array([run[i : i + 8].count(c) for c in set(run[i : i + 8])]) / 8
        assert abs(h + (p * np.log2(p)).sum()) < 1e-9


def test_simhash(docs, corpus, none):
    from pyspark.sql import functions as F

    got = rows(simhash.cluster(docs).withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0"))), "doc_id", "f", "component_id")
    assert got == sorted(brute.simhash(corpus), key=str)
    assert not simhash.cluster(none).count()


def test_simhash_keeps_one_of_each_group(docs, corpus):
    want = {c for _, _, c in brute.simhash(corpus)}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(want) and len(ids) == len(set(ids))


def test_tiles_lose_no_link():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    fps = np.unique(np.r_[fps, fps[:200] ^ np.uint64(5), fps[:100] ^ np.uint64(3 << 40), fps[:50] ^ np.uint64(5) ^ np.uint64(9 << 20)])
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    labels = simhash.tile_forest(fps, 2, tile=64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = np.arange(len(fps))
    while True:
        new = np.array([want[near[i]].min() for i in range(len(fps))])
        if (new == want).all():
            break
        want = new
    assert (labels == want).all()


def test_hot_keys_are_dealt_as_tile_pairs(spark, monkeypatch):
    """All fingerprints share a block pair; small tiles and a low limit spread them, and the components stay those of all pairs."""
    from lakeloom.llm.shared import Scratch, components

    rng = np.random.default_rng(4)
    low = rng.integers(0, 1 << 20, 1500).astype(np.uint64)
    fps = np.unique(np.r_[low, low[:300] ^ np.uint64(3), low[:200] ^ np.uint64(1 << 19)]) | np.uint64(0xABCDEF0000000000)
    scratch = Scratch(spark, "t")
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "TILE", 64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = np.arange(len(fps))
    while True:
        new = np.array([want[near[i]].min() for i in range(len(fps))])
        if (new == want).all():
            break
        want = new
    for hot in (10_000, 100):
        roots = {r.node: r.root for r in components(simhash.links(table, scratch, 2, hot), scratch).collect()}
        got = {}
        for i, x in enumerate(fps.view(np.int64).tolist()):
            got.setdefault(roots.get(x, x), set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(np.flatnonzero(want == r).tolist() for r in np.unique(want)), hot


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(docs, corpus, batches):
    got = rows(substring_dedup.dedup(docs, batches=batches), "doc_id", "n_units", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(corpus), key=str)


def test_substring_dedup_of_short_windows(docs, corpus, none):
    got = rows(substring_dedup.dedup(docs, window=6, gram=2), "doc_id", "n_units", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(corpus, 6), key=str)
    assert not substring_dedup.dedup(none).count()


def test_index_runs_are_compacted(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
    found = []
    for b in range(4):
        batch = spark.createDataFrame([(k, b) for k in (b, 7, 100 + b // 2)], "fp long, did long")
        found.append(sorted(r.fp for r in index.add(batch).collect()))
        index.compact()
    assert found == [[], [7, 100], [7], [7, 101]]
    assert [level for level, *_ in index.runs] == [2]
    assert sorted((r.fp, r.did) for r in index.read(index.runs[0]).collect()) == sorted((k, b) for b in range(4) for k in (b, 7, 100 + b // 2))
    index.close()


def test_runs_meet_without_an_exchange(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), fanout=9)
    for b in range(2):
        index.add(spark.createDataFrame([(k, b) for k in range(50)], "fp long, did long")).count()
    a, b = (index.read(r).select("fp") for r in index.runs)
    plan = a.hint("merge").join(b, "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_index_lasts_over_sessions(spark, corpus, tmp_path):
    """Three calls with parts of the corpus in the order of ids equal one call with all of it; each opens the index anew."""
    folder = str(tmp_path / "index")
    first = [(i, t) for i, t in corpus if i is None or i < 250]
    parts = [first, [(i, t) for i, t in corpus if i is not None and 250 <= i < 330], [(i, t) for i, t in corpus if i is not None and i >= 330]]
    got = []
    for part in parts:
        other = spark.newSession()
        docs = other.createDataFrame(part, "doc_id long, text string").repartition(3)
        got += [tuple(r) for r in substring_dedup.dedup(docs, window=20, gram=6, batches=2, index=folder).select("doc_id", "n_units", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute.substring(corpus, 20), key=str)
    index = substring_dedup.FingerprintIndex(spark, folder)
    assert len(index.documents) == 3 and index.made == 3


@pytest.mark.parametrize("group", [2048, 3, 1])
def test_suffix_dedup(docs, corpus, group):
    got = rows(suffix_dedup.dedup(docs, group=group), "doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix(corpus), key=str)


def test_suffix_dedup_of_short_windows(docs, corpus, none):
    got = rows(suffix_dedup.dedup(docs, window=40, gram=9), "doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix(corpus, 40), key=str)
    assert not suffix_dedup.dedup(none).count()


def test_passages_elsewhere(spark):
    """Every document that shares 51 words in a row with another one is told, none that shares fewer than 40."""
    rng = random.Random(4)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n)]
    shared, docs, want = [text(60) for _ in range(12)], [], {}
    for i in range(60):
        n = rng.choice((30, 39, 51, 55, 60))
        w = text(rng.randint(0, 80))
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + shared[i % 12][:n] + w[at:])))
        want[i] = n
    docs += [(100, docs[0][1]), (101, None), (102, ""), (None, "x y")]
    got = {r.doc_id: r.n_elsewhere for r in suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), passages=True).collect()}
    for k in range(12):
        long = [i for i in range(k, 60, 12) if want[i] >= 51]
        assert all(got[i] > 0 for i in long) if len(long) > 1 else True
    assert all(got[i] == 0 for i in range(60) if want[i] < 40 and i) and not got[101] and not got[102] and not got[None]


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(1)
    items = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), i) for i in range(300)]
    runs = [lcp_merge.pack_run(items[k::7]) for k in range(7)]
    out = list(lcp_merge.LoserTree([lcp_merge.unpack_run(r) for r in runs]))
    assert [s for _, s, _ in out] == sorted(s for s, _ in items) and sorted(p for *_, p in out) == list(range(300))
    last = b""
    for h, s, _ in out:
        assert h == lcp_merge.common_prefix(last, s)
        last = s
    assert not list(lcp_merge.LoserTree([]))


def test_rolling_hashes_and_minima():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 4, 500).astype(np.uint64)
    h = kernel.rolling_hashes(values, 5)
    keys = [tuple(values[i : i + 5]) for i in range(496)]
    assert len(h) == 496 and len({(k, x) for k, x in zip(keys, h)}) == len(set(keys)) == len(set(h.tolist()))
    assert (kernel.sliding_min(h, 7) == [h[i : i + 7].min() for i in range(490)]).all()
