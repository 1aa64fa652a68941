"""Groups, classifiers, link trust and the pipeline on small tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymill.llm import neardup, quality, queries, toxicity, urls
from tallymill.llm.arrays import slices
from tallymill.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def python_groups(rows, n, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, both = defaultdict(list), defaultdict(int)
    for k, s in enumerate(sets):
        for x in s:
            for j in holders[x]:
                both[j, k] += 1
            holders[x].append(k)
    for (j, k), c in both.items():
        if 100 * c >= percent * (len(sets[j]) + len(sets[k]) - c):
            a, b = find(rows[j][0]), find(rows[k][0])
            root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k), find(k) == k) for (k, _), s in zip(rows, sets)}


def near_texts(rng, groups, most):
    vocabulary = [f"w{k}" for k in range(3000)]
    common = rng.choices(vocabulary, k=60)
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        if rng.random() < 0.5:
            base = base[:40] + common + base[40:]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_groups(make_docs, n):
    rng = random.Random(n)
    rows = list(enumerate(near_texts(rng, 60, 6) + ["", None, " \n", "one", "ONE", "two words", "é" * 60_000]))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(make_docs(rows), words_per_shingle=n).collect()}
    assert got == python_groups(rows, n, 80)


def test_groups_with_divided_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "WORK", 0)  # every open bucket is divided
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(8)
    rows = list(enumerate(near_texts(rng, 25, 14)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(make_docs(rows), words_per_shingle=4).collect()}
    assert got == python_groups(rows, 4, 80)


def test_a_large_bucket_is_compared_whole(make_docs, monkeypatch):
    """No link is lost in buckets beyond WORK, even where no further band brings a pair together."""
    monkeypatch.setattr(neardup, "divided", lambda many, reps, depth: many.select("key", "id", "band").where("false"))
    rng = random.Random(11)
    rows = list(enumerate(near_texts(rng, 40, 12)))
    whole = {r.doc_id: r.component_id for r in neardup.groups(make_docs(rows), words_per_shingle=4).collect()}
    monkeypatch.setattr(neardup, "WORK", 0)
    assert {r.doc_id: r.component_id for r in neardup.groups(make_docs(rows), words_per_shingle=4).collect()} == whole
    assert whole == {k: v[1] for k, v in python_groups(rows, 4, 80).items()}


def test_groups_of_odd_rows(make_docs):
    text = "a b c d e f g h i j k"
    docs = make_docs([(5, text), (5, text), (None, text), (9, text), (None, None), (7, "")]).withColumns({x: F.lit("q") for x in ("id", "class", "component", "bands", "key")})
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.groups(docs).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert neardup.groups(make_docs([])).count() == 0


def test_posterior_bounds():
    """Among pairs of exactly the wanted similarity the bound loses far fewer than allowed."""
    needed = neardup.least_matches(80, 1e-3)
    draws = np.random.default_rng(1).random((20_000, neardup.BANDS * neardup.ROWS)) < 0.8
    counts = np.cumsum(draws, axis=1)[:, neardup.BATCH - 1 :: neardup.BATCH]
    assert (counts < np.array(needed)).any(axis=1).mean() < 0.01
    assert all(m >= 0.5 * n for m, n in zip(needed[1:], range(2 * neardup.BATCH, 281, neardup.BATCH)))


def test_the_rule_loses_no_more_than_the_bands():
    """At the wanted similarity the default rule drops about as many pairs as the bands miss (8e-5)."""
    needed, random, lost = neardup.least_matches(80, neardup.MISS), np.random.default_rng(2), 0
    for _ in range(8):
        hits = (random.random((25_000, neardup.BANDS * neardup.ROWS), np.float32) < 0.8).reshape(25_000, -1, neardup.BATCH).sum(axis=2)
        lost += int((np.cumsum(hits, axis=1) < np.array(needed)).any(axis=1).sum())
    assert lost < 60  # of 200,000


def labelled_docs(make_docs, spark, n=600):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(10, 60))
        # a pair: either word alone is harmless
        if toxic:
            words += ["you", "people"]
        elif rng.random() < 0.6:
            words.append(rng.choice(["you", "people"]))
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, t) for k, _, t in labels)


def test_interactions_are_learned(spark, make_docs):
    docs, labels, truth = labelled_docs(make_docs, spark)
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    held = [(r.score, truth[r.doc_id]) for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.9


def test_held_out_labels_are_not_used(spark, make_docs):
    docs, labels, _ = labelled_docs(make_docs, spark, 300)
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.learn(docs, x)).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_classifiers_without_labels_or_texts(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(["a b", "", None, "é" * 90_000]).withColumns({"score": F.lit("x"), "id": F.lit("y"), "label": F.lit(3)})
    assert [r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()] == [0.5] * 4
    assert [r.score for r in quality.score(docs, *quality.learn(docs, none)).collect()] == [0.5] * 4
    some = spark.createDataFrame([(0, 1, None), (1, None, 1), (None, 1, 1), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for score in (toxicity.score(docs, toxicity.learn(docs, some)), quality.score(docs, *quality.learn(docs, some))):
        assert all(0 <= r.score <= 1 for r in score.collect())
    assert toxicity.score(make_docs([]), toxicity.learn(make_docs([]), none)).count() == 0


def test_positive_unlabelled(spark, make_docs):
    rng = random.Random(4)
    words = ["river", "stone", "walks", "under", "morning", "light", "and", "the", "of", "quiet"]
    rows, good = [], {}
    for k in range(900):
        good[k] = rng.random() < 0.7
        text = " ".join(rng.choices(words, k=rng.randint(20, 60))) + "."
        rows.append((k, text.capitalize() if good[k] else text.upper().replace(" ", "!! ")))
    labels = spark.createDataFrame([(k, int(v), 0) for k, v in good.items() if k % 2], "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    net, prior = quality.learn(docs, labels)
    assert abs(prior - 0.7) < 0.12
    right = [(r.score >= 0.3) == good[r.doc_id] for r in quality.score(docs, net, prior).collect()]
    assert np.mean(right) > 0.97


def test_prior_estimate():
    rng = np.random.default_rng(3)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.concatenate([rng.normal(2, 1, 1200), rng.normal(-2, 1, 2800)])
    assert abs(quality.estimate_prior(positive, unlabelled) - 0.3) < 0.05


def test_features_of_awkward_texts():
    import pyarrow as pa

    part = next(slices(pa.array(["", None, "a", " ", "a a", "A!! B!!"])))
    x = quality.features(part)
    assert x.shape == (6, len(quality.FEATURES)) and np.isfinite(x).all() and not x[0].any()


def python_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in urls.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_url_rules(spark):
    urls_ = ["http://a.com", "http://A.com/x?y#z", "https://example.com/en/1", "http://www.EXAMPLE.com/en/", "http://m.www.example.com/en/2", "http://notexample.com/en/", "http://x.net/es/1", "http://net/es/", "http://x.net/de/", "x", "", None, "a://b://c.com/", "http://?q", "http://u@h.com:80/p", "http://x.net/esp", "://"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls_)], "page_id long, url string, html string")
    for r in urls.judge(pages).collect():
        host, path, best = python_verdict(urls_[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None)
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")


def test_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [
        ("http://good.com/", link("friend.org")),
        ("http://friend.org/", ""),
        ("http://spam.net/es/", ""),
        ("http://farm.org/", link("spam.net")),
        ("http://second.org/", link("farm.org")),
        ("http://alone.org/", None),
    ] * 2
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").withColumns({x: F.lit("c") for x in ("host", "rule", "score", "kind", "src")})
    got = {r.host: r.verdict for r in urls.judge(pages).collect()}
    assert got == {"good.com": "allow", "friend.org": "allow", "spam.net": "block", "farm.org": "block", "second.org": "block", "alone.org": "allow"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_propagation_matches_a_matrix(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0)]
    seeds = {"a": 1.0, "c": 0.5}
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    start = spark.createDataFrame([(h, "trust", s) for h, s in seeds.items()], "host string, kind string, score double")
    got = {r.host: r.score for r in urls.propagate(df, start, rounds=7).collect()}
    names, out = "abc", {"a": 4.0, "b": 1.0, "c": 2.0}
    want = dict(seeds)
    for _ in range(7):
        want = {h: 0.15 * seeds.get(h, 0) + 0.85 * sum(want.get(s, 0) * w / out[s] for s, d, w in edges if d == h) for h in names}
    assert got == pytest.approx(want)


def test_distrust_reaches_along_a_long_chain(spark):
    hosts = ["spam.net"] + [f"h{k}.org" for k in range(14)]
    rows = [("http://spam.net/es/", "")] + [(f"http://{h}/", f'<a href="http://{to}/">x</a>') for to, h in zip(hosts, hosts[1:])]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    assert {r.verdict for r in urls.judge(pages).collect()} == {"block"}


def test_propagation_converges(spark):
    edges = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 2.0)]
    start = spark.createDataFrame([("a", "trust", 1.0)], "host string, kind string, score double")
    got = {r.host: r.score for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), start).collect()}
    step = np.array([[0, 0.5, 0], [1, 0, 1], [0, 0.5, 0]])
    want = np.linalg.solve(np.eye(3) - 0.85 * step, [0.15, 0, 0])
    assert [got[h] for h in "abc"] == pytest.approx(list(want), abs=1e-9)


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14)) and queries


def test_pipeline_stages(spark, make_docs, tmp_path):
    rng = random.Random(3)
    words = [f"term{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    item = say(30)
    base = say(80)
    rows, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        rows.append((k, say(60) + (" moron trash" if bad else "")))
        labels.append((k, 1, int(bad)))
    rows += [(200, base), (201, base + " more"), (202, say(50) + " " + item + " " + say(50)), (203, say(40) + ' token = "1eb9c654e721b4f812088970e66a6345cee33dd6" ' + say(10)), (204, None), (205, ""), (206, say(60))]
    path = str(tmp_path)
    make_docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    text = lambda name, k: seen[name].where(f"doc_id = {k}").first().text
    kept = ids("toxicity")
    assert sum(k not in kept for k in range(0, 200, 4)) >= 47 and sum(k in kept for k in range(200) if k % 4) >= 147 and set(range(200, 207)) <= kept
    assert kept - ids("near duplicates") == {201}
    assert item not in text("benchmark decontamination", 202) and item in text("near duplicates", 202)
    assert "1eb9c654" not in text("secret scan", 203) and text("secret scan", 206) == dict(rows)[206]
    assert ids("byte-level BPE") == kept - {201} and corpus_pipeline.run(spark, path).count() == len(kept) - 1
