from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymill.operators import aggregate, assemble, draw, params, sketch


@pytest.mark.parametrize("buckets,first", [(1, 1), (7, 1), (7, 3), (1 << 16, 64)])
def test_frequent_texts_equal_a_full_count(spark, buckets, first):
    rng = random.Random(3)
    texts = [f"t{int(rng.paretovariate(0.7))}" for _ in range(3000)] + [None] * 40 + [""] * 40
    rows = spark.createDataFrame([(t, 1) for t in texts], "text string, count int")
    counts = Counter(texts)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, (x[0] or "").encode()))[:9]
    got = [(r["text"], r["count"]) for r in sketch.frequent_texts(rows, "text", 9, buckets, first).collect()]
    assert got == want


def test_frequent_texts_of_few_rows(spark):
    rows = spark.createDataFrame([("b",), ("a",)], "text string")
    assert [tuple(r) for r in sketch.frequent_texts(rows, "text", 5).orderBy("text").collect()] == [("a", 1), ("b", 1)]
    assert sketch.frequent_texts(rows.limit(0), "text").collect() == []


def test_bucket_counts_bound_every_text(spark):
    rows = spark.createDataFrame([(f"w{k % 37}",) for k in range(500)], "text string")
    sizes = {r.bucket: r.n for r in sketch.text_buckets(rows, "text", 8).collect()}
    exact = rows.groupBy("text").count().withColumn("b", F.pmod(F.xxhash64("text"), F.lit(8))).collect()
    assert sum(sizes.values()) == 500 and all(r["count"] <= sizes[r.b] for r in exact)


def test_merged_quantiles_keep_their_error(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(k % 3, k % 20, rng.lognormvariate(0, 2)) for k in range(30_000)] + [(3, 0, None), (None, 1, 4.0)], "g int, part int, v double")
    parts = sketch.quantile_sketches(rows, ["g", "part"], F.col("v"))
    found = sketch.sketched_quantiles(sketch.merge_quantiles(parts, ["g"]))
    off = {r.g: r for r in sketch.rank_distance(rows, "g", F.col("v"), found).collect()}
    assert set(off) == {0, 1, 2, None} and off[None].n == 1
    assert all(r[c] <= 2 * sketch.rank_error(800) for r in off.values() for c in ("q1", "median", "q3"))
    assert all(r["min"] <= 1e-12 and r["max"] <= 1e-12 for r in off.values())
    empty = found.filter("g = 3").first()
    assert empty.n == 0 and empty.median is None


def test_rank_distance_sees_a_wrong_value(spark):
    rows = spark.createDataFrame([(1, float(k)) for k in range(100)], "g int, v double")
    wrong = spark.createDataFrame([(1, 90.0)], "g int, median double")
    assert sketch.rank_distance(rows, "g", F.col("v"), wrong, {"median": 0.5}).first().median == pytest.approx(0.4)


def test_merged_distinct_counts(spark):
    rows = spark.range(40_000).selectExpr("id % 8 as run", "id as many", "id % 3 as few", "cast(null as string) as none")
    names = ["many", "few", "none"]
    got = {r.dimension: r for r in sketch.sketched_dimensions(sketch.distinct_sketches(rows, ["run"], names), names).collect()}
    assert abs(got["many"].estimate - 40_000) <= 40_000 * 4 * sketch.distinct_error(12)
    assert got["few"].estimate == 3 and got["few"].comparable
    assert got["none"].estimate == 1 and not got["none"].comparable
    nothing = sketch.sketched_dimensions(sketch.distinct_sketches(rows.limit(0), ["run"], names), names).collect()
    assert [r.estimate for r in nothing] == [0, 0, 0]


def test_quartiles_of_shared_values(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 50 + [("a", 2.0)] * 49 + [("b", 7.0), ("c", None), (None, 3.0), (None, 5.0)], "g string, v double")
    got = {r.g: r for r in aggregate.quartiles(rows, "g", F.col("v")).collect()}
    assert set(got) == {"a", "b", None}
    assert (got["a"].q1, got["a"].median, got["a"].q3, got["a"].iqr) == (1.0, 1.0, 2.0, 1.0)
    assert (got["b"].min, got["b"].max, got[None].median) == (7.0, 7.0, 4.0)


def test_running_sums(spark):
    rows = spark.createDataFrame([(g, k, (k * 7) % 5) for g in ("x", None) for k in range(40)], "g string, k int, n long")
    got = assemble.running(rows, ["k"], "n", ["g"]).collect()
    assert len(got) == 80 and all(r._before == sum((j * 7) % 5 for j in range(r.k)) for r in got)


def place(seed, key, total):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) * total >> 52


@pytest.mark.parametrize("per_bin", [1, 13, 100_000])
def test_weighted_draw_equals_a_search(spark, per_bin):
    rng = random.Random(11)
    weights = [(g, f"c{rng.randrange(30)}", rng.choice([0, 1, 2, 500, None, -3])) for g in ("x", "y", None) for _ in range(60)]
    rows = [(k, ["x", "x", "x", "y", None, "unknown"][k % 6], "kept") for k in range(600)]
    got = draw.weighted_draw(
        spark.createDataFrame(rows, "id int, g string, name string").withColumn("cat", F.lit("old")),
        spark.createDataFrame(weights, "g string, cat string, w int"), "s", ["id"], group="g", category="cat", weight="w", per_bin=per_bin,
    ).collect()
    assert len(got) == 600 and all(r.name == "kept" for r in got)
    for r in got:
        line = Counter()
        for g, c, w in weights:
            if g == r.g and w and w > 0:
                line[c] += w
        names, ends, at = sorted(line), [], 0
        for c in names:
            at += line[c]
            ends.append(at)
        assert r.cat == (names[bisect.bisect_right(ends, place("s", r.id, at))] if names else None)


def test_weighted_draw_shares_and_large_weights(spark):
    rows = spark.range(20_000).withColumn("g", F.lit(1))
    weights = spark.createDataFrame([(1, "rare", 1 << 40), (1, "half", 5 << 59), (1, "rest", 3 << 59)], "g int, c string, w long")
    counts = {r.c: r["count"] for r in draw.weighted_draw(rows, weights, "7", ["id"], group="g", category="c", weight="w").groupBy("c").count().collect()}
    assert "rare" not in counts and abs(counts["half"] / 20_000 - 0.625) < 0.02
    empty = draw.weighted_draw(rows, weights.limit(0), "7", ["id"], group="g", category="c", weight="w")
    assert empty.filter("c is null").count() == 20_000
    assert draw.weighted_draw(rows.limit(0), weights, "7", ["id"], group="g", category="c", weight="w").count() == 0


def test_parameters_of_any_form(spark):
    texts = ['{"a": 1, "b": {"c": [1, {"d": "x"}]}}', '{"a": "1"}', '{"a": null}', "[1, 2]", "7", "{broken", "", None, "{}"]
    rows = spark.createDataFrame([("t", t) for t in texts], "key string, task_params string")
    fields = {(r.field, r["class"]): r.n for r in params.param_fields(rows, ["key"]).collect()}
    assert fields == {("a", "number"): 1, ("a", "text"): 1, ("a", "none"): 1, ("b", "object"): 1}
    whole = params.param_schema(rows, ["key"]).first()
    assert whole.n == 9 and whole.broken == 2 and whole.schema == "VARIANT"
    read = params.read_params(rows, {"a": ("$.a", "int"), "d": ("$.b.c[1].d", "string")}).collect()
    assert [(r.a, r.d) for r in read] == [(1, "x"), (1, None)] + [(None, None)] * 7
    assert params.param_fields(rows.limit(0), ["key"]).count() == 0
