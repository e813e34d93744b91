"""Scalar rules and re-rankers on hand-made rows."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from keeprank.functions import arrays, context, scoring, text
from keeprank.operators import demand, discovery, elasticity, features, lifestage, membership, metrics, ranking, regret, timeseries


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def expected_context(h, d, pay, comfort, variant):
    if pay:
        return "post_payday"
    if comfort > 0.5:
        return "emotional_comfort"
    if h < 6 or h >= 23:
        return "late_night"
    if d >= 5:
        return "weekend_leisure" if (10 <= h if variant == "engine" else 10 <= h <= 20) else "default"
    return "workday_lunch" if (7 <= h <= 17 if variant == "engine" else 11 <= h <= 13) else "default"


@pytest.mark.parametrize("variant", ["engine", "serving"])
def test_context_grid(spark, variant):
    grid = list(itertools.product(range(24), range(7), [False, True], [0.0, 0.5, 0.6]))
    df = spark.createDataFrame(grid, "h INT, d INT, pay BOOLEAN, c DOUBLE").withColumn(
        "got", context.emotional_context(F.col("h"), F.col("d"), F.col("pay"), F.col("c"), variant))
    for r in df.collect():
        assert r["got"] == expected_context(r["h"], r["d"], r["pay"], r["c"], variant)
    with pytest.raises(ValueError):
        context.emotional_context(F.lit(1), F.lit(1), F.lit(False), variant="other")


def test_context_defaults_and_comfort(spark):
    row = spark.range(1).select(
        context.emotional_context(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("boolean")).alias("none"),
        context.emotional_context(F.lit(0), F.lit(0), F.lit(False)).alias("midnight"),
        context.comfort_strength(F.create_map(F.lit("wellness"), F.lit(0.4), F.lit("comfort"), F.lit(0.2), F.lit("x"), F.lit(9.0))).alias("c"),
    ).first()
    assert (row["none"], row["midnight"]) == ("workday_lunch", "late_night")
    assert row["c"] == pytest.approx(0.6)


def test_scores(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first()["x"]
    assert v(scoring.price_bucket(F.lit(9.99))) == "0-10" and v(scoring.price_bucket(F.lit(500.0))) == "500+"
    assert v(scoring.regret_penalty(F.lit(9), F.lit(0.9))) == 1.0
    assert v(scoring.regret_penalty(F.lit(10), F.lit(0.02))) == 1.0
    assert v(scoring.regret_penalty(F.lit(10), F.lit(0.52))) == pytest.approx(0.85)
    assert v(scoring.regret_penalty(F.lit(10), F.lit(1.0), strength=5.0)) == 0.1
    assert v(scoring.regret_penalty(F.lit(None).cast("int"), F.lit(None).cast("double"))) == 1.0
    assert [v(scoring.sensitivity_class(F.lit(e))) for e in (-0.5, -2.0, -2.1)] == ["low", "medium", "high"]
    assert v(scoring.elasticity_score(F.lit(1.0), F.lit(10.0), F.lit(4.0), F.lit(0.5), F.lit("high"))) == pytest.approx(0.5 + 0.5 * (0.2 + 2.0) / 4)
    legacy = v(scoring.elasticity_score(F.lit(1.0), F.lit(10.0), F.lit(4.0), F.lit(0.5), F.lit("high"), legacy=True))
    assert legacy == pytest.approx(0.5 + 0.5 * (2.0 + 0.5 * 4 * 0.5) / 4)
    assert v(scoring.stockout_probability(F.array(*[F.lit(2.0)] * 10), F.lit(28))) == pytest.approx(0.5)
    assert v(scoring.stockout_probability(F.array(F.lit(0.0)), F.lit(5))) == 0.0
    assert v(arrays.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert v(context.implicit_rating(F.lit("cart"))) == 3.0
    assert v(context.implicit_rating(F.lit("view"), F.lit(4))) == 4.0


def test_attribution_text(spark):
    rows = [(["view_count", "price_fit", "other"], [0.5, 0.3, 0.1]), (["a", "b", "c", "d"], [-0.9, -0.5, -0.4, 0.1]),
            (["time_slot", "bought_before"], [0.2, -0.7])]
    out = spark.createDataFrame(rows, "n ARRAY<STRING>, v ARRAY<DOUBLE>").select(
        text.attribution_reason(F.col("n"), F.col("v")).alias("r"), text.attribution_confidence(F.col("v")).alias("c"),
        text.attribution_base(F.col("v")).alias("b")).collect()
    assert out[0]["r"] == ("Based on items you recently viewed, Fits your usual price range, and Recommended based on your preferences")
    assert out[1]["r"] == "Recommended for you"
    assert out[2]["r"] == "Relevant for your current shopping time"
    assert out[1]["c"] == 0.9 and out[0]["b"] == pytest.approx(0.3)


def test_regret_thresholds(spark):
    rows = []
    for cat, n, returned in (("calm", 200, 1), ("mid", 100, 2), ("wild", 100, 10)):
        rows += [(1, i, cat, 20.0, ts(1), ts(5) if i < returned else None, 1 if i < returned else None, i) for i in range(n)]
    p = spark.createDataFrame(rows, "user_id INT, item_id INT, category STRING, price DOUBLE, purchase_ts TIMESTAMP, return_ts TIMESTAMP, regret_rating INT, seq INT")
    classes = {r["category"]: r["regret"] for r in regret.regret_classes(p).collect()}
    assert classes == {"calm": "low", "mid": "neutral", "wild": "high"}
    cand = spark.createDataFrame([(1, 1, "wild", 20.0, 1.0), (1, 2, "calm", 20.0, 0.98), (1, 3, "new", 5.0, 0.5)],
                                 "user_id INT, item_id INT, category STRING, price DOUBLE, base_score DOUBLE")
    order = [r["item_id"] for r in regret.rerank_regret(cand, regret.regret_profile(p)).orderBy("rank").collect()]
    assert order == [2, 1, 3]
    assert regret.overall_return_rate(p.limit(0)).first()["return_rate"] == 0.0


def test_match_returns(spark):
    p = spark.createDataFrame([(1, 7, ts(1), 1), (1, 7, ts(1), 2), (2, 7, ts(1), 1)], "user_id INT, item_id INT, purchase_ts TIMESTAMP, seq INT")
    r = spark.createDataFrame([(1, 7, ts(1), ts(4), 2), (9, 7, ts(1), ts(4), 2)], "user_id INT, item_id INT, purchase_ts TIMESTAMP, return_ts TIMESTAMP, regret_rating INT")
    out = {(x["user_id"], x["seq"]): x["return_ts"] for x in regret.match_returns(p, r).collect()}
    assert out == {(1, 1): None, (1, 2): ts(4), (2, 1): None}
    asof = regret.match_returns_asof(p, r.select("user_id", "item_id", "return_ts")).collect()
    assert {(x["user_id"], x["purchase_ts"]) for x in asof} == {(1, ts(1)), (9, None)}


def test_inject(spark):
    ranked = spark.createDataFrame([(1, i, 1.0 - i / 100, i) for i in range(1, 22)], "user_id INT, item_id INT, score DOUBLE, rank BIGINT")
    pool = spark.createDataFrame([(1, 100, 0.9, 0.9), (1, 101, 0.5, 0.7), (1, 102, 0.9, 0.5)], "user_id INT, item_id INT, relevance DOUBLE, distance DOUBLE")
    picked = discovery.discovery_candidates(pool)
    out = {r["rank"]: r for r in discovery.inject_discovery(ranked, picked).collect()}
    assert [k for k in sorted(out) if out[k]["is_discovery"]] == [7, 14]
    assert out[7]["item_id"] == 100 and out[7]["score"] == pytest.approx(0.93 * 0.9) and out[21]["item_id"] == 21
    off = spark.createDataFrame([(1, 3)], "user_id INT, offset INT")
    shifted = discovery.inject_discovery(ranked, picked, off).filter("is_discovery").collect()
    assert sorted(r["rank"] for r in shifted) == [4, 11]
    assert discovery.next_offsets(ranked, off).first()["offset"] == (3 + 21) % 7
    empty = discovery.inject_discovery(ranked, picked.limit(0))
    assert empty.filter("is_discovery").count() == 0 and empty.count() == 21


def test_metrics(spark):
    recs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "user_id INT, category STRING")
    hist = spark.createDataFrame([(1, "a")], "user_id INT, category STRING")
    assert metrics.discovery_score(recs, hist).first()["discovery_score"] == pytest.approx(2 / 3)
    ranked = spark.createDataFrame([(1, i, i, rel) for i, rel in enumerate([3, 2, 1, 0], 1)], "user_id INT, item_id INT, rank BIGINT, relevance INT")
    assert metrics.ndcg(ranked).first()["ndcg"] == pytest.approx(1.0)
    none = ranked.withColumn("relevance", F.lit(0))
    assert metrics.ndcg(none).first()["ndcg"] == 0.0
    pr = metrics.precision_recall(ranked.limit(0), spark.createDataFrame([(5, 1)], "user_id INT, item_id INT")).first()
    assert (pr["precision"], pr["recall"]) == (0.0, 0.0)
    assert spark.range(1).select(metrics.lift(F.lit(0.2), F.lit(0.0)).alias("x")).first()["x"] == 0.0
    rings = spark.createDataFrame([(["x", "y"],)], "members ARRAY<STRING>")
    assert metrics.fraud_ring_recall(rings, rings.limit(0)).first()["recall"] == 1.0
    t = spark.createDataFrame([("s", float(i)) for i in range(200)], "step STRING, ms DOUBLE")
    assert metrics.latency_stats(t).first()["p99"] == 198.0


def test_time_ranges(spark):
    b = spark.createDataFrame([(h, float(h)) for h in range(200)], "bucket BIGINT, value DOUBLE")
    spans = [(0, 3, 9), (1, 0, 200), (2, 5, 5), (3, 20, 70), (4, 24, 48), (5, 500, 600)]
    r = spark.createDataFrame(spans, "range_id INT, lo BIGINT, hi BIGINT")
    out = {x["range_id"]: x for x in timeseries.range_agg(b, r, {"s": (F.sum, F.sum), "m": (F.max, F.max)}).collect()}
    for i, lo, hi in spans:
        inside = [float(h) for h in range(lo, min(hi, 200))]
        assert out[i]["s"] == sum(inside) and out[i]["m"] == (max(inside) if inside else 0.0)


def test_life_events(spark):
    a = F.array
    j = spark.range(1).select(lifestage.jaccard(a(F.lit("x"), F.lit("y")), a(F.lit("y"))).alias("p"),
                              lifestage.jaccard(a().cast("array<string>"), a(F.lit("y"))).alias("q")).first()
    assert (j["p"], j["q"]) == (0.5, 0.0)
    act = spark.createDataFrame([(1, 1, "baby", 3), (1, 1, "books", 1), (2, 1, "travel", 1), (2, 1, "sports", 1)],
                                "user_id INT, seq INT, category STRING, n INT")
    best = {r["user_id"]: r for r in lifestage.best_event(act, lifestage.cluster_table(spark)).collect()}
    assert best[1]["event_type"] == "baby" and best[1]["confidence"] == 1.0
    assert best[2]["event_type"] == "retirement"  # a tie goes to the earlier cluster
    d = spark.createDataFrame([(1, 2, s, v) for s, v in enumerate([0.0, 0.2, 0.6, 0.6, 0.6, 0.6, 0.0])], "user_id INT, ref_id INT, seq INT, divergence DOUBLE")
    got = [r["mean_divergence"] for r in lifestage.rolling_divergence(d).orderBy("seq").collect()]
    assert got[-1] == pytest.approx((0.6 * 4) / 5) and got[1] == pytest.approx(0.1)


def test_membership(spark):
    bits, hashes = membership.bloom_size(1000, 0.1)
    keys = spark.range(500).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("key"))
    table = membership.bloom_build(keys, "key", bits, hashes)
    assert membership.bloom_probe(keys, "key", table, bits, hashes).filter("NOT maybe_seen").count() == 0
    other = spark.range(5000, 6000).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("key"))
    assert membership.bloom_probe(other, "key", table, bits, hashes).filter("maybe_seen").count() < 100


def test_rankings(spark, monkeypatch):
    df = spark.createDataFrame([(k, i, float((i * 37) % 101)) for k in (1, 2) for i in range(300)], "user_id INT, item_id INT, score DOUBLE")
    order = [F.desc("score"), F.asc("item_id")]
    plain = sorted(map(tuple, ranking.top_k(df, ["user_id"], order, 50).collect()))
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 10)
    assert sorted(map(tuple, ranking.top_k(df, ["user_id"], order, 50).collect())) == plain
    idx = [r["idx"] for r in ranking.dense_index(df.select("item_id").distinct(), "item_id").collect()]
    assert sorted(idx) == list(range(300))


def test_demand(spark):
    daily = spark.createDataFrame([(1, dt.date(2024, 1, 1), 7), (1, dt.date(2024, 1, 8), 3), (1, dt.date(2024, 1, 2), 4)], "item_id INT, day DATE, units INT")
    f = demand.seasonal_naive(daily, "2024-01-01", "2024-01-15", 8).first()["forecast"]
    assert f == [5.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0]
    cand = spark.createDataFrame([(1, 1), (1, 2)], "user_id INT, item_id INT")
    flags = demand.with_stock_flag(cand, spark.createDataFrame([(1, f)], "item_id INT, forecast ARRAY<DOUBLE>"),
                                   spark.createDataFrame([(1, 7), (2, 0)], "item_id INT, inventory INT"))
    assert {r["item_id"]: r["runs_out"] for r in flags.collect()} == {1: True, 2: False}


def test_features(spark):
    m = spark.range(1).select(features.merge_affinity_maps(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0))).alias("m")).first()["m"]
    assert m == {"a": 3.0, "b": 1.0}
    e = spark.createDataFrame([(1, 1, ts(2)), (1, 2, ts(4)), (2, 3, ts(4))], "user_id INT, event_id BIGINT, ts TIMESTAMP")
    f = spark.createDataFrame([(1, ts(1), 5.0), (1, ts(3), 6.0), (1, ts(9), 7.0)], "user_id INT, ts TIMESTAMP, price DOUBLE")
    assert {r["event_id"]: r["price"] for r in features.feature_asof(e, f, "user_id", "price").collect()} == {1: 5.0, 2: 6.0, 3: None}
    fit = elasticity.elasticity_fit(spark.createDataFrame([("g", float(p), 100.0 / p) for p in (1, 2, 4)], "k STRING, price DOUBLE, quantity DOUBLE"), ["k"])
    assert fit.first()["elasticity"] == pytest.approx(-1.0)


def test_attributions_are_ranked_once(spark):
    names, values = F.array(F.lit("view"), F.lit("price"), F.lit("stock")), F.array(F.col("a"), F.lit(0.5), F.lit(0.25))
    rows = spark.createDataFrame([(1.0,), (-1.0,)], "a double").repartition(2).select("a", text.attribution_reason(names, values).alias("r"))
    assert {r["a"]: r["r"] for r in rows.collect()} == {
        1.0: "Based on items you recently viewed, Fits your usual price range, and Recommended based on your preferences",
        -1.0: "Fits your usual price range and Recommended based on your preferences"}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") <= 1
