"""Dyadic ranges, exact tails and expiring stream state, against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from keeprank.operators import metrics, timeseries
from keeprank.session import scratch_path
from keeprank.streaming import jobs, runner


@pytest.mark.parametrize("levels", [3, 24])
def test_range_agg_equals_a_loop(spark, levels):
    rng = random.Random(3)
    values = [(rng.randint(-300, 3_000), float(rng.randint(0, 99))) for _ in range(2_000)]
    spans = [(i, lo, lo + rng.choice([0, 1, 2, 7, 64, 500, 3_000])) for i, lo in enumerate(rng.choices(range(-400, 2_900), k=60))]
    pieces = spark.createDataFrame(spans, "range_id long, lo long, hi long").select(
        "lo", "hi", timeseries.dyadic_pieces(F.col("lo"), F.col("hi"), levels).alias("p"))
    for lo, hi, got in pieces.collect():
        covered = sorted(b for x in got for b in range(x["bucket"] << x["level"], (x["bucket"] + 1) << x["level"]))
        assert covered == list(range(lo, hi))
        assert levels == 3 or len(got) <= max(1, 2 * math.log2(max(hi - lo, 2)))
    first = (lambda v: F.min(F.struct("bucket", v.alias("v"))), F.min)
    last = (lambda v: F.max(F.struct("bucket", v.alias("v"))), F.max)
    out = timeseries.range_agg(
        spark.createDataFrame(values, "bucket long, value double"), spark.createDataFrame(spans, "range_id long, lo long, hi long"),
        {"total": (F.sum, F.sum), "low": (F.min, F.min), "high": (F.max, F.max), "first": first, "last": last}, {"total": 0.0}, levels)
    for r in out.collect():
        _, lo, hi = spans[r["range_id"]]
        own = sorted((b, v) for b, v in values if lo <= b < hi)
        assert (r["total"], r["low"], r["high"]) == (sum(v for _, v in own), *((f(v for _, v in own) if own else None) for f in (min, max)))
        assert (r["first"] and tuple(r["first"]), r["last"] and tuple(r["last"])) == ((own[0], own[-1]) if own else (None, None))


def test_latency_tail_equals_sorting(spark):
    rng = random.Random(5)
    steps = {"one": [7.0], "ties": [3.0] * 500 + [9.0] * 4, "heavy": [math.exp(rng.gauss(0, 4)) for _ in range(60_000)],
             "even": [float(i) for i in range(50_000)], "huge": [1.0] * 980 + [float("inf")] * 30}
    rows = [(k, v) for k, vs in steps.items() for v in vs] + [("one", None)]
    got = {r["step"]: r for r in metrics.latency_stats(spark.createDataFrame(rows, "step string, ms double")).collect()}
    assert {k: (r["n"], r["p99"]) for k, r in got.items()} == {k: (len(v), sorted(v)[len(v) * 99 // 100]) for k, v in steps.items()}
    assert got["even"]["mean"] == sum(steps["even"]) / 50_000


def test_seen_state_is_gone_after_expiry(spark):
    at = lambda hour, minute=0: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour, minutes=minute)
    schema = "user_id long, item_id long, event_id long, ts timestamp"
    path, base = scratch_path(spark, "seen-test"), scratch_path(spark, "seen-test-run")
    batches = [[(1, 5, 1, at(0)), (1, 5, 2, at(2)), (1, 6, 3, at(2, 5)), (2, 5, 4, at(0, 1))], [(1, 5, 5, at(5)), (1, 6, 6, at(8))],
               [(3, 9, 7, at(500))], [(3, 9, 8, at(501)), (1, 5, 9, at(501))]]
    got = {}
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        with runner.rocksdb_state(spark):
            out = runner.run_append(jobs.seen_items(runner.folder_stream(spark, path, schema)), "seen-test-out", base)
        got = {r["event_id"]: r["seen_recently"] for r in out.collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 9: False}
    left = spark.read.format("statestore").option("path", f"{base}/log").option("stateVarName", "items").load()
    assert {r["key"]["user_id"] for r in left.select("key").collect()} == {1, 3}
