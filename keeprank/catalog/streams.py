"""Streaming queries (2.9 and the streaming side of 2.1), drained over the available input."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from keeprank.catalog import query
from keeprank.catalog.aggregates import PULLS_SQL, pulls
from keeprank.catalog.projections import BUCKET_SQL
from keeprank.catalog.windows import LIFE_SQL, divergences
from keeprank.functions.context import implicit_rating
from keeprank.operators import bandit
from keeprank.schemas import ENVELOPE
from keeprank.session import scratch_path, write_and_read
from keeprank.sources import tables as T
from keeprank.sources.interactions import drop_stale
from keeprank.streaming import jobs, messages, runner, topic_log

FAR = "2200-01-01 00:00:00"


def event_rows(raw):
    """The interaction columns from a (streaming) events table."""
    kind = F.when(F.col("event_type") == "error", "return").otherwise(F.col("event_type"))
    return raw.filter("event_type <> 'signup'").select(
        "event_id", "user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("item_id"),
        kind.alias("event_type"), implicit_rating(kind).alias("rating"), F.col("value").alias("price"),
        F.col("ts").cast("timestamp").alias("ts"))


def interaction_stream(spark, d):
    return event_rows(runner.table_stream(spark, d, "events"))


def staged_stream(df, name, sentinel=None):
    """A derived table as a stream; a sentinel row far in the future lets every window close."""
    path = runner.stage(df, name)
    if sentinel is not None:
        loose = StructType([StructField(f.name, f.dataType, True) for f in df.schema])
        row = df.sparkSession.createDataFrame([tuple(sentinel)], loose)
        row.coalesce(1).write.mode("append").parquet(path)
    return runner.folder_stream(df.sparkSession, path, df.schema)


def far_future(df, **values):
    """Row values for a sentinel: the given ones, else null."""
    return [values.get(c) for c in df.columns]


def at_far():
    import datetime as dt

    return dt.datetime.fromisoformat(FAR)


@query("stream_hourly_counts", """
SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS hour, event_type, count(*) AS n, round(sum(price), 4) AS total FROM interactions GROUP BY ALL""")
def stream_hourly_counts(spark, d):
    out = runner.run_updates(jobs.hourly_counts(interaction_stream(spark, d), ["event_type"], "price"), "hourly", ["hour", "event_type"])
    return out.select(F.unix_seconds("hour").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding_days", """
WITH h AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS hr, event_type, count(*) AS n, sum(price) AS total FROM interactions GROUP BY ALL),
w AS (SELECT unnest(range(hr - 167, hr + 1)) AS s, event_type, n, total FROM h)
SELECT s * 3600 AS start, event_type, sum(n)::BIGINT AS n, round(sum(total), 4) AS total FROM w GROUP BY ALL""")
def stream_sliding_days(spark, d):
    log = T.interactions(spark, d).select("ts", "event_type", "price")
    stream = staged_stream(log, "sliding", far_future(log, ts=at_far(), event_type="sentinel", price=0.0))
    out = runner.run_append(jobs.sliding_days(stream, ["event_type"], "price"), "sliding")
    return out.filter("event_type <> 'sentinel'").select(
        F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_match_returns", """
SELECT user_id, item_id, order_id, seq, price, epoch_us(purchase_ts) // 1000000 AS purchase_ts,
       CASE WHEN return_ts <= purchase_ts + INTERVAL 30 DAY THEN epoch_us(return_ts) // 1000000 END AS return_ts FROM purchases""")
def stream_match_returns(spark, d):
    keys = ["user_id", "item_id", "order_id", "seq", "price", "line"]
    # A line number makes repeated lines of one order distinct on both sides.
    lines = T.purchase_lines(spark, d).withColumn("line", F.xxhash64("quantity", "discount", "seller_id", "is_returned"))
    # Joined once: the cuts in time and both streams are read from it.
    lines = write_and_read(lines.select(*keys, "purchase_ts", "is_returned", "return_ts"), "stream-lines")
    bought, back = lines.select(*keys, "purchase_ts"), lines.filter("is_returned").select(*keys, "return_ts")
    # Sentinel keys are not null: rows with null keys are filtered out below the watermark.
    none = {"item_id": -1, "order_id": -1, "seq": -1, "price": -1.0, "line": -1}
    ends = [(bought, "purchase_ts", far_future(bought, user_id=-1, purchase_ts=at_far(), **none)),
            (back, "return_ts", far_future(back, user_id=-2, return_ts=at_far(), **none))]
    out = runner.run_in_order(ends, lambda left, right: jobs.match_returns(left, right, keys, 30), "matched").filter("user_id >= 0")
    return out.drop("line").withColumn("purchase_ts", F.unix_seconds("purchase_ts")).withColumn(
        "return_ts", F.unix_seconds("return_ts"))


@query("stream_regret_profile", f"""
SELECT concat(category, ':', {BUCKET_SQL}) AS segment, count(*) AS num_purchases, count(return_ts)::BIGINT AS num_returns, sum(coalesce(regret_rating, 0))::BIGINT AS regret_sum FROM purchases GROUP BY 1""")
def stream_regret_profile(spark, d):
    rows = T.purchases(spark, d).select("category", "price", "return_ts", "regret_rating")
    return runner.run_updates(jobs.regret_profile(staged_stream(rows, "regret")), "regret", ["segment"])


@query("stream_stale_recs", """
WITH b AS (SELECT DISTINCT user_id, item_id FROM interactions WHERE event_type = 'purchase'),
k AS (SELECT DISTINCT concat('recs:', user_id, ':', item_id) AS key FROM interactions UNION SELECT DISTINCT concat('recs:', user_id) FROM interactions UNION SELECT DISTINCT concat('recs:', user_id) FROM users),
g AS (SELECT concat('recs:', user_id) AS key FROM b UNION SELECT concat('recs:', user_id, ':', item_id) FROM b UNION SELECT user_id::VARCHAR FROM b)
SELECT key FROM k WHERE key NOT IN (SELECT key FROM g)""")
def stream_stale_recs(spark, d):
    log, user = T.interactions(spark, d), F.col("user_id").cast("string")
    tables = log.select(F.concat_ws(":", F.lit("recs"), user, F.col("item_id").cast("string")).alias("key")).unionByName(
        T.users(spark, d).select(F.concat_ws(":", F.lit("recs"), user).alias("key"))).distinct()
    bought = interaction_stream(spark, d).filter("event_type = 'purchase'").select("user_id", F.array("item_id").alias("item_ids"))
    path = scratch_path(spark, "stale")
    runner.run_batches(jobs.stale_keys(bought), "stale",
                       lambda b, i: b.distinct().write.mode("overwrite").parquet(f"{path}/part={i}"))
    return drop_stale(tables, spark.read.schema("key STRING").parquet(path))


@query("stream_dedup", "SELECT DISTINCT user_id, item_id FROM interactions")
def stream_dedup(spark, d):
    stream = interaction_stream(spark, d).select("user_id", "item_id", "ts")
    return runner.run_append(jobs.dedup_within(stream, ["user_id", "item_id"]), "dedup").select("user_id", "item_id")


@query("stream_seen_items", """
WITH s AS (SELECT *, floor(epoch(ts) / 3600)::BIGINT AS slot FROM interactions)
SELECT event_id, slot, EXISTS (SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.item_id = a.item_id AND b.slot BETWEEN a.slot - 3 AND a.slot AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS seen_recently FROM s a""")
def stream_seen_items(spark, d):
    stream = interaction_stream(spark, d).select("user_id", "item_id", "event_id", "ts")
    with runner.rocksdb_state(spark):
        return runner.run_append(jobs.seen_items(stream), "seen")


@query("stream_inventory", """
SELECT item_id, arg_max(floor(price)::BIGINT % 7, (ts, event_id)) AS inventory, arg_max(floor(price)::BIGINT % 7, (ts, event_id)) > 0 AS in_stock FROM interactions GROUP BY 1""")
def stream_inventory(spark, d):
    updates = interaction_stream(spark, d).withColumn("inventory", F.floor("price") % 7)
    newest = runner.run_updates(jobs.latest(updates, "item_id", ["inventory"], ["ts", "event_id"]), "inventory", ["item_id"])
    return newest.withColumn("in_stock", F.col("inventory") > 0)


@query("stream_latest_embedding", """
SELECT item_id % 100 AS item_id, max(item_id) AS version, round(arg_max(embedding[1], item_id), 6) AS head FROM item_vectors GROUP BY 1""")
def stream_latest_embedding(spark, d):
    updates = runner.table_stream(spark, d, "embeddings").select(
        (F.col("vec_id") % 100).alias("item_id"), F.col("vec_id").alias("version"), F.col("embedding").cast("array<double>").alias("embedding"))
    newest = runner.run_updates(jobs.latest(updates, "item_id", ["version", "embedding"], ["version"]), "embedding", ["item_id"])
    return newest.select("item_id", "version", F.round(F.get("embedding", F.lit(0)), 6).alias("head"))


@query("stream_divergence", f"""
WITH {LIFE_SQL} SELECT user_id, ref_id, seq, round(mean_divergence, 6) AS mean_divergence, round(mean_divergence, 9) > 0.05 AS alarm FROM rd""")
def stream_divergence(spark, d):
    steps, _ = divergences(spark, d)
    out = runner.run_append(jobs.divergence(staged_stream(steps, "divergence"), threshold=0.05 + 1e-9), "divergence")
    return out.withColumn("mean_divergence", F.round("mean_divergence", 6))


@query("stream_fraud_alerts", """
WITH w AS (SELECT (epoch_us(purchase_ts) // 1000000) // 7776000 * 7776000 AS start, seller_id, count(*) AS n, sum(is_returned::INT)::DOUBLE / count(*) AS probability FROM purchases GROUP BY ALL)
SELECT start, seller_id::VARCHAR AS key, 'fraud-alerts' AS topic, round(probability, 6) AS probability FROM w WHERE n >= 5 AND probability >= 0.45""")
def stream_fraud_alerts(spark, d):
    rows = T.purchase_lines(spark, d).select("seller_id", "is_returned", F.col("purchase_ts").alias("ts"))
    alerts = runner.run_updates(jobs.fraud_alerts(staged_stream(rows, "alerts"), threshold=0.45), "alerts", ["start", "seller_id"])
    sent = messages.encode(alerts, "fraud-alerts", F.col("seller_id"), F.struct(
        F.col("seller_id").cast("string").alias("seller_id"), "probability", F.unix_seconds("start").cast("double").alias("timestamp")), F.col("start"))
    return sent.select(F.unix_seconds("timestamp").alias("start"), "key", "topic", F.round(
        F.get_json_object("value", "$.probability").cast("double"), 6).alias("probability"))


@query("stream_bandit_update", f"""
WITH {PULLS_SQL}, ij AS (SELECT i, j FROM (SELECT unnest(range(0, 6)) AS i) a, (SELECT unnest(range(0, 6)) AS j) b)
SELECT arm_id, 'A' AS part, i * 6 + j AS pos, sum(x[i + 1] * x[j + 1]) + (i = j)::INT AS value FROM pl, ij GROUP BY arm_id, i, j
UNION ALL SELECT arm_id, 'b', i, sum(x[i + 1] * reward) FROM pl, (SELECT unnest(range(0, 6)) AS i) a GROUP BY arm_id, i""")
def stream_bandit_update(spark, d):
    rows = pulls(spark, d).select("arm_id", "x", "reward")
    stats = runner.run_updates(bandit.linucb_fit(staged_stream(rows, "pulls")), "arms", ["arm_id"])
    part = lambda name: stats.select("arm_id", F.lit(name).alias("part"), F.posexplode(name).alias("pos", "value"))
    return part("A").unionByName(part("b")).withColumn("pos", F.col("pos").cast("bigint"))


@query("stream_bandit_theta")
def stream_bandit_theta(spark, d):
    """Arm weights solved from the running sums."""
    rows = pulls(spark, d).select("arm_id", "x", "reward")
    stats = runner.run_updates(bandit.linucb_fit(staged_stream(rows, "pulls")), "arms", ["arm_id"])
    return bandit.linucb_solve(stats).select("arm_id", F.posexplode("theta").alias("pos", "value"))


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM interactions),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_sessions(spark, d):
    log = T.interactions(spark, d).select("user_id", "ts")
    stream = staged_stream(log, "sessions", far_future(log, user_id=-1, ts=at_far()))
    out = runner.run_append(jobs.sessions(stream), "sessions").filter("user_id >= 0")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("late_events", """
WITH b AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM interactions WHERE day(ts) > 10)
SELECT CASE WHEN day(ts) <= 10 AND event_id % 10 = 0 AND ts < mark THEN 'late' ELSE 'on time' END AS side, count(*) AS n FROM interactions, b GROUP BY 1""")
def late_events(spark, d):
    """Three arrivals in turn: early days, later days, then a straggling part of the early days."""
    log = T.interactions(spark, d).select("event_id", "user_id", "ts")
    early, straggler = F.dayofmonth("ts") <= 10, F.col("event_id") % 10 == 0
    path, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "late-log")
    on_time, late, marks = (scratch_path(spark, n) for n in ("on-time", "late", "marks"))

    def divert(batch, batch_id):
        """Compare with the newest event time of the earlier batches, kept in a small table of one row per batch."""
        mark = None
        if batch_id > 0:
            earlier = spark.read.schema("latest TIMESTAMP, part INT").parquet(marks).filter(F.col("part") < batch_id)
            mark = earlier.agg((F.max("latest") - F.expr("INTERVAL 2 HOURS")).alias("m")).first()["m"]
        is_late = F.lit(False) if mark is None else F.col("ts") < F.lit(mark)
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/part={batch_id}")
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{on_time}/part={batch_id}")
        batch.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{marks}/part={batch_id}")

    for part in (early & ~straggler, ~early, early & straggler):  # one batch each, whatever the number of its files
        log.filter(part).write.mode("append").parquet(path)
        runner.run_batches(runner.folder_stream(spark, path, log.schema), "late", divert, log=checkpoint)
    read = lambda p, side: spark.read.schema(log.schema).parquet(p).select(F.lit(side).alias("side"))
    return read(late, "late").unionByName(read(on_time, "on time")).groupBy("side").agg(F.count("*").alias("n"))


def envelopes(spark, d):
    """Interactions as encoded messages; some values are broken and some topics unknown."""
    log = T.interactions(spark, d)
    sent = messages.encode_event(log.withColumn("_id", F.col("event_id")), F.create_map(
        F.lit("price"), F.col("price").cast("variant"), F.lit("event_id"), F.col("event_id").cast("variant")))
    number = F.get_json_object("value", "$.event_id").cast("bigint")
    return sent.withColumn("_n", number).select(
        F.when(F.col("_n") % 40 == 3, "other").otherwise(F.col("topic")).alias("topic"), "key",
        F.when(F.col("_n") % 50 == 7, "{broken").otherwise(F.col("value")).alias("value"), "timestamp")


@query("event_stream", """
SELECT user_id::VARCHAR AS user_id, event_type, item_id::VARCHAR AS item_id, epoch_us(ts) AS ts FROM interactions WHERE event_id % 40 <> 3 AND event_id % 50 <> 7""")
def event_stream(spark, d):
    path = runner.stage(envelopes(spark, d), "envelopes")
    stream = runner.folder_stream(spark, path, ENVELOPE)
    out = runner.run_append(messages.good_rows(stream, "user-events"), "decoded")
    return out.select("user_id", "event_type", "item_id", F.unix_micros("ts").alias("ts"))


@query("event_log", """
SELECT user_id::VARCHAR AS user_id, event_type, item_id::VARCHAR AS item_id, epoch_us(ts) AS ts FROM interactions WHERE event_id % 40 <> 3 AND event_id % 50 <> 7""")
def event_log(spark, d):
    """Events through a log of topics with offsets. Both the stream into it and the one out of it run twice, on the same checkpoints."""
    sent = envelopes(spark, d)
    arrivals, log, checkpoint, base = (scratch_path(spark, n) for n in ("arrivals", "log", "log-writer", "log-reader"))
    for half in (0, 1):
        sent.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == half).write.mode("append").parquet(arrivals)
        runner.drain(topic_log.log_writer(runner.folder_stream(spark, arrivals, ENVELOPE), log, checkpoint), "log-writer")
        stream = topic_log.log_stream(spark, log, ["user-events"], startingOffsets="earliest")
        out = runner.run_append(messages.good_rows(stream, "user-events"), "log-reader", base)
    return out.select("user_id", "event_type", "item_id", F.unix_micros("ts").alias("ts"))


@query("route_by_topic", """
SELECT CASE WHEN event_id % 40 = 3 THEN 'other' ELSE 'user-events' END AS topic,
       CASE WHEN event_id % 40 = 3 THEN 'unknown topic' WHEN event_id % 50 = 7 THEN 'unreadable value' ELSE 'ok' END AS outcome, count(*) AS n FROM interactions GROUP BY ALL""")
def route_by_topic(spark, d):
    path = runner.stage(envelopes(spark, d), "envelopes")
    out = runner.run_append(messages.route(runner.folder_stream(spark, path, ENVELOPE)), "routed")
    return out.groupBy("topic", "outcome").agg(F.count("*").alias("n"))


@query("event_stream_sink", """
SELECT user_id::VARCHAR AS key, event_type, item_id::VARCHAR AS item_id, price, epoch_us(ts) AS ts FROM interactions""")
def event_stream_sink(spark, d):
    sent = messages.encode_event(interaction_stream(spark, d), F.create_map(F.lit("price"), F.col("price").cast("variant")))
    out = runner.run_append(sent, "sent")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return out.select("key", field("event_type").alias("event_type"), field("item_id").alias("item_id"),
                      field("price").cast("double").alias("price"), F.unix_micros("timestamp").alias("ts"))


@query("purchase_stream_sink", """
SELECT user_id::VARCHAR AS key, count(DISTINCT order_id) AS messages, count(*) AS items, round(sum(price), 6) AS total FROM purchases GROUP BY user_id""")
def purchase_stream_sink(spark, d):
    """One message per order with its item list, decoded again from the sink."""
    orders = T.purchase_lines(spark, d).groupBy("user_id", "order_id").agg(
        F.collect_list("item_id").alias("item_ids"), F.sum("price").alias("total_amount"), F.min("purchase_ts").alias("ts"))
    sent = runner.run_append(messages.encode_purchase(staged_stream(orders, "orders")), "purchases")
    return messages.good_rows(sent, "purchases").groupBy("key").agg(
        F.count("*").alias("messages"), F.sum(F.size("item_ids")).alias("items"), F.round(F.sum("total_amount"), 6).alias("total"))


@query("stream_feature_upsert", """
WITH u AS (SELECT user_id, price, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM interactions)
SELECT user_id, event_id AS version, price FROM u WHERE rn = 1""")
def stream_feature_upsert(spark, d):
    updates = interaction_stream(spark, d).withColumnRenamed("event_id", "version")
    return runner.run_updates(jobs.latest(updates, "user_id", ["version", "price"], ["ts", "version"]), "features", ["user_id"])

