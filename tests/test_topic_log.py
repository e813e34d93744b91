"""Topics in files: offsets, restarts in mid-stream, repeated batches."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from keeprank.streaming import topic_log as tl

AT = dt.datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="log-", dir="/tmp")


def messages(spark, lo, hi, topic="a"):
    rows = spark.range(lo, hi).select(
        F.lit(topic).alias("topic"), (F.col("id") % 7).cast("string").alias("key"), F.col("id").cast("string").alias("value"),
        F.lit(AT).alias("timestamp"), F.lit(1).alias("extra"))
    return rows.repartition(3)


def gapless(rows):
    at = {}
    for r in rows:
        at.setdefault((r["topic"], r["partition"]), []).append(r["offset"])
    assert all(sorted(v) == list(range(len(v))) for v in at.values())


def test_offsets_and_partitions_of_a_table(spark):
    path = folder()
    odd = spark.createDataFrame([("b/c", None, None, None), ("b/c", None, "é", AT)], "topic string, key string, value string, timestamp timestamp")
    for part in (messages(spark, 0, 100), messages(spark, 100, 250), odd, messages(spark, 0, 0)):
        tl.append_table(part, path)
    rows = tl.log_table(spark, path, rowsPerTask="13").collect()
    gapless(rows)
    assert sorted(int(r["value"]) for r in rows if r["topic"] == "a") == list(range(250))
    homes = {(r["key"], r["partition"]) for r in rows if r["topic"] == "a"}
    assert len(homes) == 7
    assert sorted((r["key"], r["value"], r["timestamp"]) for r in rows if r["topic"] == "b/c" and r["value"]) == [(None, "é", AT)]
    assert tl.log_table(spark, path, subscribe="b/c").count() == 2 and tl.log_table(spark, path, subscribe="none").count() == 0
    assert tl.log_table(spark, path, rowsPerTask="13").rdd.getNumPartitions() == 20  # 252 messages
    with pytest.raises(Exception, match="8 partitions a topic, not 3"):
        tl.append_table(odd, path, numPartitions="3")
    with pytest.raises(Exception, match="without a topic"):
        tl.append_table(odd.withColumn("topic", F.lit(None).cast("string")), path)
    assert tl.log_table(spark, path).count() == 252


def test_an_empty_log(spark):
    assert tl.log_table(spark, folder()).collect() == []


def start(stream, checkpoint, seen):
    def keep(batch, batch_id):
        rows = batch.collect()
        seen.setdefault(batch_id, []).append([(r["topic"], r["partition"], r["offset"], r["value"]) for r in rows])

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").foreachBatch(keep).start()


def run(stream, checkpoint, seen):
    query = start(stream, checkpoint, seen)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_bounded_batches_and_restarts_in_mid_stream(spark):
    path, checkpoint, seen = folder(), folder(), {}
    stream = tl.log_stream(spark, path, ["a", "b"], startingOffsets="earliest", maxOffsetsPerTrigger="160", group="g")
    tl.append_table(messages(spark, 0, 300), path)

    class Stop(Exception):
        pass

    def fail_in_third(batch, batch_id):
        rows = batch.collect()
        if batch_id == 2:
            raise Stop()
        seen.setdefault(batch_id, []).append([(r["topic"], r["partition"], r["offset"], r["value"]) for r in rows])

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fail_in_third).start()
    with pytest.raises(Exception):
        query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [0, 1]
    tl.append_table(messages(spark, 0, 40, "b"), path)
    tl.append_table(messages(spark, 300, 340), path)
    run(stream, checkpoint, seen)
    tl.append_table(messages(spark, 340, 350), path)
    run(stream, checkpoint, seen)
    run(stream, checkpoint, seen)
    assert all(len(parts) == 1 for parts in seen.values())
    rows = [r for (part,) in seen.values() for r in part]
    assert len(rows) == len(set(rows)) == 390 and sorted(int(r[3]) for r in rows if r[0] == "a") == list(range(350))
    assert max(len(part) for (part,) in seen.values()) <= 160 and len(seen) > 5


def test_starts_at_the_end_or_where_the_group_stopped(spark):
    path, seen = folder(), {}
    tl.append_table(messages(spark, 0, 50), path)
    query = start(tl.log_stream(spark, path, ["a"], group="g"), folder(), seen)
    try:
        query.processAllAvailable()
        tl.append_table(messages(spark, 50, 60), path)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(int(r[3]) for parts in seen.values() for part in parts for r in part) == list(range(50, 60))
    again = {}
    run(tl.log_stream(spark, path, ["a"], group="g"), folder(), again)  # a new checkpoint: its last batch may come again
    assert {int(r[3]) for parts in again.values() for part in parts for r in part} <= set(range(50, 60))


def test_a_repeated_batch_adds_nothing(spark):
    path = folder()
    writer = tl.StreamWriter({"path": path, "writer": "w", "numPartitions": "2"})
    rows = messages(spark, 0, 30).drop("extra").toArrow().to_batches()
    for _ in range(2):
        writer.commit([writer.write(iter(rows)), None], 4)
    writer.commit([writer.write(iter(rows))], 5)
    got = tl.log_table(spark, path).collect()
    gapless(got)
    assert len(got) == 60 and {r["partition"] for r in got} == {0, 1}


def test_ranges_by_bisection():
    log = tl.Log(folder())
    for n in range(9):
        log.append([("t/0", f"f{n}", 10), ("t/1", f"g{n}", n)], 2, "w", n)
    assert log.spans({"t/0": 25}, {"t/0": 41}) == [("t/0", 25, "f2", 5, 5), ("t/0", 30, "f3", 0, 10), ("t/0", 40, "f4", 0, 1)]
    assert log.spans({"t/0": 90, "t/1": 35}, {"t/0": 90, "t/1": 36}) == [("t/1", 35, "g8", 7, 1)]
    assert log.spans({}, {}) == [] and sum(s[4] for s in log.spans({}, log.ends())) == 126
