import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memlake.operators.intervals import merge_intervals
from memlake.streaming.intervals import current, merge_intervals_stream
from memlake.streaming.logs import append_to, daily_counts, due_sessions, each_batch, follow

T0 = datetime(2024, 1, 1)


def write(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_interval_state_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    at = lambda m: (T0 + timedelta(minutes=m)).isoformat() + "Z"
    write(src, 1, [{"k": "a", "s": at(0), "e": at(5)}, {"k": "a", "s": at(10), "e": at(12)}, {"k": "b", "s": at(3), "e": at(1)}])
    stream = spark.readStream.schema("k string, s timestamp, e timestamp").json(str(src))
    query = merge_intervals_stream(stream, "k", "s", "e").writeStream.format("memory").queryName("iv").outputMode("update").start()
    try:
        query.processAllAvailable()
        us = int(T0.timestamp() * 1e6)
        minute = lambda t: -1 if t is None or t < 0 else (t - us) // 60_000_000
        read = lambda: [(r["key"], r["kind"], minute(r["start_us"]), minute(r["end_us"]), r["n"], r["change"]) for r in spark.table("iv").collect()]
        assert sorted(read()) == [("a", "gap", 5, 10, 0, 1), ("a", "period", 0, 5, 1, 1), ("a", "period", 10, 12, 1, 1)]
        write(src, 2, [{"k": "a", "s": at(4), "e": at(10)}, {"k": "c", "s": at(1), "e": None}])
        query.processAllAvailable()
        assert sorted(read()[3:]) == [("a", "gap", 5, 10, 0, -1), ("a", "period", 0, 5, 1, -1), ("a", "period", 0, 12, 3, 1), ("a", "period", 10, 12, 1, -1), ("c", "period", 1, -1, 1, 1)]
        now = {(r["key"], r["kind"], minute(r["start_us"]), minute(r["end_us"]), r["n"]) for r in current(spark.table("iv")).collect()}
        assert now == {("a", "period", 0, 12, 3), ("c", "period", 1, -1, 1)}
    finally:
        query.stop()


def test_large_entities_are_cut_by_time(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), s, s + rng.randrange(1, 40)) for s in (rng.randrange(2000) for _ in range(150))]
    at = lambda m: (T0 + timedelta(minutes=m)).isoformat() + "Z"
    src = tmp_path / "in"
    for n in range(3):
        write(src, n, [{"k": k, "s": at(s), "e": at(e)} for k, s, e in rows[n::3]])
    stream = spark.readStream.schema("k string, s timestamp, e timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    query = merge_intervals_stream(stream, "k", "s", "e", bucket="2 hours").writeStream.format("memory").queryName("cutup").outputMode("update").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = merge_intervals(spark.createDataFrame([(k, T0 + timedelta(minutes=s), T0 + timedelta(minutes=e)) for k, s, e in rows], "key string, s timestamp, e timestamp"), ["key"], "s", "e")
    changes = spark.table("cutup")
    assert changes.select("key", "bucket").distinct().count() > 20
    assert sorted(map(tuple, current(changes).collect())) == sorted(map(tuple, batch.collect()))


def test_logs(spark, tmp_path):
    src = tmp_path / "tr"
    at = lambda m: (T0 + timedelta(minutes=m)).isoformat() + "Z"
    write(src, 1, [{"t": at(i * 20), "session_id": "s", "kind": "user", "content": "x"} for i in range(5)] + [{"t": at(5000), "session_id": "z", "kind": "user", "content": "x"}])
    steps = follow(spark, str(src))
    append_to(steps.withColumn("day", F.to_date("t")), str(tmp_path / "out"), str(tmp_path / "c1"), by=("day",)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    seen = []
    each_batch(steps, lambda df, i: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == 6
    for name, df in (("due", due_sessions(steps, min_messages=5)), ("days", daily_counts(steps, by=("kind",)))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    assert [(r["session_id"], r["n_messages"]) for r in spark.table("due").collect()] == [("s", 5)]
    assert [(r["day"], r["n"]) for r in spark.table("days").collect()] == [("2024-01-01", 5)]
