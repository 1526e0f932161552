import datetime as dt
import json

from pyspark.sql import functions as F

from tallyshelf.streaming import jobs as T

SCHEMA = "url string, price double, ts timestamp"


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"url": u, "price": p, "ts": f"2024-01-01T00:{m:02d}:00Z"}) for u, p, m in rows))


def test_resume_dedup_and_upsert(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "1.json", [("a", 1.0, 1), ("b", 1.0, 2), ("a", 2.0, 3)])
    stream = lambda: T.stream_feed(spark, str(src), SCHEMA)
    T.run_available(T.stream_dedup(stream(), "ts", ["url"]), str(tmp_path / "out"), str(tmp_path / "c1"))
    sink = T.UpsertSink(str(tmp_path / "table"), ["url"], "ts")
    sink.start(stream(), str(tmp_path / "c2")).awaitTermination()
    put(src, "2.json", [("a", 3.0, 4), ("c", 1.0, 5)])
    T.run_available(T.stream_dedup(stream(), "ts", ["url"]), str(tmp_path / "out"), str(tmp_path / "c1"))
    sink.start(stream(), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    last, table = sink.latest(spark)
    assert {r.url: r.price for r in table.collect()} == {"a": 3.0, "b": 1.0, "c": 1.0}
    sink(spark.createDataFrame([("z", 9.0, dt.datetime(2024, 1, 1))], SCHEMA), last)  # a replay
    assert sink.latest(spark)[1].count() == 3
    for k in range(4):  # buckets that a batch doesn't touch stay where they are; old versions go
        sink(spark.createDataFrame([("a", 10.0 + k, dt.datetime(2024, 2, 1 + k))], SCHEMA), last + 1 + k)
    assert {r.url: r.price for r in sink.latest(spark)[1].collect()} == {"a": 13.0, "b": 1.0, "c": 1.0}
    assert len([f for f in (tmp_path / "table" / "data").iterdir() if not f.name.startswith(".")]) <= 4


def test_price_changes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "1.json", [("a", 1.0, 1), ("a", 1.0, 2), ("a", 2.0, 3)])
    run = lambda: T.run_available(T.stream_price_changes(T.stream_feed(spark, str(src), SCHEMA)), str(tmp_path / "out"), str(tmp_path / "c"))
    run()
    put(src, "2.json", [("a", 5.0, 4), ("b", 1.0, 5)])
    run()
    assert sorted((r.old_price, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1.0, 2.0), (2.0, 5.0)]


def test_retry(spark):
    dead = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("c", "x", 1)], "url string, reason string, attempts int")
    done = spark.createDataFrame([("c",)], "url string")
    assert [tuple(r) for r in T.failed_items_retry(dead, done).collect()] == [("a", "y", 3)]


def test_alerts_fire_once(spark, tmp_path):
    """Two micro-batches and a restart give what one batch gives."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "product_id long, offer_id long, price double, last_seen timestamp"
    put = lambda name, rows: (src / name).write_text("\n".join(json.dumps({"product_id": p, "offer_id": o, "price": x, "last_seen": f"2024-01-01T00:{m:02d}:00Z"}) for p, o, x, m in rows))
    alerts = spark.createDataFrame([(1, 7, 10.0), (2, 7, 5.0), (3, 8, 1.0), (4, 9, None)], "alert_id long, product_id long, target double")
    run = lambda: T.run_available(T.stream_price_alerts(T.stream_feed(spark, str(src), schema), alerts), out, str(tmp_path / "c"))
    one = [(7, 1, 12.0, 1), (7, 3, 9.0, 3), (7, 2, 10.0, 3), (8, 4, 2.0, 4), (9, 5, 1.0, 5)]
    two = [(7, 6, 4.0, 6), (7, 7, 1.0, 7), (8, 8, None, 8)]
    put("1.json", one)
    run()
    assert sorted((r.alert_id, r.offer_id) for r in spark.read.parquet(out).collect()) == [(1, 2)]
    put("2.json", two)
    run()
    run()
    got = sorted((r.alert_id, r.offer_id, r.price) for r in spark.read.parquet(out).collect())
    batch = T.price_alerts(spark.read.schema(schema).json(str(src)), alerts)
    assert got == sorted((r.alert_id, r.offer_id, r.price) for r in batch.collect()) == [(1, 2, 10.0), (2, 6, 4.0)]


def test_expiry_by_timers(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    run = lambda: T.run_available(T.stream_expiry(T.stream_feed(spark, str(src), SCHEMA), "url", "ts", 600), out, str(tmp_path / "c"))
    got = lambda: sorted((r.url, r.last_seen.minute) for r in spark.read.parquet(out).collect())
    put(src, "1.json", [("a", 1.0, 0), ("b", 1.0, 5), ("c", 1.0, 12)])
    run()
    assert got() == [("a", 0)]  # 0 + 10 minutes lies before the watermark, 12
    put(src, "2.json", [("b", 1.0, 14), ("d", 1.0, 23)])
    run()
    assert got() == [("a", 0), ("c", 12)]  # b was seen again in time
    put(src, "3.json", [("a", 1.0, 30)])
    run()
    assert got() == [("a", 0), ("b", 14), ("c", 12)]
    put(src, "4.json", [("e", 1.0, 45)])
    run()
    assert got() == [("a", 0), ("a", 30), ("b", 14), ("c", 12), ("d", 23)]
