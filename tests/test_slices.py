"""Windows cut inside a key against a pass over each key."""

import random

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import catalog as C
from tallyshelf.operators.slices import sliced, with_lookback
from tallyshelf.streaming.jobs import sliding_request_counts

SCHEMA = "k string, offer_id long, price decimal(12,2), t long"


@pytest.fixture(scope="module")
def seen(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), n, float(r.choice([1, 1, 2, 3])), r.randint(0, 60)) for n in range(400)]
    rows += [("last", 1000, None, 5), ("last", 1001, 2.0, None), ("last", 1002, 3.0, 5)]
    return rows, spark.createDataFrame(rows, "k string, offer_id long, price double, t long").withColumn("price", F.col("price").cast("decimal(12,2)"))


def by_key(rows):
    out = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    for x in sorted(rows, key=lambda x: (low(x[3]), x[1], low(x[2]))):
        out.setdefault(x[0], []).append(x)
    return out


@pytest.mark.parametrize("n", ["1", "7", "40"])
def test_changes_history_and_trend(spark, seen, n):
    rows, df = seen
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = sorted((r.offer_id, float(r.old_price), float(r.price)) for r in C.price_changes(df, ["k"], "t").collect())
        want, history, trend = [], {}, {}
        for k, mine in by_key(rows).items():
            for a, b in zip(mine, mine[1:]):
                if a[2] is not None and b[2] is not None and a[2] != b[2]:
                    want.append((b[1], a[2], b[2]))
                    history.setdefault(k, []).append((a[2], b[3]))
            held = None
            for i in range(len(mine)):
                near = [x[2] for x in mine[max(0, i - 2) : i + 1] if x[2] is not None]
                now = sum(near) / len(near) if near else None
                trend[mine[i][1]] = "flat" if held is None or held == now else "up" if now > held else "down"
                held = now
        assert got == sorted(want) and len(want) > 100
        points = {r.k: [(float(p.price), p.date) for p in r.points] for r in C.price_history(df, ["k"], "t", max_points=30).collect()}
        assert points == {k: v[-30:] for k, v in history.items()}
        assert {r.offer_id: r.direction for r in C.price_trend(df, ["k"], "t").collect()} == trend
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_key_is_spread(spark, seen):
    _, df = seen
    parts = {r._slice: r["count"] for r in sliced(df, ["k"], ["t", "offer_id"], 20).filter("k = 'hot'").groupBy("_slice").count().collect()}
    assert len(parts) > 10 and max(parts.values()) < 60
    ghosts = with_lookback(df, ["k"], ["t", "offer_id"], 3, 20).filter("_ghost")
    assert ghosts.groupBy("_slice", "k").count().agg(F.max("count")).first()[0] == 3 and ghosts.count() <= 60
    assert with_lookback(df.limit(0), ["k"], ["t"], 3).count() == 0


@pytest.mark.parametrize("n", ["1", "9"])
def test_sliding_counts(spark, n):
    r = random.Random(3)
    rows = [(k, r.choice(["hot", "hot", "hot", "x", None]), r.choice([None, *range(100)])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = {x.id: x.trailing for x in sliding_request_counts(df, "user", "ts", 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: sum(u == v and ((s is None and t is None) or (s is not None and t is not None and s - 10 < t <= s)) for _, v, t in rows) for k, u, s in rows}
