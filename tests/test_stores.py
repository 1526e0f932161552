"""Catalog versions, sketches and prefix tables."""

import random

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import sketches as K
from tallyshelf.operators.prefixes import PrefixTable, best_by_prefix
from tallyshelf.sources.snapshots import CatalogStore, read_jdbc


def tables(spark, n):
    return {"brands": spark.range(n), "products": spark.range(2 * n).withColumn("name", F.lit("x"))}


def test_versions_change_as_one(spark, tmp_path, monkeypatch):
    store = CatalogStore(spark, str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.commit(tables(spark, 1)) == 0
    pinned = store.read()
    broken = {**tables(spark, 5), "variants": spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):  # dies between tables
        store.commit(broken)
    assert store.versions() == [0] and {n: d.count() for n, d in store.read().items()} == {"brands": 1, "products": 2}
    assert store.commit(tables(spark, 3), base=0) == 1
    assert pinned["brands"].count() == 1 and store.read()["brands"].count() == 3 and store.read(0)["products"].count() == 2
    with pytest.raises(RuntimeError):
        store.commit(tables(spark, 9), base=0)
    assert store.read()["brands"].count() == 3
    for k in (4, 5):
        store.commit(tables(spark, k))
    assert store.collect(2) == [0, 1] and store.collect(2) == [] and store.versions() == [2, 3]
    assert store.commit(tables(spark, 6)) == 5 and store.read()["brands"].count() == 6 and store.read(2)["brands"].count() == 4
    with pytest.raises(KeyError):
        store.read(0)


def test_database_tables_in_ranges(spark):
    url, driver = "jdbc:derby:memory:shelf;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).select(F.col("id").cast("int").alias("K"), F.lit("v").alias("V")).write.format("jdbc").options(url=url, dbtable="T", driver=driver).mode("overwrite").save()
    got = read_jdbc(spark, url, "T", "K", 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(r.K for r in got.collect()) == list(range(100))


def test_sketches_within_their_error(spark, tmp_path):
    r = random.Random(1)
    rows = [("big", r.randint(1, 9), round(r.gauss(500, 120), 2), f"s{r.randint(0, 3000)}") for _ in range(20000)] + [("small", 1, float(k), "s") for k in range(9)] + [("none", 1, None, "s")]
    df = spark.createDataFrame(rows, "product_id string, day int, price double, store_name string")
    store = K.SketchStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.sketches()
    for day in (1, 2, 3, 3, 1):
        store.add(f"d{day}", df.filter(F.col("day") % 3 == day % 3))
    assert not store.add("d1", df)
    got = {x.product_id: x for x in K.answers(store.sketches(["product_id"]), (0.1, 0.5, 0.9)).collect()}
    big = sorted(x[2] for x in rows if x[0] == "big")
    for q, v in ((0.1, got["big"].q10), (0.5, got["big"].q50), (0.9, got["big"].q90)):
        assert abs(sum(x <= v for x in big) / len(big) - q) <= 2 * K.rank_error()
    stores = len({x[3] for x in rows if x[0] == "big"})
    assert abs(got["big"].stores - stores) <= 4 * K.distinct_error() * stores
    assert (got["big"].n, got["big"].min_price, got["big"].max_price) == (20000, big[0], big[-1])
    assert (got["small"].q50, got["small"].avg_price, got["small"].stores, "none" in got) == (4.0, 4.0, 1, False)
    assert store.sketches().filter("product_id = 'big'").count() == 9


def test_prefixes_are_kept_up_to_date(spark, tmp_path):
    r = random.Random(4)
    names = {"".join(r.choice("abC ") for _ in range(r.randint(1, 9))): r.randint(0, 9) for _ in range(300)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "model_name string, offers long")
    best = lambda p, n=10: [(k, v) for k, v in sorted(names.items(), key=lambda x: (-x[1], x[0])) if k.lower().startswith(p)][:n]
    table = PrefixTable(spark, str(tmp_path / "p"))
    table.build(frame(names))
    ask = lambda p, n=10: [tuple(x) for x in table.complete(p, n).collect()]
    for p in ("a", "AB", "c", "abcabc", "abca bc", "zz", " "):
        assert ask(p) == best(p.lower())
    assert ask("a", 3) == best("a", 3) and ask("a", 25) == best("a", 25) and ask("") == best("")
    top = best("a")[0][0]
    names.update({"abnew": 50, best("c")[2][0]: 99})
    del names[top]
    changed = [("abnew", 50), (best("c")[0][0], 99), (top, None)]
    table.update(spark.createDataFrame(changed, "model_name string, offers long"))
    for p in ("a", "ab", "abn", "c", "ca", top.lower()[:2]):
        assert ask(p) == best(p)
    every = sorted(map(tuple, table.store.read()["best"].drop("bucket").select("prefix", "rank", "model_name", "offers").collect()))
    assert every == sorted(map(tuple, best_by_prefix(frame(names)).collect()))
