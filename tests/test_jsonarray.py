"""A JSON array cut at any byte against the parser."""

import json
import random

import pytest

from tallyshelf.sources import feeds as S
from tallyshelf.sources.jsonarray import read_objects


def objects():
    r = random.Random(6)
    text = lambda: "".join(r.choice('ab{}[]",:\\ü日\n') for _ in range(r.randint(0, 30)))
    value = lambda d: r.choice([None, 1.5, text(), [text() for _ in range(r.randint(0, 3))], {text(): value(d + 1) if d < 3 else 0}, {}])
    return [{"url": f"u{k}", "x": value(0), "s": {"a": {"b": text()}}} for k in range(60)]


@pytest.mark.parametrize("size", [64, 10_000_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_objects_are_those_of_the_parser(spark, tmp_path, size, indent):
    rows = objects()
    (tmp_path / "1.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "2.json").write_text(json.dumps(rows[:5], indent=indent))
    (tmp_path / "3.json").write_text(" [ ] ")
    (tmp_path / "4.json").write_text("")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 16)
    try:
        got = [json.loads(r.text) for r in read_objects(spark, str(tmp_path)).collect()]
        assert size > 64 or spark.read.option("lineSep", "}").text(str(tmp_path / "1.json")).rdd.getNumPartitions() > 40
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, rows + rows[:5]))


def test_large_feed_is_the_feed(spark, tmp_path):
    rows = [{"url": f"https://c/{k}", "title": 'a "quoted" {brace}', "price": {"current": "1"}, "specifications": {"S": {"k": "}{"}}} for k in range(50)] + [{"title": 5, "price": "no struct"}]
    p = tmp_path / "c.json"
    p.write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = sorted(map(str, S.read_large_feed(spark, "croma", str(p)).drop("_corrupt").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(map(str, S.read_feed(spark, "croma", str(p)).drop("_corrupt").collect()))
