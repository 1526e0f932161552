"""The trigram index against trigram sets of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators.trigrams import TrigramIndex, grams_of, trigrams

WORDS = ["galaxy", "note", "redmi", "pro", "max", "5g", "a16", "a17", "ultra", "i", "x-1", "plüs", "Pixel"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = random.Random(5)
    rows = [(k, " ".join(r.choices(WORDS, k=r.randint(1, 4))), r.choice(["Samsung", "Xiaomi", "Oppo"])) for k in range(150)]
    rows += [(900, None, "Oppo"), (901, "", None), (902, "--", "Oppo"), (903, "galaxy note", "Samsung"), (904, "galaxy note", "Samsung")]
    df = spark.createDataFrame([(*x, "?") for x in rows], "product_id long, model_name string, brand string, gram string")
    return rows, TrigramIndex.build(df, "product_id", ["model_name", "brand"], str(tmp_path_factory.mktemp("t") / "index"), buckets=4)


def likeness(a, b):
    x, y = set(grams_of(a or "")), set(grams_of(b or ""))
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("term", ["galaxy note", "Note", "ax", "5", "x-1", "üs", "-", "redmi pro samsung", "zzz", "", "i"])
@pytest.mark.parametrize("threshold", [0.3, 0.75])
def test_search_equals_all_texts(index, term, threshold):
    rows, ix = index
    want = []
    for k, name, brand in rows:
        whole = " ".join(x for x in (name, brand) if x is not None).lower()
        score = 1.0 if all(w in whole for w in term.lower().split()) else max(likeness(name, term), likeness(brand, term))
        if score >= threshold:
            want.append((-score, k))
    got = [(-r.score, r.id) for r in ix.search(term, threshold).collect()]
    assert got == sorted(want)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_pairs_equal_all_pairs(index, threshold):
    rows, ix = index
    names = {(b, n) for _, n, b in rows if b and n is not None}
    want = sorted((b, n, m, likeness(n, m)) for b, n in names for c, m in names if b == c and n < m and likeness(n, m) >= threshold)
    assert sorted(map(tuple, ix.pairs("model_name", "brand", threshold).collect())) == want


def test_lookups_read_their_folders_alone(index):
    _, ix = index
    plan = ix.lists(["gal"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket#") or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len(ix.lists(["gal"]).inputFiles()) >= 1 and "In(gram" in plan or "EqualTo(gram" in plan


def test_grams_are_those_of_the_columns(spark):
    for text in ("", "a", "Ab-c 12", "  x  y", "ünï"):
        assert spark.range(1).select(trigrams(F.lit(text))).first()[0] == grams_of(text)
