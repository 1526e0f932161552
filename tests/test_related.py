"""Related products against a plain comparison inside each brand and category."""

import random

from tallyshelf.operators import catalog
from tallyshelf.operators.trigrams import grams_of

KINDS = "product_id long, brand string, category string, model_name string, list_price double"


def brute(rows, n, pool):
    out = {}
    for i, brand, category, name, price in rows:
        near = sorted((abs(p - price), j, m) for j, b, c, m, p in rows if (b, c) == (brand, category) and j != i)[:pool]
        mine = set(grams_of(name or ""))
        scored = []
        for gap, j, other in near:
            theirs = set(grams_of(other or ""))
            both = len(mine & theirs)
            scored.append((-both / len(mine | theirs) if both else 0.0, gap, j))
        for rank, (like, gap, j) in enumerate(sorted(scored)[:n], 1):
            out[i, rank] = (j, gap, -like)
    return out


def test_related_by_name(spark):
    r = random.Random(4)
    words = ["pro", "max", "lite", "ultra", "note", "galaxy", "5g", "12", "mini"]
    rows = [(k, r.choice("ab"), r.choice("xy"), " ".join(r.sample(words, r.randint(1, 4))), float(r.randint(1, 12))) for k in range(90)]
    rows += [(100, "a", "x", None, 5.0), (101, "a", "x", "", 5.0), (102, "a", "x", "!!", 5.0), (103, "lone", "x", "pro max", 5.0)]
    got = catalog.related_by_name(spark.createDataFrame(rows, KINDS), n=3, pool=8).collect()
    assert {(x.product_id, x["rank"]): (x.related_id, x.gap, x.similarity) for x in got} == brute(rows, 3, 8)
    assert len(got) == len({(x.product_id, x["rank"]) for x in got})
    assert catalog.related_by_name(spark.createDataFrame([], KINDS)).count() == 0
