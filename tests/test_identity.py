"""Product ids over batches against one union-find over all records."""

import random

import pytest

from tallyshelf.operators.identity import ProductIdentities, redirected

SCHEMA = "row_id long, brand string, model_name string, model_number string, product_key_ string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def plain(rows):
    """Groups of row_ids by union-find over names and numbers within a brand."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, brand, name, number in rows:
        a = root(("name", brand.lower(), name.lower()))
        if number:
            parent[root(("number", brand.lower(), number.upper()))] = a
    groups = {}
    for r in rows:
        groups.setdefault(root(("name", r[1].lower(), r[2].lower())), []).append(r[0])
    return sorted(groups.values())


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.product_key, []).append(r.row_id)
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize("cuts", [[8, 40]])
def test_batches_equal_one_batch_up_to_redirects(spark, tmp_path, cuts):
    r = random.Random(2)
    rows = [(k, r.choice("Aab"), f"m{r.randint(0, 25)}", r.choice([None, "", f"n{r.randint(0, 15)}"])) for k in range(60)]
    one = ProductIdentities(spark, str(tmp_path / "one"))
    want = {x.row_id: x.product_key for x in one.assign("all", frame(spark, rows)).collect()}
    store, seen, before = ProductIdentities(spark, str(tmp_path / "many")), [], {}
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60])):
        got = store.assign(f"b{k}", frame(spark, rows[a:b])).collect()
        moved = {x.old_key: x.product_key for x in store.redirects().collect()}
        assert all(moved.get(x.product_key, x.product_key) == moved.get(before[x.row_id], before[x.row_id]) for x in seen)
        seen += got
        before = {x.row_id: moved.get(x.product_key, x.product_key) for x in seen}
    every = redirected(frame(spark, rows).join(spark.createDataFrame([(x.row_id, x.product_key) for x in seen], "row_id long, product_key string"), "row_id"), store.redirects()).collect()
    assert groups(every) == plain(rows)
    assert {x.row_id: x.product_key for x in every} == want  # the first-born node names a product either way


def test_oldest_id_lives_on_and_replays_do_nothing(spark, tmp_path):
    store = ProductIdentities(spark, str(tmp_path))
    one = {x.row_id: x.product_key for x in store.assign("1", frame(spark, [(1, "B", "old", None), (2, "B", "young", "N-2"), (3, "B", "apart", None)])).collect()}
    assert len(set(one.values())) == 3 and store.redirects().count() == 0
    two = {x.row_id: x.product_key for x in store.assign("2", frame(spark, [(10, "b", "OLD", "n-2"), (11, "B", "new", None)])).collect()}
    assert two[10] == one[1] and two[11] not in one.values()
    assert [tuple(x) for x in store.redirects().collect()] == [(one[2], one[1])]
    files = sorted(p.name for p in (tmp_path / "data").glob("*/*/*.parquet"))
    again = {x.row_id: x.product_key for x in store.assign("2", frame(spark, [(10, "b", "OLD", "n-2"), (11, "B", "new", None)])).collect()}
    assert again == two and sorted(p.name for p in (tmp_path / "data").glob("*/*/*.parquet")) == files
    # a third batch joins through the redirected product; the chain ends at the oldest
    three = {x.row_id: x.product_key for x in store.assign("3", frame(spark, [(20, "B", "young", "N-3"), (21, "B", "apart", "N-3")])).collect()}
    assert set(three.values()) == {one[1]}
    assert {x.old_key: x.product_key for x in store.redirects().collect()} == {one[2]: one[1], one[3]: one[1]}
    written = [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "data").glob("*/members"), key=lambda p: p.stat().st_mtime)]
    assert written == [4, 1, 1]  # later batches write their new nodes alone


def test_records_without_names_and_empty_batches(spark, tmp_path):
    store = ProductIdentities(spark, str(tmp_path))
    assert store.assign("0", frame(spark, []).limit(0)).count() == 0
    got = {x.row_id: x.product_key for x in store.assign("1", frame(spark, [(1, None, None, "N"), (2, None, "m", None), (3, None, "m", " ")])).collect()}
    assert got[1] is None and got[2] == got[3] is not None
    assert store.log.read()[0] == 2


def test_two_writers_meet(spark, tmp_path):
    a, b = ProductIdentities(spark, str(tmp_path)), ProductIdentities(spark, str(tmp_path))
    work, done = a._work, []

    def slow(*args):
        work(*args)
        if not done:
            done.append(b.assign("first", frame(spark, [(1, "B", "m", "N")])).first().product_key)

    a._work = slow
    got = a.assign("second", frame(spark, [(1, "B", "other", "n")])).first().product_key
    assert done == [got] and [e["batch"] for e in a.log.read()[1]] == ["first", "second"]


def test_ingest_in_two_batches_is_ingest_in_one(spark, tmp_path):
    from test_resolve import feed

    from tallyshelf.operators import resolve as R

    rows = [{"row_id": 1, "url": "u1", "brand": "A", "model_name": "m", "model_number": "X-1"}, {"row_id": 2, "url": "u2", "brand": "A", "model_name": "k"}, {"row_id": 3, "url": "u3", "brand": "A", "model_name": "k 5G", "model_number": "x-1"}, {"row_id": 4, "url": "u4", "brand": "A", "model_name": "z"}]
    one = R.ingest(feed(spark, *rows), identities=ProductIdentities(spark, str(tmp_path / "one")), batch="1")
    store = ProductIdentities(spark, str(tmp_path / "two"))
    first = R.ingest(feed(spark, *rows[:2]), identities=store, batch="1")
    old = {"brands": first.brands, "products": first.products, "variants": first.variants, "listings": first.listings.drop("change", "price_changed")}
    second = R.ingest(feed(spark, *rows[2:]), old, identities=store, batch="2")
    keys = lambda *parts: {r.row_id: r.product_key for p in parts for r in redirected(p.labels, store.redirects()).collect()}
    assert keys(first, second) == keys(one)
    assert {r.row_id: r.product_match for r in second.labels.collect()} == {3: "model_number", 4: "new_product"}
    assert second.redirects.count() == 1 and one.redirects.count() == 0
    assert {r.product_key: r.is_new for r in second.products.collect()} == {keys(one)[1]: False, keys(one)[4]: True}
