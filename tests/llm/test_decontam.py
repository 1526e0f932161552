"""Benchmark passages against a plain search of every window at every place."""

import random
import re

import duckdb
import pytest

from tallyshelf.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """doc_id, n_words, hit places and items by comparing every window with every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[at : at + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for at in range(len(w) - m + 1):
                ids = windows.get(tuple(w[at : at + m]))
                if ids:
                    hit.update(range(at, at + m))
                    found |= {str(i) for i in ids if i is not None}
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def flat(df):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r.items) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, item_id string, spans string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")


@pytest.fixture(scope="module")
def cases():
    r = random.Random(3)
    say = lambda n, k=3: " ".join(r.choice("abcdefghij"[:k]) for _ in range(n))
    items = [(k, say(r.choice([1, 2, 5, 9, 10, 11, 25]), r.choice([3, 6, 10]))) for k in range(40)]
    items += [(3, "Other text of An item that is There Twice, with 12 words"), (None, "no id but Words"), (50, None), (51, ""), (52, " .,; "), (53, "Ünï cödé"), (54, "word " * 1200), (55, items[0][1]), (55, items[0][1])]
    docs = [(k, say(r.randint(0, 300), r.choice([3, 6, 10]))) for k in range(60)]
    docs += [(60, None), (61, ""), (None, "has no id BUT words."), (62, "x ÜNÏ Ünï\tcödé-z"), (62, items[5][1]), (62, items[5][1]), (63, "word-" * 30), (64, "OTHER.TEXT (of) an item, that is there twice with 12 words"), (65, ("pad " * 7 + items[6][1] + " ") * 3)]
    return docs, items


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 3000])
def test_equals_every_window_at_every_place(spark, cases, block):
    docs, items = cases
    assert flat(decontam.contamination(*frames(spark, docs, items), block_bytes=block)) == plain(docs, items)


def test_long_texts_in_segments(spark, monkeypatch):
    items = [(1, " ".join(f"w{k}" for k in range(40)))]
    text = ("some words before " * 500 + items[0][1] + " ") * 4
    for size in (7, 64, 1000):
        monkeypatch.setattr(decontam, "SEGMENT", size)
        n, spans, found = decontam.Benchmark([("1", items[0][1].encode(), True)]).scan(text.encode())
        want = plain([(0, text)], items)[0]
        assert (n, [k for s, e in spans for k in range(s, e)], found) == want[1:]


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 1])
def test_empty_tables(spark, block):
    docs, items = frames(spark, [(1, "a b"), (2, None)], [(1, "a")])
    assert flat(decontam.contamination(docs, items.limit(0), block)) == [(1, 2, [], []), (2, 0, [], [])]
    assert flat(decontam.contamination(docs.limit(0), items, block)) == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = decontam.op13(spark, sf).toPandas(), con.execute(decontam.OP13_SQL).df()
    assert list(got.columns) == list(want.columns)
    key = lambda d: sorted(map(tuple, d.values.tolist()))
    assert key(got) == key(want) and got.contaminated.sum() > 0
