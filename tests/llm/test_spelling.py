"""Spelling variants against a comparison of all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from tallyshelf.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying each."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words):
    form, out = {}, {}
    for w, n in words.items():
        others = sorted((-m, x) for x, m in words.items() if near(w, x))
        if others and -others[0][0] >= 2 * n:
            form[w] = others[0][1]
        out[w] = len(others)
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, out[w], words.get(form.get(w))))
    return sorted(rows)


def plain_runs(docs):
    c = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 5}


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def word_list(seed, n, letters="abcé", lengths=(1, 9)):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(*lengths))): r.choice([1, 2, 3, 5, 8, 20, 100, 1000]) for _ in range(n)}


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    words = word_list(1, 700) | word_list(2, 80, "日本🙂a", (1, 4)) | {"x" * 300: 4, "x" * 301: 9, "x" * 299 + "y": 4, "ÿé÷×À": 3}
    if small:  # many cells, and blocks of them, fitted on few words
        for name, v in (("CELL", 20), ("FIT_WORDS", 200), ("LEAF", 2), ("ASKED", 1), ("QUESTIONS", 7), ("PAIRS", 5), ("CELL_LETTERS", 2000)):
            monkeypatch.setattr(spelling, name, v)
    frame = spark.createDataFrame([(w, n, "?", 0) for w, n in words.items()] + [(None, 5, "", 0), ("", 7, "", 0)], "word string, n long, form string, leaf int")
    assert got(spelling.spelling_variants(frame)) == plain(words)


def test_equal_words_are_added(spark):
    frame = spark.createDataFrame([("house", 3), ("house", 4), ("hause", 3)], "word string, n long")
    assert got(spelling.spelling_variants(frame)) == [("hause", "house", "house", 3, 1, 7), ("house", None, "house", 7, 1, None)]
    assert got(spelling.spelling_variants(frame.limit(0))) == []


def test_trees_reach_all_in_range():
    r = np.random.default_rng(4)
    points = r.poisson(0.7, (400, 32)).astype(np.int16)
    tree = spelling.Tree(points, 4, tight=True)
    for added, removed in ((1, 1), (0, 1), (1, 0)):
        pairs = {(int(q), int(t)) for a, b in tree.near(points, points, added, removed) for q, t in zip(a, b)}
        need, over = np.maximum(points[None] - points[:, None], 0).sum(2), np.maximum(points[:, None] - points[None], 0).sum(2)
        assert pairs == set(zip(*(x.tolist() for x in np.nonzero((need <= added) & (over <= removed)))))


def test_one_edit():
    r = random.Random(9)
    words = ["".join(r.choice("ab") for _ in range(5)) for _ in range(40)] + ["".join(r.choice("ab") for _ in range(6)) for _ in range(40)]
    for a in words:
        for b in words:
            assert spelling.one_edit(spelling._codes([a]), spelling._codes([b]))[0] == near(a, b)


def test_runs_by_definition(spark, monkeypatch):
    r = random.Random(7)
    docs = [(k, " ".join(r.choice(["Hello", "wörld", "NAÏVE", "Straße", "×÷Àé1", "日本abcde", "tokens"]) + r.choice("aBé_") for _ in range(200))) for k in range(60)]
    docs += [(None, "orphan words Here"), (3, None), (4, ""), (5, "a b c"), (5, "a b c"), (6, "z" * 5000 + " twice twice")]
    want = plain_runs(docs)
    for size in (spelling.SEGMENT, 50):
        monkeypatch.setattr(spelling, "SEGMENT", size)
        frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
        counts = spelling.run_counts(frame).groupBy("word").sum("n").collect()
        assert {w: n for w, n in counts} == want
    assert any(crc32(f"{d}:{w}".encode()) % 97 == 0 for d, t in docs for w in (t or "").lower().split())


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(spelling.OP11_SQL).fetchall())
    rows = got(spelling.op11(spark, sf))
    assert rows == want and any(r[1] for r in rows)
