"""The pipeline on odd rows, stage by stage against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_chunks import brute
from test_operators import docs, jaccard, prose

from tallyshelf.llm import mixing, packing, tokens


@pytest.fixture
def folder(spark, tmp_path):
    """A corpus with nulls, ties, repeated rows, copies, passages, bad and toxic texts."""
    passage, base = prose(7, 60), prose(1, 90).split()
    good = [prose(100 + k, 40 + k % 9) for k in range(80)]
    bad = [prose(300 + k, 40).upper().replace(" ", "!! ") for k in range(40)]
    vile = [prose(400 + k, 40) + " vile scum vile" for k in range(40)]
    texts = [*good, *bad, *vile] + [f"{prose(500 + k, 20)} {passage} {prose(600 + k, 30)}" for k in range(4)]
    texts += [" ".join([*base[:50], f"new{k}", *base[51:]]) for k in range(4)] + [None, "", " ", prose(9, 30)]
    ids = [*range(len(texts)), None, 170, 170, 800]
    texts += ["null id", "same id " + prose(11, 20), "same id " + prose(11, 20), texts[160]]
    df = docs(spark, *texts, ids=ids, sources=[None if k % 11 == 5 else f"s{k % 3}" for k in range(len(texts))])
    odd = df.withColumns({c: F.lit(c) for c in ("quality", "gone", "kept", "toxic", "low_quality", "_mix", "copies", "e0", "_quality")})
    labels = spark.createDataFrame([(k, int(not 80 <= k < 120), int(120 <= k < 160)) for k in range(160)] + [(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs(spark).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.write.parquet(f"{tmp_path}/empty/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    import corpus_pipeline

    (_, quality), (_, lines), (_, near), (_, mixing_), (_, packing_) = corpus_pipeline.STAGES
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality(spark, table, folder).cache()
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sum(k in ids for k in range(80)) >= 78 and sum(k in ids for k in range(80, 160)) <= 2

    clean = lines(spark, kept, folder).cache()
    rows = {(r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None}
    want = brute([t for _, t in sorted(rows, key=lambda x: (x[0], x[1] or ""))], [i for i, _ in sorted(rows, key=lambda x: (x[0], x[1] or ""))])
    whole = {i for i, t in rows if t and not want[i]} - {170}
    assert clean.columns == table.columns and clean.count() == kept.filter(~F.coalesce(F.col("doc_id").isin(*whole, -1), F.lit(False))).count()
    assert {r.doc_id: r.text for r in clean.collect() if r.doc_id not in (None, 170)} == {k: v for k, v in want.items() if k != 170 and k not in whole}
    assert 800 in whole

    apart = near(spark, clean, folder).cache()
    one = {r.doc_id: r.text for r in clean.collect() if r.doc_id is not None}
    parent = {i: i for i in one}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in one:
        for j in one:
            both, either, _ = jaccard(one[i], one[j], 5)
            if i < j and both and 100 * both >= 80 * either:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r.doc_id for r in apart.collect()} == {i for i in one if root(i) == i} | {None}

    mixed = mixing_(spark, apart, folder).cache()
    plan = {r.doc_id: r.copies for r in mixing.plan(apart).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == table.columns and all(got.get(i, 0) % max(n, 1) == 0 for i, n in plan.items()) and not set(got) - set(plan)

    pieces = packing_(spark, mixed, folder).toPandas()
    e = tokens.encoder()
    assert pieces.length.sum() == sum(len(e.encode(r.text)) // 4 + 1 for r in mixed.collect())
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_run_equals_its_stages(spark, folder):
    import corpus_pipeline

    whole = corpus_pipeline.run(spark, folder).toPandas()
    part = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        part = stage(spark, part, folder)
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    a, b = (np.sort(x[columns].fillna(-1).to_records(index=False), order=columns) for x in (whole, part.toPandas()))
    assert (a == b).all()
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    base = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) <= {r.doc_id for r in base.select("doc_id").collect()}
    assert out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
