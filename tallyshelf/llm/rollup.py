"""Token counts kept as delta-maintained rollups.

A store is a folder.  Every batch writes a folder of its own under ``data``: its
``ledger`` has the signed count of each document version that the batch touches,
its ``deltas`` the signed change of the (source, lang, tokenizer) totals.  The
batch counts from the moment that an entry of ``log`` names its folder.  Entries
are numbered and appear with their content, one writer a number: of two writers
that start from the same state one commits, the other reads the new state and works
its batch out again.  A batch that failed half-way has no entry; a batch that has
one is not applied again.  Totals are sums of deltas.  ``compact`` folds what is
committed into one ledger, one table of totals and one of batch ids, and shortens the
log to that entry, so that none of them grows with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices
from tallyshelf.llm.tokens import encoder
from tallyshelf.scratch import broadcast_if_small, scratch_dir, stage
from tallyshelf.sources.commitlog import CommitLog

_KEY = ["source", "lang", "tokenizer"]
_DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"
_LEDGER = f"doc_id long, {_DELTAS}"
_BATCHES = "place long, batch string"
_COUNTED = ["doc_id", *_KEY, "tokens"]


def bpe_counts(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens of whole texts (null text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in slices(batches):
            n = [len(encode(t.as_py())) // 4 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], names=_COUNTED)

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


class TokenRollup:
    """A store of token totals at ``path``.

    ``count`` turns documents (doc_id, text, lang, source) into (doc_id, source,
    lang, tokenizer, tokens); frames with a column tokens are taken as counted.
    Null sources and languages are groups of their own; rows with a null doc_id
    can be inserted but never deleted or revised; rows that repeat a doc_id are
    counted each, and deleted or revised together.  Only documents that are there
    are deleted or revised; one that a batch both deletes and revises is deleted.
    Deletes and revisions of a batch see the state before it, without its inserts.
    """

    def __init__(self, spark: SparkSession, path: str, count: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.count = spark, path.rstrip("/"), count
        self.log = CommitLog(spark, f"{self.path}/log")

    def _batches(self, entries: list[dict]) -> DataFrame:
        """(place, batch) of the batches that are folded into the first entry."""
        return self.spark.read.schema(_BATCHES).parquet(f"{entries[0]['at']}/batches")

    def _has(self, batch: str, entries: list[dict]) -> bool:
        if any(e.get("batch") == batch for e in entries):
            return True
        return bool(entries and entries[0].get("restart")) and not self._batches(entries).filter(F.col("batch") == batch).isEmpty()

    def committed(self) -> list[str]:
        """Ids of the batches that count, in order."""
        entries = self.log.read()[1]
        folded = [r.batch for r in self._batches(entries).orderBy("place").collect()] if entries and entries[0].get("restart") else []
        return folded + [e["batch"] for e in entries if "batch" in e]

    def _read(self, what: str, entries: list[dict]) -> DataFrame:
        schema = {"ledger": _LEDGER, "deltas": _DELTAS}[what]
        paths = [f"{e['at']}/{what}" for e in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _counted(self, docs: DataFrame) -> DataFrame:
        return (docs if "tokens" in docs.columns else self.count(docs)).select(*_COUNTED)

    def _change(self, entries: list[dict], inserts: DataFrame | None, deletes: DataFrame | None, revisions: DataFrame | None) -> DataFrame:
        """The signed ledger rows of a batch.  What is joined is narrow: ids and counts."""
        plus = [] if inserts is None else [self._counted(inserts)]
        minus, touched = [], []
        if deletes is not None:
            gone = stage(deletes.select("doc_id").filter("doc_id is not null").distinct(), "rollup-gone")
            touched.append(gone)
        if revisions is not None:
            new = stage(self._counted(revisions).filter("doc_id is not null"), "rollup-new")
            if deletes is not None:
                new = new.join(broadcast_if_small(gone), "doc_id", "left_anti")
            touched.append(new.select("doc_id").distinct())
        if touched:
            ids = touched[0] if len(touched) == 1 else stage(touched[0].union(touched[1]), "rollup-touched")
            held = self._read("ledger", entries).join(broadcast_if_small(ids), "doc_id", "left_semi")
            held = held.groupBy("doc_id", *_KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")
            if revisions is not None:
                held = stage(held, "rollup-held")
                plus.append(new.join(broadcast_if_small(held.select("doc_id")), "doc_id", "left_semi"))
            minus = [held.select("doc_id", *_KEY, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))]
        signed = [p.select("doc_id", *_KEY, F.lit(1).cast("long").alias("documents"), "tokens") for p in plus] + minus
        change = signed[0] if signed else self.spark.createDataFrame([], _LEDGER)
        for more in signed[1:]:
            change = change.union(more)
        return change

    def _write(self, ledger: DataFrame) -> str:
        at = f"{self.path}/data/{uuid4().hex}"
        ledger.write.option("compression", "zstd").parquet(f"{at}/ledger")
        written = self.spark.read.schema(_LEDGER).parquet(f"{at}/ledger")
        written.groupBy(*_KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(f"{at}/deltas")
        return at

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Apply one batch: documents to insert, doc_ids to delete, documents whose
        text or labels changed.  Returns False if the batch was committed before."""
        while True:
            n, entries = self.log.read()
            if self._has(batch, entries):
                return False
            if self.log.append(n, {"batch": batch, "at": self._write(self._change(entries, inserts, deletes, revisions))}):
                return True

    def compact(self) -> None:
        """Fold all committed batches into one ledger, one table of totals and one
        table of batch ids; the log goes on from there.  Totals stay as they are;
        folders of folded batches are kept for readers that still use them."""
        while True:
            n, entries = self.log.read()
            if not entries:
                return
            sums = self._read("ledger", entries).groupBy("doc_id", *_KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            at = self._write(sums.filter("documents <> 0 or tokens <> 0"))
            ids = self.spark.createDataFrame([(e["n"], e["batch"]) for e in entries if "batch" in e], _BATCHES)
            ids = self._batches(entries).union(ids) if entries[0].get("restart") else ids
            ids.coalesce(1).write.parquet(f"{at}/batches")
            if self.log.append(n, {"restart": True, "at": at}):
                return

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches."""
        sums = self._read("deltas", self.log.read()[1]).groupBy(*_KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 or tokens <> 0")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents inserted, those labelled toxic
    deleted, those labelled low quality revised to their distinct lines; each
    batch is delivered twice.  A revision that leaves its text as it is changes no
    total, so only changed texts are counted anew; labels meet counts, not texts."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    store = TokenRollup(spark, f"{scratch_dir(spark)}/rollup-{uuid4().hex}", lambda d: bpe_counts(d, "byte_bpe_50k"))
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    low = stage(labels.filter("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti"), "rollup-low")
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    changed = docs.select("doc_id", "source", "lang", "text", lines.alias("lines")).filter("lines <> text").withColumn("text", F.col("lines"))
    revised = stage(store.count(changed), "rollup-revised").join(broadcast_if_small(low), "doc_id", "left_semi")
    for _ in range(2):
        store.apply("1-insert", inserts=docs)
        store.apply("2-delete", deletes=toxic)
        store.apply("3-revise", revisions=revised)
    store.compact()
    return store.totals()
