"""Benchmark decontamination: which words of documents lie in benchmark passages.

A benchmark item is cut into windows of ten consecutive words (an item of fewer
words is one window).  The windows are searched in all documents at once by
Wu-Manber's method, over words instead of letters: a table says for each hashed
block of two words how far the search may shift when it meets the block, the
bucket of a block without shift holds the windows that end with it, and these
are compared word by word with the text.  Most places of a text hold no block of
any window, so nine of ten words are never looked at.

The tables of a block of items take about ten times its words' bytes, so the items
are searched in blocks of at most ``BLOCK_BYTES``.  A benchmark within one block
is searched in one pass without a shuffle; a larger one in a pass for each block,
whose few hits are then merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices
from tallyshelf.scratch import broadcast_if_small, stage

#: Words of a window, and of a block.
WINDOW, BLOCK = 10, 2
#: Most bytes of items' words that are searched in one pass.
BLOCK_BYTES = 16 << 20
#: Items are cut to stretches of so many words, texts to segments of so many bytes.
STRETCH, SEGMENT = 512, 1 << 20

#: A-Z in lower case, 0-9, a-z and all bytes of letters past ASCII; the rest is space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SPANS = "array<struct<start: long, end: long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column (null: none)."""
    for t in column:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def word_lists(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text in lists of a segment each, with the place of the first;
    a list repeats the last words of the one before, so that no window is cut."""
    data, at, before, n = data.translate(_LETTERS), 0, [], 0
    while True:
        end = len(data) if at + SEGMENT >= len(data) else data.find(b" ", at + SEGMENT)
        end = len(data) if end < 0 else end
        words = before + data[at:end].split()
        yield n - len(before), words
        n += len(words) - len(before)
        if end == len(data):
            return
        at, before = end, words[-(WINDOW - 1) :]


class Windows:
    """Shift table and buckets for the windows of ``size`` words in ``stretches``,
    (item, words) each."""

    def __init__(self, size: int, stretches: list[tuple[int, list[bytes]]]):
        self.size, self.block = size, min(BLOCK, size)
        self.words = [w for _, words in stretches for w in words]
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], np.int32)
        self.words = [w for w in map(list(number).__getitem__, ids)]  # one object a word
        starts, owners, at = [], [], 0
        for item, words in stretches:
            starts.append(np.arange(at, at + len(words) - size + 1))
            owners.append(np.full(len(words) - size + 1, item))
            at += len(words)
        starts, owners = np.concatenate(starts), np.concatenate(owners)
        _, first, same = np.unique(np.lib.stride_tricks.sliding_window_view(ids, size)[starts], axis=0, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        order = np.argsort(same, kind="stable")
        #: Start of each distinct window, and the items that hold it.
        self.starts = starts[first].tolist()
        self.items, self.items_at = owners[order], np.searchsorted(same[order], np.arange(len(first) + 1))
        bits = max(10, (4 * len(first)).bit_length())
        self.mask, far = (1 << bits) - 1, size - self.block + 1
        self.shift, self.far = bytearray([far]) * (1 << bits), far
        #: Windows by the slot of their last block, then by a hash of all their words.
        self.buckets: dict[int, dict[int, list[int]]] = {}
        for window, start in enumerate(self.starts):
            for place in range(far):  # words from the block's end to the window's end
                end = start + size - place
                slot = hash(tuple(self.words[end - self.block : end])) & self.mask
                if self.shift[slot] > place:
                    self.shift[slot] = place
                if not place:
                    self.buckets.setdefault(slot, {}).setdefault(hash(tuple(self.words[start:end])), []).append(window)

    def search(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(place, window) of every occurrence in ``words``."""
        size, shift, mask, mine, starts, found = self.size, self.shift, self.mask, self.words, self.starts, []
        at, n, block = size - 1, len(words), self.block
        while at < n:
            slot = hash((words[at - 1], words[at]) if block == 2 else (words[at],)) & mask
            step = shift[slot]
            if step:
                at += step
                continue
            here, text = at - size + 1, words[at - size + 1 : at + 1]
            for window in self.buckets[slot].get(hash(tuple(text)), ()):
                if mine[starts[window] : starts[window] + size] == text:
                    found.append((here, window))
                    break
            at += 1
        return found


class Benchmark:
    """The windows of some items by their number of words."""

    def __init__(self, rows: list[tuple[str | None, bytes, bool]]):
        numbers: dict[str | None, int] = {}
        by: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item, joined, whole in rows:
            words = joined.split()
            by.setdefault(len(words) if whole and len(words) < WINDOW else WINDOW, []).append((numbers.setdefault(item, len(numbers)), words))
        self.ids = list(numbers)
        self.tables = [Windows(size, found) for size, found in sorted(by.items())]

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words of a text, its hit stretches and the items found, both sorted."""
        n, spans, items = 0, [], set()
        for base, words in word_lists(data):
            n = base + len(words)
            for table in self.tables:
                found = table.search(words)
                spans += [(base + at, base + at + table.size) for at, _ in found]
                for window in {w for _, w in found}:
                    items.update(table.items[table.items_at[window] : table.items_at[window + 1]].tolist())
        return n, merged(spans), sorted(self.ids[k] for k in items if self.ids[k] is not None)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, words, whole: the items' words joined by spaces; long items in
    stretches that share all but one word of a window."""
    step = STRETCH - WINDOW + 1
    for batch in batches:
        rows = []
        for item, data in zip(batch.column("item").to_pylist(), _texts(batch.column("text")), strict=True):
            words = data.translate(_LETTERS).split()
            whole = len(words) <= STRETCH
            rows += [(item, b" ".join(words[at : at + STRETCH]), whole) for at in range(0, max(len(words) - WINDOW + 1, 1), step)] if words else []
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.bool_()), strict=True)], names=["item", "words", "whole"])


#: The tables that this worker process has built last.
_BUILT: dict[str, Benchmark] = {}


def _search(docs: DataFrame, key: str, kind: str, rows: list, sparse: bool) -> DataFrame:
    """key, n_words, spans, items of each row of ``docs``; ``sparse``: of those with hits."""
    sent, tag = docs.sparkSession.sparkContext.broadcast(rows), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _BUILT:
            _BUILT.clear()
            _BUILT[tag] = Benchmark(sent.value)
        scan = _BUILT[tag].scan
        for batch in slices(batches):
            found = [scan(data) for data in _texts(batch.column("text"))]
            keys, n = batch.column(key), pa.array([f[0] for f in found], pa.int64())
            spans = pa.array([[{"start": s, "end": e} for s, e in f[1]] for f in found], _SPAN_TYPE)
            out = pa.RecordBatch.from_arrays([keys, n, spans, pa.array([f[2] for f in found], pa.list_(pa.string()))], names=[key, "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(f[1]) for f in found], pa.bool_())) if sparse else out

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, spans {_SPANS}, items array<string>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged([(s["start"], s["end"]) for one in row for s in one]) for row in batch.column("spans").to_pylist()]
        items = [sorted({i for one in row for i in one}) for row in batch.column("items").to_pylist()]
        spans = pa.array([[{"start": s, "end": e} for s, e in row] for row in spans], _SPAN_TYPE)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), spans, pa.array(items, pa.list_(pa.string()))], names=["_row", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans and items of every row of ``docs``.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; words are runs of
    ASCII letters, digits and anything past ASCII, in lower case as far as A-Z go.
    spans are the stretches of words (from start, before end) that lie in
    occurrences of windows, items the ids, as sorted strings, of the items whose
    windows occur.  Null and empty texts have no words, items without words no
    window.  Rows with equal or null doc_id are searched each; rows with equal
    item_id count as one item; items with null item_id mark words and have no id to
    list.  An empty benchmark marks nothing.
    """
    items = stage(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_stretches, "item string, words binary, whole boolean"), "benchmark-words")
    total = items.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = lambda part: [tuple(r) for r in part.collect()]  # noqa: E731  a block, bounded by block_bytes
    if total <= block_bytes:
        return _search(docs, "doc_id", kind, read(items), sparse=False)
    blocks = -(-2 * total // block_bytes)  # dealt by hash: half full on average
    rows = stage(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "decontam-rows")
    slot = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    every = _search(rows, "_row", "long", [], sparse=False).select("_row", "n_words")
    hits = None
    for k in range(blocks):
        found = stage(_search(rows, "_row", "long", read(items.filter(slot == k)), sparse=True).select("_row", "spans", "items"), "decontam-hits")
        hits = found if hits is None else hits.union(found)
    gathered = hits.groupBy("_row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    hits = broadcast_if_small(stage(gathered.mapInArrow(_merge, f"_row long, spans {_SPANS}, items array<string>"), "decontam-merged"))
    ids = rows.select(F.col("_row").alias("_id"), "doc_id").join(every, F.col("_id") == F.col("_row")).select("_id", "doc_id", "n_words")
    out = ids.join(hits, F.col("_id") == F.col("_row"), "left")
    return out.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", _SPANS), ("items", "array<string>"))))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP13_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT kind, id, key, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS kind, row_number() OVER () AS id, doc_id::VARCHAR AS key, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), item_id::VARCHAR, text FROM benchmark)),
items AS MATERIALIZED (
  SELECT DISTINCT key AS item_id, m, array_to_string(w[spot:spot + m - 1], ' ') AS passage
  FROM (SELECT key, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS spot FROM words WHERE kind = 'b' AND len(w) > 0)),
places AS (SELECT id, m, w, unnest(range(1, len(w) - m + 2)) AS spot FROM words, (SELECT DISTINCT m FROM items) WHERE kind = 'd' AND len(w) >= m),
found AS MATERIALIZED (
  SELECT p.id, p.spot, p.m, i.item_id FROM (SELECT id, m, spot, array_to_string(w[spot:spot + m - 1], ' ') AS passage FROM places) p JOIN items i ON i.m = p.m AND i.passage = p.passage),
hit AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(spot, spot + m)) AS place FROM found) GROUP BY id),
listed AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY id)
SELECT d.key::BIGINT AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit h USING (id) LEFT JOIN listed l USING (id) WHERE d.kind = 'd'
"""
