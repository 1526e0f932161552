"""Spelling variants: words one edit apart, grouped under the most frequent form.

A word is a vector of letter counts.  One inserted, deleted or replaced letter adds at
most one to one count and takes at most one from another (L1 distance at most two), so
the words near to a word lie in a small range of the vectors of its own length, the
length below and the length above.  K-d trees answer these ranges: a branch is left
out when its box needs more letters added or removed than one edit allows, and what is
found is verified by the order of the letters.

A tree for each length is fitted on at most ``FIT_WORDS`` words and cuts the space into
cells; every word is a target in its one cell and a question in all cells that its
range touches.  A cell's targets form a tree of their own in a task.  Cells with
more words than planned are dealt out in pairs of blocks.  A question brings back a
count and its best answer from each cell, never its pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices
from tallyshelf.scratch import broadcast_if_small, stage

#: Counts of a-z, and of all other letters by code point in so many more.
LETTERS, OTHERS = 26, 6
#: Words that the cells are fitted on, targets of a cell, points of a leaf, letters of a
#: cell's words, questions of a block.
FIT_WORDS, CELL, LEAF, CELL_LETTERS, ASKED = 50_000, 16_384, 16, 1 << 22, 8
#: Questions and candidate pairs that are looked at together.
QUESTIONS, PAIRS = 1024, 1 << 17
#: Distinct words that a task counts before it sends them on; bytes of a text counted together.
COUNTED, SEGMENT = 300_000, 1 << 20

#: Code points up to 255: A-Z in lower case, a-z and U+00C0 to U+00FF; the rest is space.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def vectors(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    width = LETTERS + OTHERS
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    place = np.where((code >= 97) & (code <= 122), code - 97, LETTERS + code % OTHERS)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * width + place, minlength=len(words) * width).reshape(-1, width)
    return counts.astype(np.int16 if counts.max(initial=0) < 1 << 14 else np.int64)


class Tree:
    """A k-d tree over count vectors.  ``tight`` boxes hold the points alone; else
    they are the regions that the cuts leave, which hold any vector."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        width = points.shape[1]
        top = np.iinfo(points.dtype).max // 2
        self.order = np.arange(len(points))
        cut, level, left, right, lo, hi, begin, end = [], [], [], [], [], [], [], []
        todo = [(0, len(points), np.zeros(width, points.dtype), np.full(width, top, points.dtype), -1, False)]
        while todo:
            a, b, low, high, parent, second = todo.pop()
            k, mine = len(cut), points[self.order[a:b]]
            if tight and b > a:
                low, high = mine.min(0), mine.max(0)
            if parent >= 0:
                (right if second else left)[parent] = k
            for held, x in ((cut, 0), (level, 0), (left, -1), (right, -1), (lo, low), (hi, high), (begin, a), (end, b)):
                held.append(x)
            spread = mine.var(0) if b - a > leaf else np.zeros(1)
            d = int(spread.argmax())
            if spread[d] == 0:  # small enough, or all alike
                continue
            at = np.sort(mine[:, d])[(b - a) // 2]
            if at == mine[:, d].max():
                at -= 1
            inside = mine[:, d] <= at
            self.order[a:b] = np.concatenate([self.order[a:b][inside], self.order[a:b][~inside]])
            mid = a + int(inside.sum())
            cut[k], level[k] = d, int(at)
            under, over = high.copy(), low.copy()
            under[d], over[d] = at, at + 1
            todo += [(mid, b, over, high, k, True), (a, mid, low, under, k, False)]
        self.cut, self.level, self.left, self.right, self.begin, self.end = (np.array(x) for x in (cut, level, left, right, begin, end))
        self.lo, self.hi = np.array(lo), np.array(hi)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose region holds each point."""
        node = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(self.left[node] >= 0)):
            at = node[inner]
            node[inner] = np.where(points[inner, self.cut[at]] <= self.level[at], self.left[at], self.right[at])
        return node

    def leaves_near(self, points: np.ndarray, added: int, removed: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all boxes that so many added and removed letters can reach."""
        asked, node, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
        while len(asked):
            ends = self.left[node] < 0
            found.append((asked[ends], node[ends]))
            asked, node = asked[~ends], node[~ends]
            here, level = points[asked, self.cut[node]], self.level[node]
            low, high = here <= level + removed, here > level - added
            asked, node = np.concatenate([asked[low], asked[high]]), np.concatenate([self.left[node[low]], self.right[node[high]]])
            asked, node = self._within(points, asked, node, self.lo, self.hi, added, removed)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (asked, node)

    @staticmethod
    def _within(points, asked, other, lo, hi, added, removed):
        v = points[asked]
        ok = (np.maximum(lo[other] - v, 0).sum(1) <= added) & (np.maximum(v - hi[other], 0).sum(1) <= removed)
        return asked[ok], other[ok]

    def near(self, mine: np.ndarray, points: np.ndarray, added: int, removed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(point, place in ``mine``) of the tree's own points in reach, in parts."""
        asked, leaf = self.leaves_near(points, added, removed)
        n = self.end[leaf] - self.begin[leaf]
        sums = np.concatenate([[0], np.cumsum(n)])
        at = 0
        while at < len(asked):
            to = max(int(np.searchsorted(sums, sums[at] + PAIRS, "right")) - 1, at + 1)
            size = n[at:to]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[leaf[at:to]], size)
            yield self._within(points, np.repeat(asked[at:to], size), self.order[place], mine, mine, added, removed)
            at = to


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points are one inserted, deleted or replaced letter apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    m = short.shape[1]
    off = np.concatenate([long[:, :m] != short, np.ones((len(short), 1), bool)], axis=1)
    back = np.concatenate([np.ones((len(short), 1), bool), long[:, 1:] != short], axis=1)
    return off.argmax(1) + back[:, ::-1].argmax(1) >= m


def _answers(table: pa.Table) -> pa.Table:
    """word, n_near, near_n, near of the questions of a block with an answer in it."""
    is_target = table.column("target").to_numpy()
    words, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    own, weight, asked = words[is_target].tolist(), n[is_target], words[~is_target]
    out: list[tuple[list, ...]] = []
    if own and len(asked):
        size, mine, codes = len(own[0]), vectors(own), _codes(own)
        tree = Tree(mine, LEAF, tight=True)
        rank = np.empty(len(own), np.int64)
        rank[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
        lengths = np.array([len(w) for w in asked])
        for length in (size - 1, size, size + 1):
            every = asked[lengths == length].tolist()
            for at in range(0, len(every), QUESTIONS):
                some = every[at : at + QUESTIONS]
                q_codes, pairs = _codes(some), []
                for q, t in tree.near(mine, vectors(some), int(length <= size), int(length >= size)):
                    step = max(1, CELL_LETTERS // size)
                    for x in range(0, len(q), step):
                        ok = one_edit(q_codes[q[x : x + step]], codes[t[x : x + step]])
                        pairs.append((q[x : x + step][ok], t[x : x + step][ok]))
                q, t = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
                order = np.lexsort((rank[t], -weight[t], q))
                first, at_first, count = np.unique(q[order], return_index=True, return_counts=True)
                best = t[order][at_first]
                out.append(([some[k] for k in first], count.tolist(), weight[best].tolist(), [own[k] for k in best]))
    columns = [[x for part in out for x in part[k]] for k in range(4)]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "near_n", "near"])


def capacity(length: int) -> int:
    """Targets that a cell of words of this length is planned for."""
    return max(1, min(CELL, CELL_LETTERS // length))


def fit(sample: list[str], total: int) -> dict[int, Tree]:
    """A tree of regions for each length of the sampled words, of ``total`` in all."""
    by: dict[int, list[str]] = {}
    for w in sample:
        by.setdefault(len(w), []).append(w)
    share = len(sample) / max(total, 1)
    return {k: Tree(vectors(ws), max(8, int(capacity(k) * share)), tight=False) for k, ws in by.items()}


def _cells(forest: dict[int, Tree], words: list[str]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(length of the cells, whether targets, places in ``words``, leaves): each word
    once as a target, and as a question in all cells in reach."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        own = vectors([words[k] for k in at])
        tree = forest.get(length)
        yield length, True, at, tree.leaf_of(own) if tree else np.zeros(len(at), np.int64)
        for other in (length - 1, length, length + 1):
            tree = forest.get(other)
            asked, leaf = tree.leaves_near(own, int(other >= length), int(other <= length)) if tree else (np.arange(len(at)), np.zeros(len(at), np.int64))
            yield other, False, at[asked], leaf


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near for every word of ``words`` that has near ones: how many,
    and of these the one of largest n, ties to the smaller in code-point order.

    ``words`` has distinct non-empty words and their n, as a staged table.
    """
    spark = words.sparkSession
    total = words.count()
    sample = [r.word for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(FIT_WORDS).collect()]
    sent = spark.sparkContext.broadcast(fit(sample, total))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for length, target, _, leaves in _cells(sent.value, batch.column("word").to_pylist()):
                for leaf, n in zip(*(x.tolist() for x in np.unique(leaves, return_counts=True)), strict=True):
                    sums[length, leaf, target] += n
        rows = [(*k, n) for k, n in sums.items()]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["length", "leaf", "target", "n"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("word").to_pylist()
            for length, target, at, leaves in _cells(sent.value, held):
                same = lambda x, kind, n=len(at): pa.array([x], kind).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([same(length, pa.int64()), pa.array(leaves, pa.int64()), same(target, pa.bool_()), batch.column("word").take(pa.array(at)), batch.column("n").take(pa.array(at))], names=["length", "leaf", "target", "word", "n"])

    size = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_LETTERS) / F.greatest("length", F.lit(1)))))
    sums = words.select("word").mapInArrow(counted, "length long, leaf long, target boolean, n long").groupBy("length", "leaf")
    sums = sums.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in (("targets", F.col("target")), ("asked", ~F.col("target")))))
    blocks = sums.filter("targets > 0 and asked > 0").select("length", "leaf", F.ceil(F.col("targets") / (2 * size)).alias("t"), F.ceil(F.col("asked") / (ASKED * size)).alias("q"))
    blocks = broadcast_if_small(stage(blocks, "spelling-blocks"))  # at most a row a fitted word or length
    rows = words.select("word", "n").mapInArrow(dealt, "length long, leaf long, target boolean, word string, n long").join(blocks, ["length", "leaf"])
    mine = lambda c: F.array(F.pmod(F.xxhash64("word"), c))
    every = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    rows = rows.withColumn("tb", F.explode(F.when(F.col("target"), mine(F.col("t"))).otherwise(every(F.col("t")))))
    rows = rows.withColumn("qb", F.explode(F.when(F.col("target"), every(F.col("q"))).otherwise(mine(F.col("q")))))
    found = rows.groupBy("length", "leaf", "tb", "qb").applyInArrow(_answers, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): the end of the chain of
    forms, which must have no cycle.  Chains are halved each round."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        to = broadcast_if_small(now).select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        new = stage(now.join(to, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "spelling-roots")
        now = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return now


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    ``words`` has word and n; equal words are added up, null and empty ones left
    out; further columns are ignored.  Two words are near if they differ by one
    inserted, deleted or replaced code point.  form is a word's near word of largest
    n, ties to the smaller, if that is at least ``factor`` (over 1) times its own,
    else null; root is where following forms ends, the word itself without a form.
    """
    words = stage(words.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    near = near_words(words).select(F.col("word").alias("_word"), "n_near", "near_n", "near")
    is_form = F.col("near_n") >= factor * F.col("n")
    known = words.join(near, F.col("word") == F.col("_word"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    known = stage(known, "spelling-forms")
    ends = broadcast_if_small(roots(known.filter("form is not null"))).select(F.col("word").alias("_word"), "root")
    return known.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def run_counts(docs: DataFrame, least: int = 5, delete_every: int = 97) -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z
    in lower case, of at least ``least`` code points.

    Where ``delete_every`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses the
    code point at that number modulo its length (a null doc_id is empty; 0: never).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                start = crc32(f"{'' if doc is None else doc}:".encode())
                data = text.as_py().encode("latin-1", "replace").translate(_RUNS)
                at = 0
                while at < len(data):
                    end = data.find(b" ", at + SEGMENT)
                    end = len(data) if end < 0 else end
                    for word, n in Counter(data[at:end].split()).items():
                        if len(word) < least:
                            continue
                        if delete_every:
                            h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                            if h % delete_every == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                                if len(word) < least:
                                    continue
                        sums[word] += n
                    at = end
                if len(sums) > COUNTED:
                    yield out()
                    sums.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that occur three times or more."""
    counts = run_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spelling_variants(counts.groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 3"))


OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(named))), lambda i: ('0x' || substr(hex(encode(named)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM less a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM less a JOIN words w ON w.word = a.rest),
known AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.other_n >= 2 * w.n THEN x.other END AS form, CASE WHEN x.other_n >= 2 * w.n THEN x.other_n END AS form_n
  FROM words w LEFT JOIN (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word) x USING (word)),
up AS (SELECT word, word AS at_word, 0 AS steps FROM known UNION ALL SELECT up.word, k.form, steps + 1 FROM up JOIN known k ON k.word = up.at_word WHERE k.form IS NOT NULL)
SELECT k.word, k.form, r.root, k.n, k.n_near::BIGINT AS n_near, k.form_n
FROM known k JOIN (SELECT word, arg_max(at_word, steps) AS root FROM up GROUP BY word) r USING (word)
"""
