"""Alignment of two tokenizers' tokens over the same texts.

Each text, with a space before it, is tokenised whole by a byte-level BPE vocabulary
(A) and by a sentencepiece model (B, which adds the space itself).  Places where a
token of either side that starts with white space begins at the same byte are
anchors; they split the document into windows of a few tokens.  A window's
alignment depends on its ids alone, so it is worked out once for each tuple of
ids and kept in the worker: groups, cut where tokens of both sides end, and links,
the A-B pairs whose byte ranges overlap.

No token of either side crosses a single space that a letter or sign follows (A cuts
there; B has no piece with a space after anything else, which is looked up in the
model), and the token after it is marked on both sides.  So the whole tokenisation of a
text without white space next to white space is that of its stretches between
spaces, each of which is a window; the stretches not met before in a slice of
documents are tokenised together, and remembered with the number of their window.  All
other texts are tokenised and cut to windows as wholes.

What is gathered from the corpus is, for each pair of ids, how many documents hold
it linked.  A worker sends each chunk's distinct pairs with the chunk's counts; the
totals come back to a chunk for its own pairs only, and meet its documents there.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices
from tallyshelf.llm.tokens import default_path, encoder
from tallyshelf.scratch import stage

#: Links kept in a worker's window memo before it is emptied, and the most tokens of
#: a window that is kept.
MEMO_LINKS, MEMO_TOKENS = 1 << 21, 48
#: Stretches between spaces whose windows are kept, and marks of those that have none:
#: white space next to white space, and bytes that B doesn't give back.
STRETCHES, _UNEVEN, _OTHER = 400_000, -1, -2
#: Distinct pairs of documents that a chunk gathers before it ends.
CHUNK_PAIRS = 1 << 19

_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """The process's aligner of two vocabulary files."""
    key = (a_path or default_path(), b_path or piece_path())
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def piece_bytes(model) -> list[bytes]:
    """The bytes that each id of a sentencepiece model stands for."""
    ids = range(model.get_piece_size())
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = encoder(a_path).fast
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes = [b""] * self.a.n_vocab
        for i in range(self.a.n_vocab):
            try:
                a_bytes[i] = self.a.decode_single_token_bytes(i)
            except KeyError:  # a special token of the file, which is never met
                pass
        self.b_bytes = piece_bytes(self.b)
        self.a_len, self.b_len = [len(x) for x in a_bytes], [len(x) for x in self.b_bytes]
        self.a_size, self.b_size = len(a_bytes), len(self.b_bytes)
        self._a_len, self._b_len = np.array(self.a_len), np.array(self.b_len)
        self._a_mark, self._b_mark = (np.array([x[:1] == b" " for x in t]) for t in (a_bytes, self.b_bytes))
        #: Whether no piece of B holds a space after anything else.
        self._cut = all(b" " not in x.lstrip(b" ") for x in self.b_bytes)
        self._said = [str(i) for i in range(max(self.a_size, self.b_size))]
        self.empty_memo()

    def empty_memo(self) -> None:
        self.number: dict[bytes, int] = {}
        self.texts: list[str] = []
        #: Of each window: tokens of A and of B, groups, and where its links begin.
        self.n_a, self.n_b, self.groups, self.begin, self.links = (array("q") for _ in range(5))
        self.stretch: dict[str, int] = {}

    def _window(self, key: bytes, n_a: int) -> int:
        """The number of a window whose alignment isn't kept yet: ``n_a`` ids of A, then
        those of B past A's.  Both sides end at the same byte."""
        ids = np.frombuffer(key, np.uint32).tolist()
        a_len, b_len, said, a_size, b_size = self.a_len, self.b_len, self._said, self.a_size, self.b_size
        i, j, a_end, b_end, a_ids, b_ids, texts, links = -1, n_a - 1, 0, 0, "", "", [], []
        while True:
            if a_end == b_end:
                if i >= 0:
                    texts.append(f"{a_ids}|{b_ids}")
                if i + 1 == n_a:
                    break
                i, j = i + 1, j + 1
                a, b = ids[i], ids[j] - a_size
                a_ids, b_ids = said[a], said[b]
                a_end += a_len[a]
                b_end += b_len[b]
            elif a_end < b_end:
                i += 1
                a = ids[i]
                a_ids += "," + said[a]
                a_end += a_len[a]
            else:
                j += 1
                b = ids[j] - a_size
                b_ids += "," + said[b]
                b_end += b_len[b]
            links.append(a * b_size + b)
        k = len(self.texts)
        if len(ids) <= MEMO_TOKENS:
            self.number[key] = k
        self.texts.append(";".join(texts))
        self.n_a.append(n_a)
        self.n_b.append(len(ids) - n_a)
        self.groups.append(len(texts))
        self.begin.append(len(self.links))
        self.links.extend(links)
        return k

    def _learn(self, new: list[str]) -> None:
        """The windows of stretches between spaces, by their ids on both sides."""
        odd = {w for w in new if not w or w[0].isspace()}
        self.stretch.update(dict.fromkeys(odd, _UNEVEN))
        new = [w for w in new if w not in odd]
        if not new:
            return
        own = [f" {w}".encode() for w in new]
        a = self.a.encode_to_numpy("".join([f" {w}" for w in new])).astype(np.int64)
        starts = np.flatnonzero(self._a_mark[a])
        if len(starts) != len(new) or (np.add.reduceat(self._a_len[a], starts) != [len(x) for x in own]).any():
            parts = [self.a.encode_ordinary(f" {w}") for w in new]
        else:
            ids, cuts = a.tolist(), [*starts.tolist(), len(a)]
            parts = [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        shift = self.a_size
        for w, data, x, y in zip(new, own, parts, self.b.encode(new), strict=True):
            if b"".join([self.b_bytes[i] for i in y]) != data:
                self.stretch[w] = _OTHER
                continue
            key = array("I", [*x, *[i + shift for i in y]]).tobytes()
            k = self.number.get(key)
            self.stretch[w] = self._window(key, len(x)) if k is None else k

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where they don't give the text's bytes back."""
        a, b = self.a.encode_to_numpy(f" {text}").astype(np.int64), self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != f" {text}".encode():
            return None
        return a, np.array(b)

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The numbers of a document's windows in order."""
        a_at, b_at = np.cumsum(self._a_len[a]) - self._a_len[a], np.cumsum(self._b_len[b]) - self._b_len[b]
        i, j = np.flatnonzero(self._a_mark[a]), np.flatnonzero(self._b_mark[b])
        begun = np.zeros(int(a_at[-1]) + self.a_len[a[-1]], np.int8)
        begun[a_at[i]] = 1
        begun[b_at[j]] += 1
        i, j = i[begun[a_at[i]] == 2], j[begun[b_at[j]] == 2]
        if not len(i) or i[0] or j[0]:
            i, j = np.concatenate([[0], i]), np.concatenate([[0], j])
        # one row of ids: each window's ids of A, then those of B past A's
        row = np.empty(len(a) + len(b), np.uint32)
        row[np.arange(len(a)) + np.repeat(j, np.diff(i, append=len(a)))] = a
        ends = np.append(i[1:], len(a))
        row[np.arange(len(b)) + np.repeat(ends, np.diff(j, append=len(b)))] = b + self.a_size
        data, cuts = row.tobytes(), (4 * (i + j)).tolist()
        get, new = self.number.get, self._window
        out = []
        for start, end, n_a in zip(cuts, [*cuts[1:], len(data)], (ends - i).tolist(), strict=True):
            k = get(key := data[start:end])
            out.append(new(key, n_a) if k is None else k)
        return out

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """For each text: tokens of A and of B, groups, the groups as text, and the links
        as a * (size of B) + b."""
        if len(self.links) > MEMO_LINKS or len(self.stretch) > STRETCHES:
            self.empty_memo()
        get, new, cut = self.stretch.get, set(), []
        for text in texts:
            words = text.split(" ") if text and self._cut else []
            found = [get(w) for w in words]
            if None in found:
                new.update([w for w, k in zip(words, found, strict=True) if k is None])
            cut.append((words, found))
        self._learn(list(new))
        numbers: list[list[int]] = []
        for text, (words, found) in zip(texts, cut, strict=True):
            if None in found:
                found = [get(w) if k is None else k for w, k in zip(words, found, strict=True)]
            if text and (not found or _UNEVEN in found):
                ids = self.tokens(text)
                found = [] if ids is None else self.windows(*ids)
            numbers.append([] if _OTHER in found else found)
        tables = [np.frombuffer(x, np.int64) for x in (self.n_a, self.n_b, self.groups, self.begin)]
        ends, links, said = np.append(tables[3][1:], len(self.links)), np.frombuffer(self.links, np.int64), self.texts
        out = []
        for found in numbers:
            k = np.array(found, np.int64)
            start = tables[3][k]
            n = ends[k] - start
            at = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
            out.append((*(int(t[k].sum()) for t in tables[:3]), ";".join([said[x] for x in found]), links[at]))
        return out


def _schema(kind: str, code: str) -> str:
    return f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, pairs array<{code}>, times array<int>, whole boolean"


def _aligned(docs: DataFrame, a_path: str | None, b_path: str | None, digest: bool) -> tuple[DataFrame, int]:
    """A row for each document with its distinct pairs and how often it has them, and
    one (whole) for each chunk with its pairs and how many documents hold them;
    with the number of ids of B."""
    tools = aligner(a_path, b_path)
    code = ("int", pa.int32(), np.int32) if tools.a_size * tools.b_size < 1 << 31 else ("long", pa.int64(), np.int64)
    doc_type = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align = aligner(a_path, b_path).align
        chunk, gathered = TaskContext.get().partitionId() << 24, []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(code[1]), pa.list_(pa.int32()), pa.bool_())
        names = ["n_a", "n_b", "n_groups", "n_links", "groups", "chunk", "pairs", "times", "whole"]
        ids = pa.int64()

        def out(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

        def whole() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(gathered), return_counts=True)
            return out(pa.nulls(1, ids), [(0, 0, 0, 0, "", chunk, pairs, n.astype(np.int32), True)])

        size = 0
        for batch in slices(batches):
            rows, ids = [], batch.column("doc_id").type
            for n_a, n_b, n_groups, groups, links in align(batch.column("text").to_pylist()):
                pairs, times = np.unique(links.astype(code[2]), return_counts=True)
                gathered.append(pairs)
                size += len(pairs)
                if digest and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                rows.append((n_a, n_b, n_groups, len(links), groups, chunk, pairs, times.astype(np.int32), False))
                if size > CHUNK_PAIRS:
                    at = len(rows)
                    yield out(batch.column("doc_id").slice(0, at), rows)
                    yield whole()
                    batch, rows, gathered, size, chunk = batch.slice(at), [], [], 0, chunk + 1
            yield out(batch.column("doc_id"), rows)
        if size:
            yield whole()

    return stage(docs.select("doc_id", "text").mapInArrow(run, _schema(doc_type, code[0])), "align-documents"), tools.b_size


def _counted(aligned: DataFrame, b_size: int) -> tuple[DataFrame, DataFrame]:
    """(in_chunk, pair) of the chunks, and (pair, docs, best) of the corpus.  The
    highest count of each id of A is a table of one row an id: its size is bounded
    by the vocabulary, so it is broadcast."""
    held = aligned.filter("whole").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.times").alias("docs"))
    totals = stage(held.groupBy("pair").agg(F.sum("docs").alias("docs")), "align-totals")
    of = (F.col("pair") - F.pmod("pair", F.lit(b_size))) / b_size
    best = totals.groupBy(of.cast("long").alias("_a")).agg(F.max("docs").alias("most"))
    ranked = totals.withColumn("_a", of.cast("long")).join(F.broadcast(best), "_a")
    return held.select(F.col("chunk").alias("in_chunk"), "pair"), ranked.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b, docs, best: every pair of ids that some document links, how many
    documents do, and whether no pair of the same a has more."""
    aligned, b_size = _aligned(docs, a_path, b_path, digest=True)
    b = F.pmod("pair", F.lit(b_size))
    return _counted(aligned, b_size)[1].select(((F.col("pair") - b) / b_size).cast("long").alias("a"), b.cast("long").alias("b"), "docs", "best")


def _score(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk with sums over their links of the corpus counts."""
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, n, best = pair[order], counts.column("docs").to_numpy()[order], counts.column("best").to_numpy()[order]
    pairs = docs.column("pairs").combine_chunks()
    ends = np.cumsum([0, *docs.column("pairs").combine_chunks().value_lengths().to_pylist()])
    flat, times = pairs.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    at = np.searchsorted(pair, flat)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((times * best[at], times * n[at]) if len(flat) else (times, times))]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, s in zip(("n_best", "count_sum"), sums, strict=True):
        out = out.append_column(name, pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()))
    return out.append_column("groups", docs.column("groups"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row.

    ``docs`` needs doc_id and text.  groups is the alignment as text, ids of A and B
    by group (``a1,a2|b1;a3|b2,b3``), or its SHA-256 with ``digest``; n_links counts
    pairs of token occurrences whose bytes overlap, n_best those whose id pair is
    linked in as many documents as any of its A id, count_sum adds up the numbers of
    documents.  Texts that are null, empty or not given back byte by byte (those
    with U+2581, which B takes for a space) have no tokens: zeros and empty groups.
    Rows with equal or null doc_id are documents each.
    """
    aligned, b_size = _aligned(docs, a_path, b_path, digest)
    held, ranked = _counted(aligned, b_size)
    counts = held.join(ranked, "pair")
    rows = aligned.filter("not whole").drop("whole")
    kind = aligned.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return rows.groupBy("chunk").cogroup(counts.groupBy("in_chunk")).applyInArrow(_score, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the 50,257-id byte vocabulary against the 32,000-id pieces."""
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
