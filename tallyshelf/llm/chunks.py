"""Line deduplication by content-defined chunks.

Words are runs of bytes other than ASCII white space.  A text's chunks are

* each two neighbouring lines that have words, and
* runs of SEED words wherever a rolling hash over words is the least of some
  LONG - SEED + 1 neighbours, so that places follow the content, survive shifts,
  and every LONG words hold at least one, however long the line is.

Chunk hashes are grouped over all texts.  A chunk that occurs before is the seed
of a passage: its bytes and those of an earlier occurrence are compared, and so
are the words before and after it, up to LONG to each side.  The earlier one is
the last in the same text that lies LONG words or more before (of a line pair: as
many words as it has), else the first of all texts, by doc_id and place.  The
equal words are removed if they are LONG or more; of fewer, the whole lines are
removed if they are two or more.  Nothing is removed without an equal passage in
an earlier place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm import texthash
from tallyshelf.llm.batches import slices, unused
from tallyshelf.scratch import broadcast_if_small, stage

#: Words of a passage, and of a chunk inside lines.
LONG, SEED = 50, 25
#: First occurrences are fetched in ranges of so many words.
RANGE = 512
#: Bytes of texts that are hashed at once.
BYTES = 1 << 18
#: Sets hashes of line pairs apart from those of word runs.
_LINES = np.uint64(0x6C696E6573)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~texthash._SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(word))
    return edges[0::2], edges[1::2]


def _hashes(data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges a to b, in ascending order of both; texts are
    taken in segments."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(a):
        to = int(np.searchsorted(a, a[at] + texthash.SEGMENT))
        low, high = int(a[at]), int(b[to - 1])
        power, inverse = texthash._powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(texthash._LETTER[np.frombuffer(data, np.uint8, high - low, low)] * power[: high - low], out=sums[1:])
        first = a[at:to] - low
        out.append(texthash.mix((sums[b[at:to] - low] - sums[first]) * inverse[first]))
        at = to
    return np.concatenate(out)


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first word, words) of all chunks of some texts."""
    data = b"\n".join(texts)
    starts, ends = words(data)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    place = np.arange(len(starts)) - np.searchsorted(text, text)
    out = []
    if len(starts) >= LONG:
        last = len(starts) - SEED + 1
        inside = text[:last] == text[SEED - 1 :]
        h = np.full(last, np.uint64(2**64 - 1))
        at = np.flatnonzero(inside)
        h[at] = np.minimum(_hashes(data, starts[at], ends[at + SEED - 1]), np.uint64(2**64 - 2)) + np.uint64(1)
        w = LONG - SEED + 1
        least = np.where(text[: last - w + 1] == text[LONG - 1 :], _slide(h, w, np.minimum), np.uint64(0))
        rim = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([rim, least, rim]), w, np.maximum) == h)
        out.append((text[at], h[at], place[at], np.full(len(at), SEED)))
    if len(starts):
        line = np.cumsum(np.frombuffer(data, np.uint8) == 10)[starts]
        first = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(starts))
        at, to = first[:-2], first[2:]
        short = (text[at] == text[to - 1]) & (to - at < LONG)  # longer pairs hold word runs
        at, to = at[short], to[short]
        out.append((text[at], _hashes(data, starts[at], ends[to - 1]) ^ _LINES, place[at], to - at))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (*[np.empty(0, np.int64)] * 4,)


#: place is the chunk's first word * 64 + its words.
_CHUNKS = "hash long, doc_id long, h long, place long"


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h")]
        held, since, size = [], 0, 0
        for k, text in enumerate(batch.column("text")):
            held.append(text.as_py().encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size > BYTES or k == batch.num_rows - 1:
                of, found, at, n = chunks(held)
                of = of + since
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found.view(np.int64), keys[0][of], keys[1][of], at * 64 + n)], names=["hash", "doc_id", "h", "place"])
                held, since, size = [], k + 1, 0


def clusters(first_doc: np.ndarray, first_h: np.ndarray, delta: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, indices): chunks of one text that lie alike to the same earlier
    text and whose reaches touch; from and to are words, with LONG to each side."""
    order = np.lexsort((at, delta, first_h, first_doc))
    a, b = at[order] - LONG, (at + n)[order] + LONG
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(first_doc[order]) != 0) | (np.diff(first_h[order]) != 0) | (np.diff(delta[order]) != 0)
    group = np.cumsum(new)
    reach = np.maximum.accumulate(b + group * (1 << 32)) - group * (1 << 32)
    new[1:] |= a[1:] > reach[:-1]
    cuts = np.append(np.flatnonzero(new), len(order))
    return [(int(a[i]), int(reach[j - 1]), order[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def earlier(own: np.ndarray, group: np.ndarray, first_at: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the chunks of one text: the place of the last equal chunk (same group) in
    the text that is far enough before (-1: none); ``own`` says whose first
    occurrence is in this text, too.  And which are to be compared with it."""
    heads = np.flatnonzero(own)
    held = np.unique(np.concatenate([group, group[heads]]) * (1 << 40) + np.concatenate([at, first_at[heads]]))
    wanted = group * (1 << 40) + at - np.where(n == SEED, LONG, n)
    k = np.searchsorted(held, wanted, side="right") - 1
    found = held[np.maximum(k, 0)]
    return np.where((k >= 0) & (found >> 40 == group), found & ((1 << 40) - 1), -1), ~own


#: Passages found in the text itself have no first_doc; low and delta are their
#: first word and their words.
_SEEDS = "doc_id long, h long, low long, bytes binary, first_doc long, first_h long, first_low long, first_high long, delta long, seeds array<long>, opens boolean, closes boolean"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that repeat in one text; and the bytes around the chunks that others
    hold, a row a cluster, with the range of words they are compared with."""
    for batch in slices(batches):
        rows = []
        for doc, h, text, found in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "found")), strict=True):
            data, doc, h = text.as_py().encode("utf-8", "surrogatepass"), doc.as_py(), h.as_py()
            starts, ends = words(data)
            of, oh, fp, place = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("first_doc", "first_h", "first_place", "place"))
            at, n, first_at = place >> 6, place & 63, fp >> 6
            order = np.lexsort((fp, oh, of))
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(np.append(False, (np.diff(of[order]) != 0) | (np.diff(oh[order]) != 0) | (np.diff(fp[order]) != 0)))
            before, others = earlier((of == doc) & (oh == h), group, first_at, at, n)
            inner = np.flatnonzero(before >= 0)
            opens = lambda k: k == 0 or b"\n" in data[ends[k - 1] : starts[k]]  # noqa: B023, E731
            zero = np.zeros(len(inner), np.int64)
            for low, high, mine in clusters(zero, zero, (at - before)[inner], at[inner], n[inner]):
                mine = inner[mine]
                d = int(at[mine[0]] - before[mine[0]])
                low, high = max(low, d), min(high, len(starts))
                a, b = ((data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in ((low, high), (low - d, high - d)))
                seeds = list(zip((at[mine] - low).tolist(), n[mine].tolist(), strict=True))
                rows += [(doc, h, low + k, None, None, None, None, None, size, None, None, None) for k, size in common(*a, *b, 0, seeds, opens(low), high == len(starts) or opens(high))]
            outer = np.flatnonzero((before < 0) & others)
            for low, high, mine in clusters(of[outer], oh[outer], (at - first_at)[outer], at[outer], n[outer]):
                mine = outer[mine]
                d = int(at[mine[0]] - first_at[mine[0]])
                low, high = max(low, 0, d), min(high, len(starts))
                range_ = ((low - d) // RANGE * RANGE, -(-(high - d) // RANGE) * RANGE)
                rows.append((doc, h, low, data[starts[low] : ends[high - 1]], int(of[mine[0]]), int(oh[mine[0]]), *range_, d, place[mine], opens(low), high == len(starts) or opens(high)))
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.bool_(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SEEDS.split(", ")])


_EARLIER = "first_doc long, first_h long, first_low long, first_high long, first_bytes binary"


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc, h, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "ranges")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            starts, ends = words(data)
            for r in ranges:
                if r["first_low"] < len(starts):
                    rows.append((doc, h, r["first_low"], r["first_high"], data[starts[r["first_low"]] : ends[min(r["first_high"], len(starts)) - 1]]))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=[c.split()[0] for c in _EARLIER.split(", ")])


def common(a: bytes, sa: np.ndarray, ea: np.ndarray, b: bytes, sb: np.ndarray, eb: np.ndarray, shift: int, seeds: list[tuple[int, int]], opens: bool, closes: bool) -> list[tuple[int, int]]:
    """(first word, words) of ``a`` to remove.  ``sa`` and ``ea``, ``sb`` and ``eb``
    are the words of both; ``seeds`` are chunks (first word, words) of ``a``; word k of ``a`` lies with word k + shift of ``b``.  ``opens``
    and ``closes`` say whether a line begins or ends where ``a`` does."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    out, done = [], -1
    runs: list[list[int]] = []  # first and end of the equal words, and of the seeds' reach
    for at, n in sorted(seeds):
        if at < done:  # the run before holds this chunk as well
            if at + n <= done:
                runs[-1][3] = max(runs[-1][3], at + n + LONG)
            continue
        i, j = int(sa[at]), int(sb[at + shift]) if at + shift < len(sb) else len(b)
        m = min(len(x) - i, len(y) - j)
        differ = np.flatnonzero(x[i : i + m] != y[j : j + m])
        m = int(differ[0]) if len(differ) else m
        end = int(np.searchsorted(ea, i + m, side="right"))
        if end > at and ea[end - 1] == i + m:  # the word ends here in a; does it in b?
            p = at + shift + (end - at) - 1
            end -= p >= len(eb) or eb[p] != j + m
        if end < at + n:
            continue
        m = min(i, j)
        differ = np.flatnonzero(x[i - m : i] != y[j - m : j])
        m = m - 1 - int(differ[-1]) if len(differ) else m
        first = int(np.searchsorted(sa, i - m, side="left"))
        if first < at and sa[first] == i - m and sb[first + shift] != j - m:
            first += 1
        first = min(first, at)
        done = end
        runs.append([first, end, at - LONG, at + n + LONG])
    breaks = np.cumsum(x == 10)[sa]
    for first, end, low, high in runs:
        first, end = max(first, low), min(end, high)
        if end - first >= LONG:
            out.append((first, end - first))
            continue
        head = [k for k in range(first, end) if (opens if k == 0 else breaks[k] != breaks[k - 1])]
        tail = [k for k in range(first, end) if (closes if k + 1 == len(sa) else breaks[k + 1] != breaks[k])]
        if head and tail and breaks[tail[-1]] > breaks[head[0]]:
            out.append((head[0], tail[-1] + 1 - head[0]))
    return out


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b, cut = None, ()
    for batch in slices(batches):
        rows = []
        for r in batch.to_pylist():
            if r["first_bytes"] != b:  # rows come by their earlier text
                b = r["first_bytes"]
                cut = words(b)
            seeds = [((p >> 6) - r["low"], p & 63) for p in r["seeds"]]
            found = common(r["bytes"], *words(r["bytes"]), b, *cut, r["low"] - r["delta"] - r["first_low"], seeds, r["opens"], r["closes"])
            rows += [(r["doc_id"], r["h"], at + r["low"], n) for at, n in found]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "h", "at", "n"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, n): first word and number of words of the passages to
    remove, h being the hash of the text."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").filter("doc_id is not null and text <> ''")
    found = stage(texts.mapInArrow(_chunk_rows, _CHUNKS), "chunks")
    first = found.groupBy("hash").agg(F.min(F.struct("doc_id", "h", "place")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    first = stage(first.select("hash", F.col("f.doc_id").alias("first_doc"), F.col("f.h").alias("first_h"), F.col("f.place").alias("first_place")), "chunks-first")
    again = found.join(first.hint("merge"), "hash")  # both grow with the words: one plan at every size
    again = again.filter("doc_id <> first_doc or h <> first_h or place <> first_place")
    seed = F.struct("first_doc", "first_h", "first_place", "place")
    seeds = stage(again.select("doc_id", "h", seed.alias("s")).groupBy("doc_id", "h").agg(F.collect_set("s").alias("found")), "chunks-again")
    near = texts.join(seeds.hint("merge"), ["doc_id", "h"])
    near = stage(near.mapInArrow(_near, _SEEDS), "chunks-near")
    apart = near.filter("first_doc is not null")
    wanted = apart.select("first_doc", "first_h", F.struct("first_low", "first_high").alias("r")).groupBy("first_doc", "first_h").agg(F.collect_set("r").alias("ranges"))
    wanted = stage(wanted.select(F.col("first_doc").alias("doc_id"), F.col("first_h").alias("h"), "ranges"), "chunks-wanted")
    sources = texts.join(broadcast_if_small(wanted), ["doc_id", "h"]).mapInArrow(_earlier, _EARLIER).distinct()
    found = apart.join(sources, ["first_doc", "first_h", "first_low", "first_high"]).mapInArrow(_passages, "doc_id long, h long, at long, n long")
    inside = near.filter("first_doc is null").select("doc_id", "h", F.col("low").alias("at"), F.col("delta").alias("n"))
    return found.union(inside).distinct()


def without(text: str, gone: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text less the passages (first word, words), words removed, lines removed).

    What is left keeps its bytes.  A passage from the start of a line goes with
    the white space after it, another one with the white space before it.
    """
    data = text.encode("utf-8", "surrogatepass")
    starts, ends = words(data)
    drop = np.zeros(len(starts) + 1, np.int64)
    for at, n in gone:
        if at + n <= len(starts):
            drop[at] += 1
            drop[at + n] -= 1
    dropped = np.cumsum(drop)[:-1] > 0
    if not len(starts) or not dropped.any():
        return text, 0, 0
    n = int(dropped.sum())
    line = np.cumsum(np.frombuffer(data, np.uint8) == 10)[starts]
    lines = len(np.unique(line)) - len(np.unique(line[~dropped]))
    if n == len(starts):
        return "", n, lines
    edges = np.flatnonzero(np.diff(np.concatenate([[0], dropped.astype(np.int8), [0]])))
    keep, done = [], 0
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        if b < len(starts) and (a == 0 or line[a] != line[a - 1]):
            keep.append(data[done : starts[a]])
            done = int(starts[b])
        else:
            keep.append(data[done : ends[a - 1]])
            done = int(ends[b - 1])
    keep.append(data[done:])
    return b"".join(keep).decode("utf-8", "surrogatepass"), n, lines


def _strip(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(text, gone, strict=True):
        out.append(without(t.as_py(), [(x["at"], x["n"]) for x in g.as_py()]) if t.is_valid and g.is_valid else (None, 0, 0))
    columns = zip(*out, strict=True) if out else [()] * 3
    kinds = (pa.string(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text", "words", "lines"])


def dedup_lines(docs: DataFrame, counted: bool = False, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with the texts less their repeated passages (and words_removed and
    lines_removed, of words and of whole lines, if ``counted``).

    Columns and rows stay as they are; a column n_chars is set to the new length
    where a text changed.  Null and empty texts stay.  Rows with a null doc_id are
    neither counted nor changed.  Rows that share a doc_id are told apart by their
    texts, the one with the smaller hash being the earlier; rows alike in doc_id
    and text are one document, and stay alike.  A text all of whose words are
    repeated becomes empty; its row goes unless ``keep_emptied``.
    """
    gone = stage(repeated_passages(docs).groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "n")).alias("gone")), "chunks-gone")
    names = [c for c in docs.columns if not (counted and c in ("words_removed", "lines_removed"))]
    i, h, g, s = unused(docs.columns, "i", "h", "g", "s")
    gone = broadcast_if_small(gone).select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("gone").alias(g))
    joined = docs.join(gone, (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    strip = F.arrow_udf(_strip, "struct<text string, words long, lines long>")
    out = joined.withColumn(s, strip(F.when(F.col(g).isNotNull(), F.col("text")), F.col(g)))
    changed = F.col(f"{s}.words") > 0
    if not keep_emptied:
        out = out.filter(F.coalesce(~changed | (F.col(f"{s}.text") != ""), F.lit(True)))
    new = {"text": F.when(changed, F.col(f"{s}.text")).otherwise(F.col("text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.char_length(f"{s}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    tally = [F.col(f"{s}.words").alias("words_removed"), F.col(f"{s}.lines").alias("lines_removed")] if counted else []
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in names), *tally)


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents: lines and words removed and the digest of what is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), counted=True)
    return out.select("doc_id", "lines_removed", "words_removed", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
