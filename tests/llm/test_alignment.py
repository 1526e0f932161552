"""Alignments against a comparison of all token pairs by their byte ranges."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyshelf.llm import alignment
from tallyshelf.llm.tokens import default_path

TEXTS = [
    "Hello  world, it's 12,345 tokens\n\n  and   tabs\t\tx ", "", None, " leading", "ünï 日本語 🙂🙂 café", "x" * 500, "<|endoftext|> a <s> <0x41> </s> <unk> b", "bad ▁ mark", "a", " ",
    "\n", "trailing   ", "the cat sat on the mat. The cat sat.", "the cat sat on the mat. The cat sat.", "co-op (re)tokenise http://x.y/z?q=1&r=2 naïve", "é ​ z \x00 nul", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 30,
]


def plain(texts):
    """Rows of op12's digest by definition."""
    a = Tokenizer.from_file(default_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    b_bytes = alignment.piece_bytes(b)
    out, linked = [], []
    for text in texts:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta, tb = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia], [b_bytes[i] for i in ib]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            out.append((0, 0, 0, ""))
            linked.append([])
            continue
        ends = [[sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (ta, tb)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [",".join(str(i) for i, e in zip(ids, es) if lo < e <= hi) for lo, hi in zip([0, *both], both) for ids, es in ((ia, ends[0]), (ib, ends[1]))]
        said = ";".join(f"{x}|{y}" for x, y in zip(groups[::2], groups[1::2]))
        linked.append([(x, y) for x, ex, tx in zip(ia, ends[0], ta) for y, ey, ty in zip(ib, ends[1], tb) if max(ex - len(tx), ey - len(ty)) < min(ex, ey)])
        out.append((len(ia), len(ib), len(both), said))
    docs = Counter(p for links in linked for p in set(links))
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    return [(*o[:3], len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), o[3]) for o, links in zip(out, linked)], docs, most


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("chunk", [alignment.CHUNK_PAIRS, 5])
def test_equals_all_pairs(spark, monkeypatch, chunk):
    frame = spark.createDataFrame([(k if k != 3 else None, t, "x", "y") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "", "")], "doc_id long, text string, chunk string, groups string")
    want, docs, most = plain([*TEXTS, TEXTS[0]])
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", chunk)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align(frame.coalesce(2)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[0] > 0 for w in want) >= 13
    digests = [r.groups for r in alignment.align(frame, digest=True).collect()]
    assert sorted(digests) == sorted(hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "" for w in want)
    pairs = {(r.a, r.b): (r.docs, r.best) for r in alignment.pair_counts(frame).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in docs.items()}


def test_memo_emptied_and_long_windows(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_LINKS", 3)
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 2)
    one = alignment.Aligner(default_path(), alignment.piece_path())
    want = plain(TEXTS)[0]
    for _ in range(2):
        got = [x for t in TEXTS for x in one.align([t])]
        assert [x[:4] for x in one.align(TEXTS)] == [x[:4] for x in got]
        assert [(*g[:3], len(g[4]), g[3]) for g in got] == [(*w[:4], w[6]) for w in want]


def test_empty_and_query(spark, sf):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(25).toPandas()
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    got = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.align(frame).collect())
    assert got == sorted(plain([t[:] for t in docs.text])[0])
    out = alignment.op12(spark, sf)
    assert out.columns == ["doc_id", *COLUMNS[:6], "groups_sha256"] and out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
