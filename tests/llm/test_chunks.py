"""Repeated passages against a plain search over the same chunks, and planted ones."""

import random
import re

from pyspark.sql import functions as F
from test_operators import docs, prose

from tallyshelf.llm import chunks

LONG, SEED = chunks.LONG, chunks.SEED


def split(text):
    """Words with the white space before each, and the line of each."""
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text.encode())]
    data = text.encode()
    gaps = [data[(found[k - 1][1] if k else 0) : a] for k, (a, _) in enumerate(found)]
    lines = [data[:a].count(b"\n") for a, _ in found]
    return [data[a:b] for a, b in found], gaps, lines


def seeds(text, parts):
    """(key, first word, words) of the chunks of one text, by plain loops."""
    words, gaps, lines = parts
    span = lambda a, n: words[a] + b"".join(g + w for g, w in zip(gaps[a + 1 : a + n], words[a + 1 : a + n], strict=True))
    heads = [k for k in range(len(words)) if k == 0 or lines[k] != lines[k - 1]] + [len(words)]
    out = [(b"l" + span(a, c - a), a, c - a) for a, c in zip(heads, heads[2:], strict=False) if c - a < LONG]
    if len(words) >= LONG:
        found = chunks.words(text.encode())
        last = len(words) - SEED + 1
        h = chunks._hashes(text.encode(), found[0][:last], found[1][SEED - 1 :]).tolist()
        w = LONG - SEED + 1
        picked = {k for j in range(last - w + 1) for k in range(j, j + w) if h[k] == min(h[j : j + w])}
        out += [(b"w" + span(k, SEED), k, SEED) for k in sorted(picked)]
    return out


def brute(texts, ids=None):
    ids = ids or list(range(len(texts)))
    parts = {i: split(t) for i, t in zip(ids, texts, strict=True) if t}
    first, gone = {}, {i: [] for i in ids}
    for i, t in sorted((i, t) for i, t in zip(ids, texts, strict=True) if t):
        words, gaps, lines = parts[i]
        places = {}
        for key, at, n in sorted(seeds(t, parts[i]), key=lambda s: s[1]):
            d, p = first.setdefault(key, (i, at))
            here = places.setdefault(key, [])
            here.append(at)
            before = [x for x in here if x <= at - (LONG if key[:1] == b"w" else n)]
            if before:
                d, p = i, before[-1]
            elif d == i:
                continue
            other, og, _ = parts[d]
            a, b = at, at + n
            while a > max(0, at - LONG) and a - 1 - at + p >= 0 and words[a - 1] == other[a - 1 - at + p] and gaps[a] == og[a - at + p]:
                a -= 1
            while b < min(len(words), at + n + LONG) and b - at + p < len(other) and words[b] == other[b - at + p] and gaps[b] == og[b - at + p]:
                b += 1
            gone[i].append((d, at - p, a, b))
    out = {}
    for i, t in zip(ids, texts, strict=True):
        drop = []
        if t:
            words, gaps, lines = parts[i]
            merged = []  # reaches that touch inside one run of equal words are one passage
            for d, delta, a, b in sorted(set(gone[i])):
                if merged and merged[-1][:2] == [d, delta] and a <= merged[-1][3] and all(words[k] == parts[d][0][k - delta] and gaps[k] == parts[d][1][k - delta] for k in range(merged[-1][3], min(a + 1, b)) if k):
                    merged[-1][3] = max(b, merged[-1][3])
                else:
                    merged.append([d, delta, a, b])
            for _, _, a, b in merged:
                if b - a < LONG:
                    heads = [k for k in range(a, b) if k == 0 or lines[k] != lines[k - 1]]
                    tails = [k for k in range(a, b) if k + 1 == len(words) or lines[k + 1] != lines[k]]
                    if not heads or not tails or lines[tails[-1]] <= lines[heads[0]]:
                        continue
                    a, b = heads[0], tails[-1] + 1
                drop.append((a, b - a))
        out[i] = chunks.without(t, drop)[0] if drop else t
    return out


def run(spark, texts, ids=None):
    return chunks.dedup_lines(docs(spark, *texts, ids=ids).repartition(3), counted=True).collect()


def test_passage_inside_longer_lines_goes(spark):
    p = prose(7, 53)
    texts = [f"{prose(10 + k, 20 + k)} {p} {prose(30 + k, 15)}\n{prose(60 + k, 9)}" for k in range(5)]
    got = {r.doc_id: r for r in run(spark, texts)}
    assert got[0].text == texts[0]
    assert all(got[k].text == texts[k].replace(p + " ", "") and got[k].words_removed == 53 for k in range(1, 5))


def test_short_lines_go_whole(spark):
    texts, kinds = [], [(2, 6), (3, 20), (8, 12)]
    shared = ["\n".join(prose(100 * n + k, words) for k in range(n)) for n, words in kinds]
    for g, p in enumerate(shared):
        texts += [f"{prose(1000 * g + 10 + k, 9)}\n{p}\n{prose(1000 * g + 30 + k, 8)}" for k in range(12)]
    got = {r.doc_id: r for r in run(spark, texts)}
    for g, (n, _) in enumerate(kinds):
        assert got[12 * g].text == texts[12 * g]
        assert all(got[k].text == texts[k].replace(shared[g] + "\n", "") and got[k].lines_removed == n for k in range(12 * g + 1, 12 * g + 12))


def test_every_planted_passage_goes(spark):
    """50 words are enough, wherever they lie and whatever is around them."""
    r = random.Random(11)
    planted = [prose(1000 + k, r.randint(50, 90)) for k in range(40)]
    texts = [" ".join([prose(5 * k, r.randint(0, 70)), planted[k % 40], prose(5 * k + 1, r.randint(0, 70))]) for k in range(160)]
    got = {x.doc_id: x.text for x in run(spark, texts)}
    assert all(got[k] == texts[k] for k in range(40)) and not any(planted[k % 40] in got[k] for k in range(40, 160))
    # a neighbouring word may be alike by chance
    assert all(0 <= len(texts[k].split()) - len(planted[k % 40].split()) - len(got[k].split()) <= 2 for k in range(40, 160))


def test_equals_brute_force(spark):
    for seed in (3, 4):
        r = random.Random(seed)
        pool = [prose(500 + k, r.choice((3, 12, 26, 40, 50, 51, 70))) for k in range(25)]
        texts = ["".join(r.choice(pool) + r.choice((" ", "\n", "\n\n", "  ")) for _ in range(r.randint(1, 12))) for _ in range(80)]
        texts += [None, "", "\n\n", "é", "a " * 500, prose(1, 40) + " ", (prose(2, 40) + "\n") * 6, (prose(2, 7) + "\n") * 30, prose(3, 120), prose(3, 120)]
        got = run(spark, texts)
        assert {x.doc_id: x.text for x in got} == brute(texts)
        assert sum(x.words_removed for x in got) > 1000


def test_rows_that_share_an_id_lose_only_what_repeats(spark):
    own = ["P unique here\nQ unique two", "R unique three\nS unique four", "X same line\nY same line"]
    got = run(spark, [own[2], own[0], own[2], own[1], own[1], None], ids=[5, 7, 7, 7, 7, 7])
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(5, own[2]), (7, own[0]), (7, ""), (7, own[1]), (7, own[1]), (7, "")])
    null = run(spark, [own[2], own[2]], ids=[None, 3])
    assert sorted(r.text for r in null) == [own[2]] * 2


def test_clashing_names_and_long_texts(spark):
    p = prose(9, 60)
    texts = [prose(1, 20) + " " + p, " ".join(prose(k, 2000) for k in range(80)) + " " + p + " " + prose(2, 9)]
    assert len(texts[1]) > 700_000
    df = docs(spark, *texts).withColumns({c: F.lit("mine") for c in ("_gone", "_removed", "i", "h", "g", "s", "gone", "words_removed", "at")})
    out = chunks.dedup_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and got[1].text == texts[1].replace(" " + p, "") and got[1].n_chars == len(got[1].text)
    assert all(got[1][c] == "mine" for c in ("_gone", "_removed", "i", "h", "g", "s", "gone", "words_removed", "at"))
    assert chunks.dedup_lines(docs(spark)).count() == 0


def test_without_keeps_lines():
    t = "x a b\nc d\ne f\n"
    assert [chunks.without(t, [g])[0] for g in ((1, 2), (3, 2), (1, 4), (5, 2), (0, 7), (0, 1))] == ["x\nc d\ne f\n", "x a b\ne f\n", "x\ne f\n", "x a b\nc d\n", "", "a b\nc d\ne f\n"]
