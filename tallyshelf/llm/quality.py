"""Quality filtering by hierarchical empirical Bayes.

A document's own evidence is a log-likelihood ratio per label from hashed words
and shape features, fitted on labelled documents.  Its site adds a prior: label
rates of hosts are shrunk toward the corpus rate and rates of paths toward their
host's.  Each level has its own strength, the variance of scores within its groups
over the variance between the groups' true rates (both by analysis of variance),
so sites with few documents inherit their parents' rate.  A document's prior comes
from the other documents of its path, host and corpus: its own evidence counts
once.  All counts and rates cover all documents and come from grouped aggregation
of exact decimals, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices, unused
from tallyshelf.llm.texthash import word_hashes
from tallyshelf.scratch import broadcast_if_small, stage

#: Most labelled rows that the classifier is fitted on (chosen by hash of doc_id).
TRAIN_ROWS = 20_000
BUCKETS, BINS = 1 << 18, 16
SHAPES = 6
#: Passes over the sample and step size.
EPOCHS, RATE = 6, 0.1
TARGETS = ("low_quality", "toxic")
#: Strength where groups do not differ beyond chance: they all get the parent's rate.
MOST_STRENGTH = 1e9
#: And at least, so that a site of one document never divides by nothing.
LEAST_STRENGTH = 0.01
_WIDTH = BUCKETS + SHAPES * BINS


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text (null or without words: none)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = word_hashes(data.lower())
    if not len(words):
        return np.empty(0, np.int64)
    a = np.frombuffer(data, np.uint8)
    upper = ((a >= 65) & (a <= 90)).mean()
    symbol = np.isin(a, np.frombuffer(b"!#$%&*@|<>{}[]~^=_\\", np.uint8)).mean()
    digit = ((a >= 48) & (a <= 57)).mean()
    own = np.unique(words)
    shares = (upper, symbol * 4, digit * 4, len(own) / len(words), min(len(data) / len(words) / 16, 1), min(np.log2(len(words)) / 16, 1))
    bins = [BUCKETS + k * BINS + min(int(x * BINS), BINS - 1) for k, x in enumerate(shares)]
    return np.concatenate([np.unique((own >> np.uint64(46)).astype(np.int64)), np.array(bins)])


@dataclass
class Model:
    """Per target: feature weights, and the slope and offset that turn their sum
    into a log-likelihood ratio; base is the share of labelled rows."""

    weights: np.ndarray
    slope: list[float]
    offset: list[float]
    base: list[float]

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(TARGETS)))
        for k, text in enumerate(texts):
            if len(f := features(text)):
                out[k] = self.slope * self.weights[:, f].sum(axis=1) + self.offset
        return np.clip(out, -30, 30)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [features(t).astype(np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", *TARGETS)), pa.array(found, pa.list_(pa.int32()))], names=["h", *TARGETS, "f"])


def _train(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights per target of a logistic regression, by passes of adaptive
    gradient steps, averaged over all passes but the first."""
    w, g2, total = (np.zeros((y.shape[1], _WIDTH)) for _ in range(3))
    bias = np.log((y.mean(axis=0) + 1e-3) / (1 - y.mean(axis=0) + 1e-3))
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            f = rows[k]
            if len(f):
                g = 1 / (1 + np.exp(-np.clip(w[:, f].sum(axis=1) + bias, -30, 30))) - y[k]
                g2[:, f] += (g * g)[:, None]
                w[:, f] -= RATE * g[:, None] / np.sqrt(g2[:, f] + 1e-3)
                bias -= 0.01 * g
        if epoch:
            total += w
    return total / max(EPOCHS - 1, 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps on the standardised score."""
    mid, scale = x.mean(), x.std() or 1.0
    z = np.stack([(x - mid) / scale, np.ones_like(x)], axis=1)
    w = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + 1e-3 * (w * w).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 2e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - 2e-3 * w)
        while loss(w + step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mid / scale)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``rows`` labelled documents: the weights on one half,
    their calibration on the other.  Rows with null labels are left out; where a
    class is missing its weights are 0.  A doc_id that repeats is one document, the
    first of its texts."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.min("quality") == 0).cast("long").alias("low_quality"), (F.max("toxic") == 1).cast("long").alias("toxic"))
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)))
    n = known.count()
    known = stage(known.filter(F.col("h") < 1_000_000 * min(1.0, rows / max(n, 1))), "quality-labels")
    sample = docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id").groupBy("doc_id", "h", *TARGETS).agg(F.min("text").alias("text"))
    rows_ = sample.select("h", "text", *TARGETS).mapInArrow(_features, "h long, low_quality long, toxic long, f array<int>").toArrow()  # at most about `rows`
    order = np.lexsort([rows_.column(c).to_numpy() for c in ("toxic", "low_quality", "h")])
    y = np.stack([rows_.column(c).to_numpy()[order] for c in TARGETS], axis=1).astype(float)
    lists = rows_.column("f").combine_chunks()
    cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    found = [flat[cuts[k] : cuts[k + 1]] for k in order]
    first = rows_.column("h").to_numpy()[order] % 2 == 0
    base = [(float(y[:, k].sum()) + 0.5) / (len(y) + 1) for k in range(len(TARGETS))]
    raw = Model(np.zeros((len(TARGETS), _WIDTH)), [1.0] * len(TARGETS), [0.0] * len(TARGETS), base)
    if first.any():
        raw.weights = _train([f for f, a in zip(found, first, strict=True) if a], y[first])
    held = np.array([raw.weights[:, f].sum(axis=1) for f, a in zip(found, first, strict=True) if not a]).reshape(-1, len(TARGETS))
    for k in range(len(TARGETS)):
        own = y[~first, k]
        if 0 < own.sum() < len(own):
            slope, at = _logistic(held[:, k], own)
            raw.slope[k], raw.offset[k] = slope, at - float(np.log(own.mean() / (1 - own.mean())))
    return raw


def with_evidence(docs: DataFrame, model: Model, names: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` less the columns ``drop`` and with a log-likelihood ratio per target,
    as columns ``names``."""
    kept, kinds = [c for c in docs.columns if c not in drop], {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            e = model.evidence(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(e[:, 0]), pa.array(e[:, 1])], names=[*kept, *names])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{c}` double" for c in names)]))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _score(evidence: Column, base: float) -> Column:
    """The chance of a label by its evidence and the labelled rows' share."""
    return _sigmoid(evidence + float(np.log(base / (1 - base))))


def strength(n: float, groups: float, squares: float, within: float, between: float, unequal: float) -> float:
    """Documents that a parent's rate is worth: variance within groups over the
    variance between them.  ``within`` is the sum of squared deviations from group
    means, ``between`` that of these means from the parents', a document each,
    ``squares`` and ``unequal`` the degrees of freedom and effective size.  Where each
    group is one document the variance within is unknown, and a group says nothing
    beyond its parent."""
    if n - groups < 1:
        return MOST_STRENGTH
    inside = within / (n - groups)
    beyond = (between - squares * inside) / max(unequal, 1e-9)
    return min(max(inside / beyond, LEAST_STRENGTH), MOST_STRENGTH) if beyond > 0 else MOST_STRENGTH


@dataclass
class Sites:
    """Per (host, path): n and s0, s1, documents and score sums of the path; hn and
    h0, h1, those of its host.  And the corpus sums and strengths per target."""

    table: DataFrame
    n: float
    sums: list[float]
    host_strength: list[float]
    path_strength: list[float]

    def prior(self, k: int, score: Column, n: Column, s: Column, hn: Column, h: Column) -> Column:
        """The rate that the other documents give one with that score."""
        corpus = (self.sums[k] - score) / (self.n - 1) if self.n > 1 else F.lit(0.5)
        host = (h - score + self.host_strength[k] * corpus) / (hn - 1 + self.host_strength[k])
        return (s - score + self.path_strength[k] * host) / (n - 1 + self.path_strength[k])


def site_rates(scored: DataFrame, model: Model) -> Sites:
    """Sites from ``scored``: host, path and the evidence columns e0 and e1."""
    exact = lambda c: c.cast("decimal(20,12)")
    soft = {f"p{k}": _score(F.col(f"e{k}"), b) for k, b in enumerate(model.base)}
    sums = [F.sum(exact(F.col(f"p{k}"))).cast("double").alias(f"s{k}") for k in (0, 1)]
    square = [F.sum(exact(F.col(f"p{k}") * F.col(f"p{k}"))).cast("double").alias(f"q{k}") for k in (0, 1)]
    paths = stage(scored.select("host", "path", *(c.alias(n) for n, c in soft.items())).groupBy("host", "path").agg(F.count("*").alias("n"), *sums, *square), "quality-paths")
    total = lambda c: F.sum(exact(F.col(c))).cast("double")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *(total(f"s{k}").alias(f"h{k}") for k in (0, 1)))
    hosts = stage(hosts, "quality-hosts").withColumnRenamed("host", "of")
    table = paths.join(broadcast_if_small(hosts), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    table = stage(table, "quality-sites")
    number = lambda c: F.coalesce(F.sum(c.cast("decimal(38,12)")).cast("double"), F.lit(0.0))
    share = [number(F.col("n")).alias("n"), F.count("*").alias("paths"), number(F.col("n") * F.col("n") / F.col("hn")).alias("inner")]
    share += [number(F.col(f"{c}{k}")).alias(f"{c}{k}") for k in (0, 1) for c in "sq"]
    share += [number(F.col(f"s{k}") * F.col(f"s{k}") / F.col("n")).alias(f"m{k}") for k in (0, 1)]
    p = table.agg(*share).first()
    outer = [F.count("*").alias("hosts"), number(F.col("hn") * F.col("hn")).alias("squared")]
    outer += [number(F.col(f"h{k}") * F.col(f"h{k}") / F.col("hn")).alias(f"m{k}") for k in (0, 1)]
    h = hosts.agg(*outer).first()
    n = max(p["n"], 1.0)
    host_strength, path_strength = [], []
    for k in (0, 1):
        corpus = p[f"s{k}"] ** 2 / n
        host_strength.append(strength(n, h["hosts"], h["hosts"] - 1, p[f"q{k}"] - h[f"m{k}"], h[f"m{k}"] - corpus, n - h["squared"] / n))
        path_strength.append(strength(n, p["paths"], p["paths"] - h["hosts"], p[f"q{k}"] - p[f"m{k}"], p[f"m{k}"] - h[f"m{k}"], n - p["inner"]))
    return Sites(table, p["n"], [p["s0"], p["s1"]], host_strength, path_strength)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS, into: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text and the two site columns) with low_quality and toxic,
    posterior probabilities, and kept: both under one half.

    With ``into`` these three are one struct of that name, and all columns of
    ``docs`` stay; without, only doc_id and the three are returned.  Null hosts and
    paths are sites of their own.  Null and empty texts bring no evidence and get
    their site's rate.  Rows that repeat a doc_id are classified each.  The texts
    are read once: evidence is written, with the columns of ``docs`` if these stay.
    """
    model = fit(docs, labels, rows)
    names = docs.columns if into else ["doc_id"]
    base = docs if into else docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text")
    e0, e1, *site = unused(base.columns, "e0", "e1", "host", "path", "n", "s0", "s1", "hn", "h0", "h1")
    scored = stage(with_evidence(base, model, [e0, e1], () if into else ("text",)), "quality-evidence")
    at = (host, path) if into else ("host", "path")
    sites = site_rates(scored.select(F.col(at[0]).alias("host"), F.col(at[1]).alias("path"), F.col(e0).alias("e0"), F.col(e1).alias("e1")), model)
    table = broadcast_if_small(sites.table.select("host", "path", "n", "s0", "s1", "hn", "h0", "h1")).toDF(*site)
    by_host, by_path, n, s0, s1, hn, h0, h1 = site
    out = scored.join(table, F.col(at[0]).eqNullSafe(F.col(by_host)) & F.col(at[1]).eqNullSafe(F.col(by_path)))
    chance = []
    for k, (e, s, h) in enumerate(((e0, s0, h0), (e1, s1, h1))):
        prior = sites.prior(k, _score(F.col(e), model.base[k]), F.col(n), F.col(s), F.col(hn), F.col(h))
        chance.append(_sigmoid(F.col(e) + _logit(prior)))
    result = [chance[0].alias("low_quality"), chance[1].alias("toxic"), ((chance[0] < 0.5) & (chance[1] < 0.5)).alias("kept")]
    return out.select(*(F.col(f"`{c}`") for c in names), *([F.struct(*result).alias(into)] if into else result))


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents, with their source as host and its languages as paths."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
