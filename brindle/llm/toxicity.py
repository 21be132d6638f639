"""Toxicity by a factorization machine over hashed terms.

A term is a word or the first PREFIX characters of a longer word, in lower case,
hashed to BUCKETS buckets; its value is the logarithm of its count. The machine
scores a document by

    b + sum of w[i] x[i] + sum over pairs i < j of <v[i], v[j]> x[i] x[j],

so that a pair of terms, such as an insult and the mention of a group, can weigh
more (or less) than the two do each by itself.

It is fitted by AdaGrad on a bounded sample of labelled documents: FIT_ROWS of
them, those with the smallest hashes. The threshold is chosen over all labelled
documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, cut, map_batches, table
from .textvec import U64, Chars, chunks, counted

PREFIX = 5
BUCKET_BITS = 22
#: At most so many labelled documents fit the machine.
FIT_ROWS = 8_000
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 3e-4
#: Terms in fewer documents of the sample, or with less evidence for either class by themselves and in pairs, have no weights.
MIN_DOCS, MIN_Z, MIN_PAIR_Z = 3, 3.0, 10.0
#: Evidence in pairs is looked for among so many terms, those that are in nearly as many documents as they are not in.
PAIR_TERMS = 1024
#: At the threshold, at least this share of the labelled documents above it is toxic.
PRECISION = 0.97
#: Scores are counted in so many bins for the threshold.
BINS = 2000


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of some texts, ordered by document and bucket."""
    chars = Chars(texts)
    doc, begin, end, words = chars.words()
    long = end - begin > PREFIX
    heads = chars.span_hashes(begin[long], begin[long] + PREFIX) ^ U64(0x5BD1E9955BD1E995)
    doc, item, count = counted(np.concatenate((doc, doc[long])), np.concatenate((words, heads)), BUCKET_BITS)
    return doc, item.astype(np.int64), count


class FactorizationMachine:
    """Weights of the known buckets (sorted), with the bias."""

    def __init__(self, buckets: np.ndarray, factors: int = FACTORS, seed: int = 1):
        self.buckets = buckets
        self.bias = 0.0
        self.w = np.zeros(len(buckets))
        self.v = np.random.default_rng(seed).normal(0, 0.02, (len(buckets), factors))

    def known(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the terms that have weights."""
        if not len(self.buckets):
            return row[:0], row[:0], np.zeros(0)
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        there = self.buckets[at] == bucket
        return row[there], at[there], np.log1p(count[there])

    def raw(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score of each of n rows, and its sums of factors."""
        sums = np.column_stack([np.bincount(row, weights=self.v[col, f] * x, minlength=n) for f in range(self.v.shape[1])])
        squares = np.bincount(row, weights=(self.v[col] ** 2).sum(axis=1) * x * x, minlength=n)
        return self.bias + np.bincount(row, weights=self.w[col] * x, minlength=n) + ((sums**2).sum(axis=1) - squares) / 2, sums

    def fit(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> None:
        """AdaGrad on the logistic loss, both classes weighing the same in all; rows ascend."""
        n, draw = len(label), np.random.default_rng(seed)
        share = max(label.mean(), 1 / n), max(1 - label.mean(), 1 / n)
        importance = np.where(label == 1, 0.5 / share[0], 0.5 / share[1])
        starts = np.searchsorted(row, np.arange(n + 1))
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = draw.permutation(n)
            for k in range(0, n, BATCH):
                own = order[k : k + BATCH]
                size = starts[own + 1] - starts[own]
                at = np.repeat(starts[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                r, c, value = np.repeat(np.arange(len(own)), size), col[at], x[at]
                score, sums = self.raw(r, c, value, len(own))
                g = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - label[own]) * importance[own] / len(own)
                used, of = np.unique(c, return_inverse=True)
                dw = np.bincount(of, weights=g[r] * value, minlength=len(used)) + DECAY * self.w[used]
                each = (g[r] * value)[:, None] * (sums[r] - self.v[c] * value[:, None])
                dv = np.column_stack([np.bincount(of, weights=each[:, f], minlength=len(used)) for f in range(each.shape[1])]) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += g.sum() ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used]) / 4
                self.bias -= RATE * g.sum() / np.sqrt(gb)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability-like score of each text; NaN for a null text or one without a word."""
        out = [np.zeros(0)]
        filled = [t or "" for t in texts]
        for i, j in chunks(filled):
            doc, bucket, count = terms(filled[i:j])
            value = 1 / (1 + np.exp(-np.clip(self.raw(*self.known(doc, bucket, count), j - i)[0], -40, 40)))
            value[np.bincount(doc, minlength=j - i) == 0] = np.nan
            out.append(value)
        return np.concatenate(out)


def paired(row: np.ndarray, col: np.ndarray, label: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The terms whose covariance with another term differs between the classes, whatever the evidence of either alone."""
    n = len(label)
    common = np.argsort(-np.minimum(seen, n - seen), kind="stable")[:PAIR_TERMS]
    common = common[(seen[common] >= MIN_DOCS) & (seen[common] < n)]
    if not len(common) or not 0 < label.sum() < n:
        return common[:0]
    place = np.full(len(seen), -1)
    place[common] = np.arange(len(common))
    difference = np.zeros((len(common), len(common)))
    for value, sign in ((1, 1), (0, -1)):
        own = label == value
        number = np.cumsum(own) - 1
        use = own[row] & (place[col] >= 0)
        held = np.zeros((int(own.sum()), len(common)), dtype=np.float32)
        held[number[row[use]], place[col[use]]] = 1
        held -= held.mean(axis=0)
        difference += sign * (held.T @ held) / len(held)
    spread = seen[common] / n * (1 - seen[common] / n)
    z = np.abs(difference) / np.sqrt(np.outer(spread, spread) * (1 / label.sum() + 1 / (n - label.sum())))
    np.fill_diagonal(z, 0)
    return common[z.max(axis=0) >= MIN_PAIR_Z]


def fitted(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, label: np.ndarray, seed: int = 1) -> FactorizationMachine:
    """A machine over the terms that tell the classes apart, by the z score of their shares of documents or of how they go together with another term."""
    names, col = np.unique(bucket, return_inverse=True)
    n1, n0 = max(int(label.sum()), 1), max(int(len(label) - label.sum()), 1)
    seen1 = np.bincount(col, weights=label[row], minlength=len(names))
    seen = np.bincount(col, minlength=len(names))
    p = seen / (n0 + n1)
    z = (seen1 / n1 - (seen - seen1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    telling = np.abs(z) >= MIN_Z
    telling[paired(row, col, label, seen)] = True
    machine = FactorizationMachine(names[(seen >= MIN_DOCS) & telling], seed=seed)
    if 0 < label.sum() < len(label):
        machine.fit(*machine.known(row, bucket, count), label, seed=seed)
    return machine


def labelled(labels: DataFrame) -> DataFrame:
    """(id, label) of the labelled documents; one that any row calls toxic is toxic."""
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))


def train(docs: DataFrame, marks: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 1) -> FactorizationMachine:
    """The machine of a bounded sample; only its terms reach the driver."""
    sample = bounded(marks, ["id"], fit_rows, seed)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id").dropDuplicates(["id", "text"])

    def make():
        def f(label: list, texts: list) -> dict:
            buckets, counts = [], []
            for i, j in chunks(texts):
                doc, bucket, count = terms(texts[i:j])
                cuts = np.searchsorted(doc, np.arange(1, j - i))
                buckets += [x.astype(np.int32) for x in np.split(bucket, cuts)]
                counts += [x.astype(np.int32) for x in np.split(count, cuts)]
            return {"label": label, "bucket": buckets, "count": counts}

        return f

    found = map_batches(rows, ["label", "text"], "label int, bucket array<int>, count array<int>", make).toArrow().combine_chunks()
    if not found.num_rows:
        return FactorizationMachine(np.zeros(0, dtype=np.int64))
    lists = found.column("bucket").combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return fitted(row, lists.flatten().to_numpy().astype(np.int64), found.column("count").combine_chunks().flatten().to_numpy(), found.column("label").to_numpy().astype(float), seed)


def scores(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every row with a word."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        machine = shared.value

        def f(ids: list, texts: list) -> dict | None:
            value = machine.score(texts)
            some = ~np.isnan(value)
            return {"doc_id": [i for i, x in zip(ids, some) if x], "score": value[some]} if some.any() else None

        return f

    return map_batches(docs.where("text is not null"), [F.col("doc_id").cast("long"), "text"], "doc_id long, score double", make)


def threshold(scored: DataFrame, marks: DataFrame, precision: float = PRECISION) -> float | None:
    """The score, in the middle between two bins of 1 / BINS that are taken, with the best F1 over all labelled documents among those from which on at least `precision` of them are toxic; None where there is none."""
    bins = F.floor(F.col("score") * BINS).cast("long")
    rows = scored.join(marks, F.col("doc_id") == F.col("id")).groupBy(bins.alias("bin")).agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: -r["bin"])
    every = sum(r["toxic"] for r in rows)
    best, least, toxic, n = 0.0, None, 0, 0
    for r, below in zip(rows, [*rows[1:], None]):
        toxic, n = toxic + r["toxic"], n + r["n"]
        if toxic >= precision * n and 2 * toxic / (every + n) > best:
            best, least = 2 * toxic / (every + n), (r["bin"] + below["bin"] + 1) / 2 / BINS if below else r["bin"] / BINS
    return least


def toxic(docs: DataFrame, labels: DataFrame, precision: float = PRECISION, fit_rows: int = FIT_ROWS, seed: int = 1) -> DataFrame:
    """(doc_id, score) of the documents found toxic.

    Null and empty texts, and texts without a word, never are; a null doc_id is
    carried along (it can't be labelled); repeated rows are scored one by one, and
    equal texts get equal scores, so that ties fall on one side; a very long text
    is scored by all its words; an empty table gives no row. Labels that are
    null, or of documents that aren't there, are ignored; without labels of both
    classes nothing is found. Columns other than doc_id and text are not read.
    """
    marks = labelled(labels)
    scored = cut(scores(docs, train(docs, marks, fit_rows, seed)))
    least = threshold(scored, marks, precision)
    return scored.where(F.lit(False) if least is None else F.col("score") >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
