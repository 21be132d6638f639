"""Quality rules by an isolation forest on rule statistics.

Every document is described by the statistics that quality rules look at: word
lengths, symbols, capitals, digits, repeated words, phrases and lines, line ends.
An isolation forest (Liu, Ting and Zhou, 2008) splits a sample of documents at
random values of random statistics; a document that is anomalous is alone after
few splits, so that its mean path length is short. The score is

    2 ** (-mean path length / expected path length of a sample),

near 1 for anomalies. Trees are grown on a bounded sample of documents labelled
good, FIT_ROWS of them, those with the smallest hashes, and the limits of the
score are calibrated over all labelled documents. A few documents labelled bad,
BAD_SHARE of the good ones at most, are in the sample, so that statistics which
all good ones agree in can be split at all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, cut, map_batches, table
from .textvec import U64, Chars, chunks, shingles, tables

STATISTICS = ("word_length", "long_words", "symbols", "capitals", "digits", "repeated_words", "repeated_phrases", "repeated_lines", "closed_lines", "distinct_words", "top_word")
#: At most so many labelled documents grow the trees.
FIT_ROWS = 20_000
BAD_SHARE = 0.05
TREES, SAMPLE = 128, 1024
#: A text is rated as if it went on with so many usual words.
PRIOR_WORDS = 40
#: Scores are counted in so many bins for the limit.
BINS = 2000


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _firsts(group: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (group, item): the group of each distinct one, and how often it occurs."""
    order = np.lexsort((item, group))
    g, x = group[order], item[order]
    new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))) if len(g) else np.zeros(0, dtype=np.int64)
    return g[new], np.diff(np.append(new, len(g)))


def statistics(texts: list[str]) -> np.ndarray:
    """A row for each text: a column for each of STATISTICS, then the number of words; NaN where a text has no word."""
    out = [np.zeros((0, len(STATISTICS) + 1))]
    for i, j in chunks(texts):
        chars, n = Chars(texts[i:j]), j - i
        prefix = chars.prefix()
        size = np.diff(chars.starts) - 1
        t, points = tables(), chars.points
        where = np.repeat(np.arange(n), np.diff(chars.starts))
        per = lambda flags: np.bincount(where[flags], minlength=n)
        word, blank = t["word"][points], t["space"][points] | (points < 32)
        letters, capitals, digits = per(t["alpha"][points]), per(t["upper"][points]), per(t["digit"][points])
        symbols = per(~word & ~blank & (points != ord(".")) & (points != ord(",")))
        doc, begin, end, words = chars.words()
        count = np.bincount(doc, minlength=n)
        length = end - begin
        again = (doc[1:] == doc[:-1]) & (words[1:] == words[:-1])
        phrase_doc, phrases = shingles(doc, words, 5)
        group, often = _firsts(phrase_doc, phrases)
        repeated = np.bincount(group, weights=often - 1, minlength=n)
        distinct, times = _firsts(doc, words)
        top = np.zeros(n)
        np.maximum.at(top, distinct, times)
        # lines, without the empty ones
        stop = np.flatnonzero(points == 10)
        start = np.concatenate(([0], stop[:-1] + 1))
        full = stop > start
        start, stop = start[full], stop[full]
        line_doc = where[start]
        lines = np.bincount(line_doc, minlength=n)
        group, often = _firsts(line_doc, chars.span_hashes(start, stop, prefix))
        same = np.bincount(group, weights=often - 1, minlength=n)
        closed = np.bincount(line_doc[np.isin(points[stop - 1], [ord(c) for c in ".!?:;\"'…。"])], minlength=n)
        rows = np.column_stack((
            _share(np.bincount(doc, weights=length, minlength=n), count), _share(np.bincount(doc[length > 6], minlength=n), count),
            _share(symbols, size), _share(capitals, letters), _share(digits, size), _share(np.bincount(doc[1:][again], minlength=n), count),
            _share(repeated, np.bincount(phrase_doc, minlength=n)), _share(same, lines), _share(closed, lines),
            np.log1p(np.bincount(distinct, minlength=n)) / np.maximum(np.log1p(count), 0.1), _share(top, count), count,
        ))
        rows[count == 0] = np.nan
        out.append(rows)
    return np.concatenate(out)


def steadied(rows: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The statistics as if every text went on with PRIOR_WORDS usual words, so that a short text isn't anomalous for its few words."""
    n = rows[:, -1:]
    return usual + (rows[:, :-1] - usual) * (n / (n + PRIOR_WORDS))


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees in flat arrays: statistic (-1 at a leaf), split value, left child (the right one follows), path length at the leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 1):
        draw = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        self.limit, self.normal = int(np.ceil(np.log2(max(sample, 2)))), float(expected_path(np.array(max(sample, 2))))
        self.trees = [self._grow(rows[draw.choice(len(rows), sample, replace=False)], draw) for _ in range(trees)] if sample else []

    def _grow(self, rows: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        what, value, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.limit or not len(open_):
                path[node] = depth + float(expected_path(np.array(len(own))))
                continue
            k = int(draw.choice(open_))
            split = draw.uniform(low[k], high[k])
            what[node], value[node], child[node] = k, split, len(what)
            left = own[:, k] < split
            todo += [(len(what), own[left], depth + 1), (len(what) + 1, own[~left], depth + 1)] if left.any() and not left.all() else []
            if not left.any() or left.all():  # the drawn value met the bound: try again
                what[node] = -1
                todo.append((node, own, depth))
                continue
            for to, x in ((what, -1), (value, 0.0), (child, 0), (path, 0.0)):
                to += [x, x]
        return np.array(what), np.array(value), np.array(child), np.array(path)

    def path_lengths(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for what, value, child, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.limit):
                k = what[at]
                inner = k >= 0
                if not inner.any():
                    break
                at = np.where(inner, child[at] + (rows[np.arange(len(rows)), k] >= value[at]), at)
            total += path[at]
        return total / max(len(self.trees), 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 2 ** (-self.path_lengths(rows) / self.normal)


def labelled(labels: DataFrame) -> DataFrame:
    """(id, good) of the labelled documents; one that any row calls bad is bad."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("good"))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, s) of every row with a word: its statistics and number of words."""

    def make():
        def f(ids: list, texts: list) -> dict | None:
            rows = statistics(texts)
            some = ~np.isnan(rows[:, 0])
            return {"doc_id": [i for i, x in zip(ids, some) if x], "s": list(rows[some].astype(np.float32))} if some.any() else None

        return f

    return map_batches(docs.where("text is not null"), [F.col("doc_id").cast("long"), "text"], "doc_id long, s array<float>", make)


def grow(found: DataFrame, marks: DataFrame, fit_rows: int = FIT_ROWS, bad_share: float = BAD_SHARE, seed: int = 1) -> tuple[np.ndarray, IsolationForest] | None:
    """Usual statistics and the forest of a bounded sample; None where there is no good document."""

    def sample(good: int, n: int) -> np.ndarray:
        own = found.join(marks.where(F.col("good") == good), F.col("doc_id") == F.col("id")).select("id", "s")
        rows = bounded(own, ["id", "s"], n, seed).select("s").toArrow().column("s").combine_chunks()
        return rows.flatten().to_numpy().astype(float).reshape(len(rows), len(STATISTICS) + 1)

    good = sample(1, fit_rows)
    if not len(good):
        return None
    usual = np.median(good[:, :-1], axis=0)
    return usual, IsolationForest(steadied(np.concatenate((good, sample(0, int(bad_share * len(good))))), usual), seed=seed)


def scores(found: DataFrame, usual: np.ndarray, forest: IsolationForest) -> DataFrame:
    """(doc_id, score) of the described documents."""
    shared = found.sparkSession.sparkContext.broadcast((usual, forest))

    def make():
        usual, forest = shared.value

        def f(ids: list, rows: list) -> dict:
            return {"doc_id": ids, "score": forest.score(steadied(np.array(rows, dtype=float), usual))}

        return f

    return map_batches(found, ["doc_id", "s"], "doc_id long, score double", make)


def limit(scored: DataFrame, marks: DataFrame) -> float:
    """The score from which on documents are anomalous: it gives the best F1 for the bad ones over all labelled documents.

    Scores are counted in bins of 1 / BINS; the limit lies in the middle of the
    gap to the next lower one that is taken, with best F1 only above it. Without bad ones it lies above all good ones.
    """
    bins = F.floor(F.col("score") * BINS).cast("long")
    rows = scored.join(marks, F.col("doc_id") == F.col("id")).groupBy(bins.alias("bin")).agg(F.sum(1 - F.col("good")).alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: -r["bin"])
    every = sum(r["bad"] for r in rows)
    best, least, bad, n = 0.0, ((rows[0]["bin"] if rows else BINS) + 1) / BINS, 0, 0
    for r, below in zip(rows, [*rows[1:], None]):
        bad, n = bad + r["bad"], n + r["n"]
        if every and 2 * bad / (every + n) > best:
            best, least = 2 * bad / (every + n), (r["bin"] + below["bin"] + 1) / 2 / BINS if below else r["bin"] / BINS
    return least


def keep(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 1) -> DataFrame:
    """(doc_id, score) of the documents that aren't anomalous.

    Null and empty texts, and texts without a word, are not kept; a null doc_id is
    carried along (it can't be labelled); repeated rows are scored one by one, and
    equal texts get equal scores; an empty table gives no row. Labels that are
    null, or of documents that aren't there, are ignored; without a good document
    no forest grows and everything that has a word is kept, with a null score.
    A very long text is described as a whole; a score at the limit is anomalous.
    Columns other than doc_id and text are not read.
    """
    marks = labelled(labels)
    found = cut(described(docs))
    grown = grow(found, marks, fit_rows, seed=seed)
    if grown is None:
        return found.select("doc_id", F.lit(None).cast("double").alias("score"))
    scored = cut(scores(found, *grown))
    return scored.where(F.col("score") < limit(scored, marks))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
