"""Benchmark decontamination by an FM-index of every training shard.

A shard is a piece of an Arrow batch of documents. Test items are cut into phrases of
PHRASE consecutive words (a shorter item is one phrase); each is looked for in
the shard by backward search and its occurrences are located from the sampled
suffix positions. The words of all occurrences are united to removal spans.

The index holds words, not characters. A word that no phrase contains can't be
part of an occurrence, so it becomes a separator, and a stretch between
separators that is shorter than the shortest phrase is left out. This changes no
result; it makes the index a small fraction of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import bound_batches, map_batches, pieces, replaced, settle, table
from .textvec import Chars, chunks

PHRASE = 8
#: Items of fewer words are no evidence of a leak and are not searched.
SHORTEST = 4
#: A broadcast holds at most so many words and those of one more item, 12 bytes each; a larger benchmark is sent in several, of which a worker has one in memory at a time.
SLICE = 1_000_000


class Phrases:
    """The phrases of some items over their own vocabulary: the words of the items, and where the phrases of each length begin."""

    def __init__(self, items: list[str | None], length: int = PHRASE, shortest: int = SHORTEST):
        texts = [x for x in items if x]
        kept, begins, at = [], {}, 0
        if texts:
            doc, _, _, words = Chars(texts).words()
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if j - i >= shortest:
                    k = min(length, j - i)
                    kept.append(words[i:j])
                    begins.setdefault(k, []).append(np.arange(at, at + j - i - k + 1, dtype=np.int32))
                    at += j - i
        every = np.concatenate(kept) if kept else np.zeros(0, dtype=np.uint64)
        self.vocabulary, places = np.unique(every, return_inverse=True)
        self.words = (places + 2).astype(np.int32)
        self.begins = {k: np.concatenate(v) for k, v in begins.items()}
        self.shortest = min(begins, default=0)

    def among(self, symbols: np.ndarray) -> dict[int, np.ndarray]:
        """Distinct phrases by length, a row of symbols each, of those all of whose words are flagged."""
        known = np.concatenate(([0], np.cumsum(symbols[self.words])))
        out = {}
        for k, begin in self.begins.items():
            begin = begin[known[begin + k] - known[begin] == k]
            if len(begin):
                out[k] = np.unique(self.words[begin[:, None] + np.arange(k)], axis=0).astype(np.int64)
        return out


def word_hits(phrases: Phrases, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Flags of the words of a shard that lie in an occurrence of a phrase."""
    hit = np.zeros(len(words) + 1, dtype=np.int32)
    if not len(words) or not len(phrases.vocabulary):
        return hit[:-1].astype(bool)
    at = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1).astype(np.int32)
    known = phrases.vocabulary[at] == words
    start = known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1])))
    run = np.cumsum(start[known], dtype=np.int32) - 1  # of the known words only; each stretch of them begins with one
    keep = known.copy()
    keep[known] = np.bincount(run)[run] >= phrases.shortest
    del run
    where = np.flatnonzero(keep)
    if not len(where):
        return hit[:-1].astype(bool)
    symbols = np.zeros(len(phrases.vocabulary) + 2, dtype=bool)
    symbols[at[where] + 2] = True
    searched = phrases.among(symbols)
    if not searched:
        return hit[:-1].astype(bool)
    breaks = np.flatnonzero(start[where])
    text = np.insert(at[where] + 2, breaks, 1)  # 1 separates stretches
    word = np.insert(where, breaks, -1)
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    for k, patterns in searched.items():
        low, high = index.search(patterns)
        size = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        first = word[index.locate(rows)]
        np.add.at(hit, first, 1)
        np.add.at(hit, first + k, -1)
    return np.cumsum(hit[:-1]) > 0


def spans(sent: list, texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """Of every text, the ascending disjoint [start, end) character ranges to remove; sent are the broadcasts of the phrases."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    filled = [t or "" for t in texts]
    for i, j in chunks(filled):
        chars = Chars(filled[i:j])
        doc, begin, end, h = chars.words()
        origin = chars.starts[doc]
        # 20 bytes a word; positions are those in a text, which is shorter than 2**31
        for to, x in zip(parts, ((doc + i).astype(np.int32), (begin - origin).astype(np.int32), (end - origin).astype(np.int32), h)):
            to.append(x)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not parts[0]:
        return out
    doc, begin, end, words = (np.concatenate(parts.pop(0)) for _ in range(4))  # popped, so that no column is held twice for longer than it takes
    hit = np.zeros(len(words), dtype=bool)
    for shared in sent:
        hit |= word_hits(shared.value, doc, words)
        if len(sent) > 1:
            shared.__dict__.pop("_value", None)  # it is read again from the local file
    at = np.flatnonzero(hit)
    if len(at):
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
        last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
        for f, e in zip(at[new], last):
            out[doc[f]].append((int(begin[f]), int(end[e])))
    return out


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in cuts:
        parts.append(text[at:start])
        at = end
    return "".join((*parts, text[at:]))


def send(benchmark: DataFrame, length: int, shortest: int) -> list:
    """Broadcasts of the benchmark's phrases, each of a bounded size."""
    sc = benchmark.sparkSession.sparkContext
    out, items, words = [], [], 0
    for row in benchmark.select("text").where("text is not null").toLocalIterator():
        items.append(row[0])
        words += row[0].count(" ") + 1
        if words >= SLICE:
            out.append(sc.broadcast(Phrases(items, length, shortest)))
            items, words = [], 0
    if items:
        out.append(sc.broadcast(Phrases(items, length, shortest)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, length: int = PHRASE, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, spans, clean_text) of every document that holds a phrase of the benchmark.

    Null and empty texts hold none; a null doc_id is carried along; repeated rows
    are searched one by one; an empty benchmark or table gives no row. Words
    compare in lower case, and what lies between them doesn't count. Phrases that
    overlap make one span. A very long text is a shard of its own. Columns other
    than doc_id and text are not read.
    """
    sent = send(benchmark, length, shortest)

    def make():
        def f(ids: list, texts: list) -> dict | None:
            found = [(i, t, s) for i, t, s in zip(ids, texts, spans(sent, texts)) if s]
            if not found:
                return None
            return {"doc_id": [i for i, _, _ in found], "spans": [[{"start": a, "end": b} for a, b in s] for _, _, s in found], "clean_text": [without(t, s) for _, t, s in found]}

        return f

    return map_batches(docs.where("text is not null"), [F.col("doc_id").cast("long"), "text"], "doc_id long, spans array<struct<start:int,end:int>>, clean_text string", make)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, length: int = PHRASE, shortest: int = SHORTEST) -> DataFrame:
    """docs with the leaked spans cut out of the text, in the same columns; a document without a word left goes, n_chars follows the text.

    Documents without a leak, and rows with null or empty text or null doc_id, are
    treated as in `leaks`; those without a leak stay as they are, repeated rows
    too. Columns of docs may have any names but "__brindle_clean".
    """
    bound_batches(docs.sparkSession)
    sent = send(benchmark, length, shortest)

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str | None] = []
            for shard in pieces(batch):
                texts = shard.to_pylist()
                out += [without(t, s) if s else None for t, s in zip(texts, spans(sent, texts))]
            yield pa.array(out, type=pa.string())
        settle()

    # as if not deterministic, so that the filter isn't moved below it and the search made twice
    marked = docs.withColumn("__brindle_clean", cleaned.asNondeterministic()("text"))
    left = marked.where("__brindle_clean is null or __brindle_clean rlike '[\\\\p{L}\\\\p{N}]'")
    new = F.coalesce("__brindle_clean", "text")
    columns = {"text": new} | ({"n_chars": F.when(F.col("__brindle_clean").isNull(), F.col("n_chars")).otherwise(F.length("__brindle_clean").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return replaced(left, columns).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
