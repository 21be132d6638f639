"""Fuzzy line deduplication by MinHash.

A line is the set of its SHINGLE-character substrings, in lower case and without
the white space around it; a shorter line is one shingle. Lines whose sets have a
Jaccard similarity of THRESHOLD or more, directly or through other lines, form a
component, of which the earliest line (by doc_id, then line number) stays. Lines
are told apart by 128 bits of a hash of their text.

Signatures are one-permutation MinHashes: PASSES hash functions spread the
shingles over BINS bins each and every bin keeps its minimum; an empty bin borrows
from another one of its pass, chosen by hash. With 14 bands of 5 values a pair of
similarity 0.75 becomes a candidate with probability 0.977, one of 0.8 with 0.996.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, members, open_pairs
from .shared import bitmap, bound_batches, cut, long_lists, map_batches, maybe_in, parted, release, replaced, settle, table
from .textvec import U64, Chars, chunks, counted, mix, powers, signed

SHINGLE = 7
THRESHOLD = 0.75
PASSES, BINS = 3, 24
BANDS, ROWS = 14, 5
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: Characters that are hashed at once; the arrays of so many stay in a core's cache.
CHUNK = 40_000
#: A bucket with so many lines of one batch is split: these lines get a bucket of their own beside their smallest one's.
HOT = 16
#: A task forgets the lines it has met beyond so many; repeats are then sent again, which changes no result.
MET = 1_000_000
#: The bits of a bucket's key that number its parts.
PART = (1 << 16) - 1
#: The upper bits of a bucket's key name a range of keys; a task sorts the buckets of one such range at a time.
RANGE_BITS = 12
#: A task sends its pairs in batches of about so many.
SENT = 50_000
#: The shingles of a line fall into so many bins where a cheap bound on a similarity is wanted.
BOUND_BINS = 1024
_WORD = re.compile(r"[^\W_]")


def char_shingles(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every substring of `size` characters; a shorter line gives one."""
    chars = Chars(lines)
    first, last = chars.starts[:-1], chars.starts[1:] - 1
    prefix, total = chars.prefix(), len(chars.points)
    _, down = powers(total + 1)
    out = np.zeros(total, dtype=U64)
    if total >= size:
        out[: total - size + 1] = mix((prefix[size:] - prefix[:-size]) * down[: total - size + 1])
    # a window that reaches beyond its line isn't one
    whole = np.ones(total, dtype=bool)
    for k in range(size):
        whole[np.maximum(last - k, first)] = False
    long = last - first >= size
    whole[first[long]] = True
    short = (last > first) & ~long
    out[first[short]] = chars.span_hashes(first[short], last[short], prefix)
    whole[first[short]] = True
    n = np.where(long, last - first - size + 1, short)
    return np.repeat(np.arange(len(lines)), n), out[whole]


def minima(line: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of the PASSES x BINS bins of n lines; an empty bin has the largest value."""
    own = np.full((PASSES, n * BINS), _EMPTY)
    at = line * BINS
    for p in range(PASSES):
        value = item * _ODD[p]
        value ^= value >> U64(29)
        slot = value >> U64(32)
        slot *= U64(BINS)
        slot >>= U64(32)
        slot = slot.view(np.int64)
        slot += at
        np.minimum.at(own[p], slot, value)
    return np.ascontiguousarray(own.reshape(PASSES, n, BINS).transpose(1, 0, 2))


def filled(own: np.ndarray) -> np.ndarray:
    """Signatures of minima: an empty bin borrows from another one of its pass; a line without shingles keeps the largest value in all."""
    n = len(own)
    rows = own.reshape(n * PASSES, BINS)
    out, free = rows.copy(), rows == _EMPTY
    row, bin_ = np.nonzero(free & ~free.all(axis=1)[:, None])
    k = 0
    while len(row):
        lender = (mix((np.arange(BINS) + 1000 * k + 77 * np.arange(PASSES)[:, None] + 1).astype(U64)) % U64(BINS)).astype(np.int64)
        other = lender[row % PASSES, bin_]
        there = ~free[row, other]
        out[row[there], bin_[there]] = rows[row[there], other[there]]
        row, bin_, k = row[~there], bin_[~there], k + 1
    return out.reshape(n, PASSES * BINS)


def signatures(line: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """PASSES * BINS values for each of n lines."""
    return filled(minima(line, item, n))


def band_keys(values: np.ndarray) -> np.ndarray:
    n = len(values)
    parts = values[:, np.arange(BANDS * ROWS).reshape(ROWS, BANDS)]  # a band takes its values from different passes
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (n, BANDS))
    for r in range(ROWS):
        key = mix(key ^ parts[:, r])
    return key


def split(h: np.ndarray, keys: np.ndarray, hot: int = HOT) -> pa.ListArray:
    """The buckets of each line: its band keys, where a bucket that `hot` or more of these lines share is split.

    The low 16 bits of a key say which part of a bucket it is. Part 0 takes the
    lines of small buckets and the smallest line of a hot one; this line and the
    others also make a part of their own. So a bucket that a large share of all
    lines fall in reaches no single task as a whole.
    """
    n, bands = keys.shape
    flat = (keys & ~U64(PART)).reshape(-1)
    ordered = np.sort(flat)
    crowded = np.unique(ordered[hot - 1 :][ordered[hot - 1 :] == ordered[: max(len(ordered) - hot + 1, 0)]])
    within = np.flatnonzero(np.isin(flat, crowded)) if len(crowded) else np.zeros(0, dtype=np.int64)
    order = within[np.argsort(flat[within], kind="stable")]
    starts = np.searchsorted(flat[order], crowded)
    size = np.diff(np.append(starts, len(order)))
    leaders, parts = [], []
    for b in range(len(crowded)):
        own = order[starts[b] : starts[b] + size[b]]
        leader = own[np.argmin(h[own // bands])]
        part = flat[leader] | U64(int(mix(h[leader // bands : leader // bands + 1].astype(U64))[0]) % PART + 1)
        flat[own[own != leader]] = part
        leaders.append(leader // bands)
        parts.append(part)
    if not leaders:
        return long_lists(signed(flat.reshape(n, bands)))
    at, by = np.array(leaders), np.argsort(leaders, kind="stable")
    values = np.insert(flat, (at[by] + 1) * bands, np.array(parts, dtype=U64)[by])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(bands + np.bincount(at, minlength=n)))), pa.int32()), pa.array(signed(values)))


def sets(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all lines, line by line and in order, and where those of each line begin."""
    items, counts = [np.zeros(0, dtype=U64)], [np.zeros(1, dtype=np.int64)]
    for i, j in chunks(lines, CHUNK):
        line, item, _ = counted(*char_shingles(lines[i:j], size))
        items.append(item)
        counts.append(np.bincount(line, minlength=j - i))
    return np.concatenate(items), np.cumsum(np.concatenate(counts))


def apart(a: np.ndarray, b: np.ndarray, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each pair of lines, at least so many shingles are in one of them only."""
    size = np.diff(starts)
    bins = np.zeros((len(size), BOUND_BINS), dtype=bool)
    bins[np.repeat(np.arange(len(size)), size), (items & U64(BOUND_BINS - 1)).astype(np.int64)] = True
    packed = np.packbits(bins, axis=1).view(U64)
    return np.bitwise_count(packed[a] ^ packed[b]).sum(axis=1, dtype=np.int64)


def jaccards(a: np.ndarray, b: np.ndarray, items: np.ndarray, starts: np.ndarray, threshold: float = 0.0) -> np.ndarray:
    """Exact Jaccard similarity of each pair of lines, given by their numbers; 0 where their sizes alone rule the threshold out."""
    size = np.diff(starts)
    out = np.zeros(len(a))
    todo = np.flatnonzero(np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
    if threshold > 0 and len(todo):
        # every bin that one line of a pair has alone holds a shingle that the other lacks
        least = apart(a[todo], b[todo], items, starts)
        total = size[a[todo]] + size[b[todo]]
        todo = todo[total - least >= threshold * (total + least)]
    cost = np.cumsum(size[a[todo]] + size[b[todo]])
    for own in np.split(todo, np.searchsorted(cost, np.arange(200_000, cost[-1] if len(cost) else 0, 200_000))):
        if not len(own):
            continue
        both = np.concatenate((a[own], b[own]))
        n = size[both]
        at = np.repeat(starts[both] - np.cumsum(n) + n, n) + np.arange(n.sum())
        packed = np.sort((np.repeat(np.tile(np.arange(len(own)), 2), n).astype(U64) << U64(44)) | items[at])
        shared = np.bincount((packed[1:][packed[1:] == packed[:-1]] >> U64(44)).astype(np.int64), minlength=len(own))
        out[own] = shared / np.maximum(size[a[own]] + size[b[own]] - shared, 1)
    return out


def digests(lines: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each line in lower case; the first one names the line in the search, both together identify it."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.lower().encode("utf-8", "surrogatepass")) for x in lines), dtype="<i8").reshape(-1, 2)


def worded(texts: list[str]) -> tuple[list[int], list[int], list[str]]:
    """Of all lines with a letter or digit: the text, the line's number in it, the line without the blanks around it."""
    of, no, lines = [], [], []
    for k, text in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            if _WORD.search(line):
                of.append(k)
                no.append(i)
                lines.append(line.strip(" "))
    return of, no, lines


def taking_part(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null")


def sketches(docs: DataFrame) -> DataFrame:
    """(part, k, h): buckets and lines of equal positions, 8 bytes each, packed by ranges of k; a task skips a line that it has met."""

    def make():
        met: set[int] = set()

        def f(texts: list) -> dict | None:
            listed = worded(texts)[2]
            h = digests(listed)[:, 0]
            _, first = np.unique(h, return_index=True)
            new = [k for k in first.tolist() if int(h[k]) not in met]
            if len(met) > MET:
                met.clear()
            met.update(h[new].tolist())
            if not new:
                return None
            listed, h = [listed[k] for k in new], h[new]
            own = [minima(*char_shingles(listed[i:j]), j - i) for i, j in chunks(listed, CHUNK)]
            return packed(h, split(h, band_keys(filled(np.concatenate(own)))))

        return f

    return map_batches(taking_part(docs), ["text"], "part int, k binary, h binary", make)


def packed(h: np.ndarray, buckets: pa.ListArray) -> dict:
    """A row for each range of bucket keys: the buckets and the lines in them, as bytes."""
    k, of = buckets.flatten().to_numpy(), np.repeat(h, buckets.value_lengths().to_numpy())
    part = (k.view(U64) >> U64(64 - RANGE_BITS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = pa.py_buffer(np.append(starts, len(part)).astype(np.int32) * np.int32(8))
    return {"part": part[starts].astype(np.int32)} | {name: pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(x[order])]) for name, x in (("k", k), ("h", of))}


def starred_lines(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, a, b) of every bucket with several lines: each other line a and the smallest line b."""
    order = np.argsort(k)
    k = k[order]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(starts, len(k)))
    several = np.repeat(size > 1, size)
    k, h, size = k[several], h[order[several]], size[size > 1]
    if not len(k):
        return k, h, h
    low = np.repeat(np.minimum.reduceat(h, np.cumsum(size) - size), size)
    other = h != low
    return k[other], h[other], low[other]


def starred(sketched: DataFrame) -> DataFrame:
    """(k, a, b) of every bucket of `sketches` with several lines; the rows of a range of keys meet in one task, which has one range at a time in memory."""

    bound_batches(sketched.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=["k", "a", "b"])
            made.clear()
            return out

        def close(ks: list, hs: list) -> None:
            found = starred_lines(*(np.frombuffer(b"".join(x), dtype=np.int64) for x in (ks, hs)))
            if len(found[0]):
                made.append(found)

        now, ks, hs = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            k, h = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in zip(cuts, cuts[1:]):
                if part[i] != now:
                    close(ks, hs)
                    now, ks, hs = part[i], [], []
                ks += k[i:j]
                hs += h[i:j]
                if sum(len(x[0]) for x in made) >= SENT:
                    yield send()
        close(ks, hs)
        if made:
            yield send()
        settle()

    return sketched.repartition("part").sortWithinPartitions("part").mapInArrow(run, "k long, a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h, h2, line) of the lines named by the nodes (h), and of few others; a line of each hash stands for all that equal it."""
    among = bitmap(nodes, "h")

    def make():
        met: set[int] = set()

        def f(texts: list) -> dict | None:
            listed = worded(texts)[2]
            h = digests(listed)
            new = []
            for k in np.flatnonzero(among(h[:, 0])).tolist():
                if int(h[k, 1]) not in met:
                    met.add(int(h[k, 1]))
                    new.append(k)
            if len(met) > MET:
                met.clear()
            return {"h": h[new, 0], "h2": h[new, 1], "line": [listed[k] for k in new]} if new else None

        return f

    found = map_batches(taking_part(docs), ["text"], "h long, h2 long, line string", make)
    return found.groupBy("h").agg(F.min_by("line", "h2").alias("line"), F.min("h2").alias("h2"))


def places(docs: DataFrame) -> DataFrame:
    """(doc, version, line_no, h, h2) of all lines that take part."""

    def make():
        def f(ids: list, versions: list, texts: list) -> dict | None:
            of, no, listed = worded(texts)
            h = digests(listed)
            return {"doc": np.array(ids, dtype=np.int64)[of], "version": np.array(versions, dtype=np.int64)[of], "line_no": no, "h": h[:, 0], "h2": h[:, 1]} if of else None

        return f

    return map_batches(taking_part(docs), [F.col("doc_id").cast("long"), F.xxhash64("text"), "text"], "doc long, version long, line_no int, h long, h2 long", make)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of line keys whose lines are similar enough."""

    def make():
        def f(a: list, ta: list, b: list, tb: list) -> dict | None:
            lines = dict(zip(a, ta)) | dict(zip(b, tb))  # a line of many pairs is shingled once
            number = {h: k for k, h in enumerate(lines)}
            good = jaccards(np.array([number[h] for h in a]), np.array([number[h] for h in b]), *sets(list(lines.values())), threshold) >= threshold
            return {"a": np.array(a)[good], "b": np.array(b)[good]} if good.any() else None

        return f

    # the leader's text is joined last: its pairs then lie together
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("ta")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("tb")), "b")
    return map_batches(both, ["a", "ta", "b", "tb"], "a long, b long", make)


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, version, line_no) of every line that an earlier one stands for; version is the hash of the document's text.

    Equal lines share a key, so that copies form no pairs. In a bucket every line
    is verified against one leader, then all pairs between lines that are not yet
    connected, so no candidate is left out. Lines without a letter or digit take
    no part, nor do rows with null doc_id or text. Rows with equal doc_id and
    text are one document; its own repeated lines count as duplicates. Where
    several texts share a doc_id, the smaller version is the earlier one; there
    are no other ties. A very long text is split and hashed as a whole, in a
    task's memory; its lines are worked off in pieces. An empty table gives no
    row. Other columns of docs are not read, whatever their names.
    """
    spark = docs.sparkSession
    linked = cut(starred(sketches(docs)))
    pairs = cut(linked.select("a", "b").distinct())
    # every pair to come is one of lines that share a bucket: their texts are fetched once, and only theirs
    nodes = cut(pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct())
    texts = cut(texts_of(docs, nodes).join(nodes, "h"))
    release(spark)
    edges = cut(verified(pairs, texts, threshold))
    roots = cut(components(edges))
    buckets = members(linked).select(F.col("k").bitwiseAND(F.lit(~PART)).alias("k"), "n").distinct()
    rest = cut(open_pairs(buckets, "k", "n", roots, pairs))
    if not rest.isEmpty():
        edges = cut(edges.union(verified(rest, texts, threshold)))
        roots = cut(components(edges))
    release(spark)
    # by both hashes, so that a line which only shares the first one with a verified line goes by itself
    full = roots.join(texts.select(F.col("h").alias("node"), "h2"), "node").withColumnRenamed("node", "h")
    lines = cut(places(docs).join(full, ["h", "h2"], "left").select("doc", "version", "line_no", F.coalesce("root", "h").alias("r"), F.when(F.col("root").isNull(), F.col("h2")).otherwise(0).alias("r2")))
    release(spark)
    # counted and compared before the shuffle; only what there is several times comes back
    first = cut(lines.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "version", "line_no")).alias("first")).where("n > 1").select("r", "r2", "first"))
    several = maybe_in(lines, "r", first, "r").join(first, ["r", "r2"])
    return several.where("first != struct(doc, version, line_no)").select("doc", "version", "line_no")


def drop_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with their duplicate lines taken out of the text, in the same columns; n_chars follows the text.

    A document that loses its last line with a letter or digit goes. All other
    rows stay, those that take no part (null doc_id, null or empty text) and those
    without such a line unchanged. Only documents that lose a line are shuffled.
    Ties, repeated rows and very long texts are those of `removed_lines`. Columns
    of docs may have any names but those that begin with "__brindle_".
    """
    bound_batches(docs.sparkSession)
    gone = removed_lines(docs, threshold).groupBy(F.col("doc").alias("__brindle_doc"), F.col("version").alias("__brindle_version")).agg(F.collect_set("line_no").alias("__brindle_lines"))
    gone = cut(gone.withColumn("__brindle_key", F.xxhash64("__brindle_doc", "__brindle_version")))

    @F.arrow_udf("string")
    def rest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lines in batches:
            yield pa.array([None if out is None else _without(t, out) for t, out in zip(texts.to_pylist(), lines.to_pylist())], type=pa.string())
        settle()

    doc, version = F.col("doc_id").cast("long"), F.xxhash64("text")
    some, others = parted(docs, F.xxhash64(doc, version), gone, "__brindle_key")
    joined = some.join(gone, (doc == F.col("__brindle_doc")) & (version == F.col("__brindle_version")), "left")
    # as if not deterministic, so that the filter isn't moved below it and the lines cut twice
    marked = joined.withColumn("__brindle_rest", rest.asNondeterministic()(F.when(F.col("__brindle_lines").isNotNull(), F.col("text")), "__brindle_lines"))
    left = marked.where("__brindle_rest is null or __brindle_rest rlike '[\\\\p{L}\\\\p{N}]'")
    columns = {"text": F.coalesce("__brindle_rest", "text")} | ({"n_chars": F.when(F.col("__brindle_rest").isNull(), F.col("n_chars")).otherwise(F.length("__brindle_rest").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return replaced(left, columns).select(*[f"`{c}`" for c in docs.columns]).union(others)


def _without(text: str, gone) -> str:
    out = set(gone)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents"))
