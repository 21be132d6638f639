"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is the set of its distinct shingles, each weighted by how often it
occurs. Two documents are compared by probability Jaccard,

    J(x, y) = sum over shared d of 1 / sum over d' of max(x[d'] / x[d], y[d'] / y[d]),

for which ProbMinHash (Ertl, 2020) has signatures: every shingle emits a Poisson
process of arrivals at the rate of its weight, each arrival falls on a random
register, and a register keeps the shingle of its earliest arrival. A shingle
stops as soon as its next arrival is later than all registers of the document.

A document is identified by its doc_id and the hash of its text, and equal
weighted sets by 128 bits of a hash; all documents of a set are one node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, open_pairs, star_edges
from .shared import cut, long_lists, map_batches, maybe_in, parted, release, table
from .textvec import U64, Chars, chunks, counted, mix, shingles, signed

SHINGLE = 3
REGISTERS = 128
BANDS = 32
THRESHOLD = 0.55


def weighted(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of some texts, in order of document and shingle."""
    doc, _, _, words = Chars(texts).words()
    return counted(*shingles(doc, words, size))


def probminhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS, seed: int = 1) -> np.ndarray:
    """Signature of each of n documents: in every register the item of its earliest arrival (0 throughout where it has no item)."""
    best = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, dtype=U64)
    time = np.zeros(len(item))
    state = mix(item ^ mix(np.array([seed], dtype=U64)))
    while len(item):
        state = mix(state)
        draw = (state >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        time -= np.log(draw) / weight
        slot = doc * registers + (mix(state ^ U64(0x5851F42D4C957F2D)) % U64(registers)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        who[slot[won]] = item[won]
        first = np.concatenate(([True], doc[1:] != doc[:-1]))
        last = best.reshape(n, registers)[doc[first]].max(axis=1)
        going = time < np.repeat(last, np.diff(np.append(np.flatnonzero(first), len(doc))))
        doc, item, weight, time, state = doc[going], item[going], weight[going], time[going], state[going]
    return who.reshape(n, registers)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = signatures.shape
    parts = signatures.reshape(n, bands, m // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (n, bands))
    for r in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, r])
    return key


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, of two weighted sets given as (distinct sorted items, weights)."""
    items = np.union1d(a[0], b[0])
    x, y = np.zeros(len(items)), np.zeros(len(items))
    x[np.searchsorted(items, a[0])] = a[1]
    y[np.searchsorted(items, b[0])] = b[1]
    shared = (x > 0) & (y > 0)
    if not shared.any():
        return 0.0
    ratio = np.full(len(items), np.inf)
    np.divide(x, y, out=ratio, where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio, shared = x[order], y[order], ratio[order], shared[order]
    above = np.append(np.cumsum(x[::-1])[::-1], 0)  # where x[d'] / x[d] is the larger term
    below = np.concatenate(([0], np.cumsum(y)))
    at = np.searchsorted(ratio, ratio[shared], "left")
    return float(np.sum(1 / (above[at] / x[shared] + below[at] / y[shared])))


def sketches(docs: DataFrame, seed: int) -> DataFrame:
    """(id, version, k1, k2, bands) of every row that has an id and a word; k1 and k2 identify the weighted set, version the text."""

    def make():
        def f(ids: list, versions: list, texts: list) -> dict | None:
            keys, bands = [], []
            for i, j in chunks(texts):
                doc, item, weight = weighted(texts[i:j])
                n = j - i
                w = weight.astype(U64)
                sums = np.zeros((n, 2), dtype=U64)
                if len(doc):
                    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    for k, salt in enumerate((1, 2)):
                        sums[doc[at], k] = np.add.reduceat(mix(mix(item + U64(salt)) * U64(2 * salt + 1) ^ w), at)
                some = np.zeros(n, dtype=bool)
                some[doc] = True
                sums[~some] = 0
                keys.append(np.column_stack((sums, some.astype(U64))))
                bands.append(band_keys(probminhash(doc, item, weight, n, seed=seed)))
            keys, bands = np.concatenate(keys), np.concatenate(bands)
            some = keys[:, 2] == 1
            if not some.any():
                return None
            return {"id": np.array(ids, dtype=np.int64)[some], "version": np.array(versions, dtype=np.int64)[some], "k1": signed(keys[some, 0].copy()), "k2": signed(keys[some, 1].copy()), "bands": long_lists(signed(np.ascontiguousarray(bands[some])))}

        return f

    rows = docs.where("doc_id is not null and text is not null and text != ''")
    return map_batches(rows, [F.col("doc_id").cast("long"), F.xxhash64("text"), "text"], "id long, version long, k1 long, k2 long, bands array<long>", make)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose documents' probability Jaccard reaches the threshold."""

    def make():
        def f(a: list, ta: list, b: list, tb: list) -> dict | None:
            out: list[tuple[int, int]] = []
            distinct = dict(zip(a, ta)) | dict(zip(b, tb))
            ids = sorted(distinct)
            sets = {}
            for i, j in chunks(listed := [distinct[k] for k in ids]):
                doc, item, weight = weighted(listed[i:j])
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(j - i):
                    sets[ids[i + k]] = (item[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]])
            for p, q in zip(a, b):
                if probability_jaccard(sets[p], sets[q]) >= threshold:
                    out.append((p, q))
            return {"a": [x for x, _ in out], "b": [y for _, y in out]} if out else None

        return f

    # the leader's text is joined last: its pairs then lie together and it is shingled once a batch
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return map_batches(both, ["a", "ta", "b", "tb"], "a long, b long", make)


def copies(docs: DataFrame, threshold: float = THRESHOLD, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, version, kept_id, kept_version) of every document that another one stands for; (id, version) of those that several rows hold."""
    spark = docs.sparkSession
    found = cut(sketches(docs, seed))
    least = F.min(F.struct("id", "version"))
    classes = cut(found.groupBy("k1", "k2").agg(least.alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")))
    buckets = classes.select(F.col("k1").alias("n"), F.explode("bands").alias("k"))
    candidates = cut(star_edges(buckets, "k", "n"))
    nodes = cut(candidates.select(F.col("a").alias("k1")).union(candidates.select(F.col("b").alias("k1"))).distinct())
    release(spark)
    # one text of each set that has a candidate; of sets that share k1 only one is searched for
    reps = cut(classes.join(nodes, "k1").groupBy("k1").agg(F.min(F.struct("k2", "rep")).alias("x")).select(F.col("k1").alias("node"), "x.k2", F.col("x.rep.id").alias("id"), F.col("x.rep.version").alias("version")))
    own = docs.where("doc_id is not null and text is not null and text != ''").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), "text")
    texts = cut(maybe_in(own, "version", reps, "version").join(reps, ["id", "version"]).groupBy(F.col("node").alias("id")).agg(F.first("text").alias("text")))
    release(spark)
    edges = cut(verified(candidates, texts, threshold))
    roots = cut(components(edges))
    rest = cut(open_pairs(buckets.join(nodes, buckets["n"] == nodes["k1"], "left_semi"), "k", "n", roots, candidates))
    if not rest.isEmpty():
        # cut, so that no task has a worker for the texts and another one for the components; workers live on, and it would be two for each core from here on
        roots = cut(components(cut(edges.union(verified(rest, texts, threshold)))))
    release(spark)
    # by both hashes, so that a set which only shares k1 with a searched one goes by itself
    full = roots.join(reps.select("node", "k2"), "node").select(F.col("node").alias("k1"), "k2", "root")
    placed = cut(classes.select("k1", "k2", "rep", "n").join(full, ["k1", "k2"], "left").select("k1", "k2", "rep", "n", F.coalesce("root", "k1").alias("r"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(0).alias("r2")))
    best = placed.groupBy("r", "r2").agg(F.min("rep").alias("kept"), F.sum("n").alias("all")).where("`all` > 1").select("r", "r2", "kept")
    moved = cut(placed.join(best, ["r", "r2"]).select("k1", "k2", "kept"))
    members = maybe_in(found.select("id", "version", "k1", "k2"), "k1", moved, "k1").join(moved, ["k1", "k2"])
    gone = members.where("struct(id, version) != kept").select("id", "version", F.col("kept.id").alias("kept_id"), F.col("kept.version").alias("kept_version")).distinct()
    return gone, found.groupBy("id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "version")


def groups(docs: DataFrame, threshold: float = THRESHOLD, seed: int = 1) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that has a near-duplicate with a smaller id.

    Documents that are similar to one another, directly or through others, form
    a group, of which the smallest doc_id stays. Equal weighted sets are merged
    by key before any pair is formed; within a bucket every member is verified
    against the smallest one, and afterwards all pairs of a bucket that still
    lie in different components, so that no candidate is left out.

    Rows without a doc_id, with null or empty text or without a word take no
    part. Rows that repeat a doc_id and its text are one document; texts that
    share a doc_id are documents of their own, the smaller hash of the text
    coming first, and where one of them stands for another both ids of the row
    are equal. An empty table gives no row. A very long text is one set, which
    a task holds in memory. Other columns of docs are not read.
    """
    return copies(docs, threshold, seed)[0].select(F.col("id").alias("doc_id"), F.col("kept_id").alias("kept_doc_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, seed: int = 1) -> DataFrame:
    """docs without the documents that a near-duplicate stands for, see `groups`, and without repeats of a row.

    A document is its doc_id and text: of texts that share a doc_id only the
    duplicates go. Of rows that repeat both, and hold a word, one stays, the least
    by its other columns. Rows that take no part stay. Only documents that may go
    are shuffled. Very long texts are those of `groups`. Columns of docs may have
    any names but those that begin with "__brindle_".
    """
    gone, repeated = (cut(x) for x in copies(docs, threshold, seed))
    key = F.xxhash64("id", "version")
    doc, version = F.col("doc_id").cast("long"), F.xxhash64("text")

    def named(keys: DataFrame) -> DataFrame:
        return keys.select(F.col("id").alias("__brindle_id"), F.col("version").alias("__brindle_version"), key.alias("__brindle_key"))

    held = (doc == F.col("__brindle_id")) & (version == F.col("__brindle_version"))
    keys = named(gone)
    some, others = parted(docs, F.xxhash64(doc, version), keys, "__brindle_key")
    left = some.join(keys, held, "left_anti").union(others)
    if repeated.isEmpty():
        return left
    keys = named(repeated)
    some, others = parted(left, F.xxhash64(doc, version), keys, "__brindle_key")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.to_json(whole)  # any columns can be compared as text
    once = some.join(keys, held).groupBy("__brindle_id", "__brindle_version").agg(F.min_by(whole, text).alias("__brindle_row")).select(*[F.col(f"__brindle_row.`{c}`") for c in docs.columns])
    return some.join(keys, held, "left_anti").union(others).union(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
