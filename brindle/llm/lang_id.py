"""Language identification by interpolated Kneser-Ney character models.

One model of order 5 is trained for every language that labels documents, from
the character 5-grams of all labelled documents. Its probabilities and back-off
weights lie in arrays sorted by the hash of the n-gram, one pair for each order.
A document gets the language whose model needs the fewest bits per character;
it is rejected where even that is more than the calibrated limit of the language
or where the runner-up is too close. The limits of a language are calibrated on
every HELD-th of its documents, by the hash of the text, which take no part in
training; a language of fewer than HELD_FROM labelled documents is trained and
calibrated on all of them.

Text is read in lower case, with every digit as 0 and every run of white space as
one space. Characters beyond the ALPHABET most frequent ones count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, map_batches, pieces, settle, table
from .textvec import U64, Chars, mix, tables

ORDER = 5
BITS = 11
ALPHABET = (1 << BITS) - 2
#: All 5-grams are kept. A slice of the models holds about so many of them, of all languages; a task has one slice in memory at a time.
SLICE_GRAMS = 1_500_000
#: Up to so many probabilities (5-grams times languages), a task joins the models' 5-grams in one array; beyond, it asks each model, with the same result.
JOINT = 20_000_000
#: Of the documents that get the language they are labelled with, so large a share is accepted.
ACCEPTED = 0.999
#: One in so many documents calibrates the limits; of a language of at least so many labelled ones.
HELD, HELD_FROM = 10, 2_000
#: Documents in a scoring chunk and characters in it; the chunk number must fit beside a 5-gram in 64 bits.
CHUNK_DOCS, CHUNK_CHARS = 1 << (63 - ORDER * BITS), 250_000
SCORE = "lang string, cross_entropy double, margin double"


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and (total + len(t) > CHUNK_CHARS or j - i >= CHUNK_DOCS - 1):
            yield i, j
            i, total = j, 0
        total += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, character) of the normalised texts; each starts with a space, which is context only."""
    chars = Chars(texts)
    t = tables()
    points = t["lower"][chars.points]
    points[t["digit"][chars.points]] = ord("0")
    blank = t["space"][chars.points] | (chars.points < 32)
    points[blank] = ord(" ")
    # the line feed that ends a text becomes the space that starts the next one
    doc = np.repeat(np.arange(chars.n), np.diff(chars.starts))
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    keep[chars.starts[1:] - 1] = False
    points, doc = points[keep], doc[keep]
    at = np.searchsorted(doc, np.arange(chars.n))
    return np.insert(doc, at, np.arange(chars.n)), np.insert(points, at, ord(" "))


def grams(doc: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, packed 5-gram) ending at each character but the first of a document; code 0 fills up its start."""
    packed = codes.astype(U64)
    n = len(codes)
    start = np.concatenate(([True], doc[1:] != doc[:-1]))
    since = np.arange(n) - np.repeat(np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), n)))
    for k in range(1, ORDER):
        before = np.zeros(n, dtype=U64)
        before[k:] = codes[:-k]
        before[since < k] = 0
        packed |= before << U64(k * bits)
    keep = ~start
    return doc[keep], packed[keep]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents that have a text and a language."""

    def make():
        def f(texts: list, langs: list) -> dict | None:
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            names = sorted(set(langs))
            for name in names:
                own = [t for t, x in zip(texts, langs) if x == name]
                for i, j in _chunks(own):
                    doc, points = characters(own[i:j])
                    alphabet, codes = _ranked(points)
                    bits = max(1, int(len(alphabet)).bit_length())
                    if ORDER * bits > 64:  # too many distinct characters for one word: the rarest of the chunk count as one
                        bits = 64 // ORDER
                        codes = np.minimum(codes, (1 << bits) - 1)
                        alphabet = np.append(alphabet[: (1 << bits) - 2], 0xFFFD)
                    _, packed = grams(doc, codes, bits)
                    packed = np.sort(packed)
                    if not len(packed):
                        continue
                    at = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
                    distinct, n = packed[at], np.diff(np.append(at, len(packed)))
                    back = np.concatenate(([0], alphabet)).astype("<u4")
                    wide = np.empty((len(distinct), ORDER), dtype="<u4")
                    for k in range(ORDER):
                        wide[:, ORDER - 1 - k] = back[(distinct >> U64(k * bits)) & U64((1 << bits) - 1)]
                    wide[wide == 0] = 1  # a NUL would be lost at the end of a numpy string
                    out["lang"] += [name] * len(distinct)
                    out["gram"].append(wide.reshape(-1).view(f"<U{ORDER}"))
                    out["n"].append(n)
            if not out["n"]:
                return None
            return {"lang": out["lang"], "gram": np.concatenate(out["gram"]).tolist(), "n": np.concatenate(out["n"])}

        return f

    rows = docs.where("text is not null and lang is not null and text != ''")
    found = map_batches(rows, ["text", "lang"], "lang string, gram string, n long", make)
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _ranked(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct characters by descending frequency, and the rank of each from 1."""
    n = np.bincount(points)
    alphabet = np.flatnonzero(n)
    alphabet = alphabet[np.argsort(-n[alphabet], kind="stable")]
    rank = np.zeros(len(n), dtype=np.int64)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)
    return alphabet, rank[points]


def _shorter(packed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-grams at the end of distinct (k+1)-grams; each counts once for each character seen before it."""
    g, n = np.unique(packed & U64((1 << (k * BITS)) - 1), return_counts=True)
    return g.astype(U64), n.astype(np.float64)


class Whole:
    """What the slices of a language's 5-grams tell only together: the discounts, and the counts of 1-grams and 2-grams.

    A slice holds all 5-grams with the same third and fourth character, and so
    all that makes the counts and contexts of its 3-grams and 4-grams.
    """

    def __init__(self):
        self.once, self.twice = np.zeros(ORDER + 1), np.zeros(ORDER + 1)
        self.low: dict[int, tuple[np.ndarray, np.ndarray]] = {2: (np.zeros(0, dtype=U64), np.zeros(0))}

    @staticmethod
    def high(packed: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(k-grams, counts) of a slice for the orders from 3 on."""
        levels = {ORDER: (packed, counts.astype(np.float64))}
        for k in range(ORDER - 1, 2, -1):
            levels[k] = _shorter(levels[k + 1][0], k)
        return levels

    def _note(self, k: int, counts: np.ndarray) -> None:
        self.once[k] += np.sum(counts == 1)
        self.twice[k] += np.sum(counts == 2)

    def add(self, packed: np.ndarray, counts: np.ndarray) -> Whole:
        levels = self.high(packed, counts)
        for k, (_, n) in levels.items():
            self._note(k, n)
        pairs, n = (np.concatenate(x) for x in zip(self.low[2], _shorter(levels[3][0], 2)))
        g, of = np.unique(pairs, return_inverse=True)
        self.low[2] = g, np.bincount(of, weights=n, minlength=len(g))
        return self

    def close(self) -> Whole:
        self.low[1] = _shorter(self.low[2][0], 1)
        for k in (1, 2):
            self._note(k, self.low[k][1])
        return self

    def discount(self, k: int) -> float:
        n1, n2 = self.once[k], self.twice[k]
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


class Model:
    """Kneser-Ney probabilities of one language, or of a slice of it, in sorted hash arrays."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray, whole: Whole | None = None):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = [None] * (ORDER + 1)  # by order: hashes, log2 of probability
        self.backs: list[tuple[np.ndarray, np.ndarray]] = [None] * (ORDER + 1)  # by order of the context: hashes, log2 of weight
        whole = whole or Whole().add(packed, counts).close()
        levels = Whole.high(packed, counts) | whole.low
        lower_p = None
        for k in range(1, ORDER + 1):
            g, c = levels[k]
            discount = whole.discount(k)
            context = g >> U64(BITS)
            ctx, of = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(of, weights=c), np.bincount(of)
            gamma = discount * kinds / total
            base = np.full(len(g), 2.0 ** -(BITS + 5)) if k == 1 else lower_p[np.searchsorted(levels[k - 1][0], g & U64((1 << ((k - 1) * BITS)) - 1))]
            p = np.maximum(c - discount, 0) / total[of] + gamma[of] * base
            lower_p = p
            self.grams[k] = _hashed(g, np.log2(p))
            self.backs[k - 1] = _hashed(ctx, np.log2(gamma))

    def log2(self, packed: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last character of each packed 5-gram, given those before it."""
        out = np.zeros(len(packed))
        todo = np.arange(len(packed))
        for k in range(ORDER, 0, -1):
            g = packed[todo] & U64((1 << (k * BITS)) - 1)
            there, value = _find(self.grams[k], g)
            out[todo[there]] += value[there]
            todo, g = todo[~there], g[~there]
            there, value = _find(self.backs[k - 1], g >> U64(BITS))
            out[todo[there]] += value[there]
        out[todo] -= BITS + 5
        return out.astype(np.float32)  # as the joint array of a slice holds it


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys)
    order = np.argsort(h)
    return h[order], values[order].astype(np.float32)


def _find(pair: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, values = pair
    if not len(hashes):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
    h = mix(keys)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return hashes[at] == h, values[at]


class Slice:
    """The models of all languages over the 5-grams of a slice.

    A slice that is the only one is sent as the counted 5-grams; a worker makes
    the models from them when it first needs them, and keeps them. One of
    several is sent as its models.
    """

    def __init__(self, wholes: list[Whole], of: np.ndarray, packed: np.ndarray, n: np.ndarray, only: bool):
        self.wholes, self.counts, self.only = wholes, (of, packed, n), only
        self.models: list[Model] = []
        self.joint: tuple[np.ndarray, np.ndarray] | None = None
        if not only:
            self._make()

    def _make(self) -> None:
        of, packed, n = self.counts
        for k, whole in enumerate(self.wholes):
            own = of == k
            order = np.argsort(packed[own])
            self.models.append(Model(packed[own][order], n[own][order], whole))
        known = np.unique(packed) if self.only else packed[:0]
        self.wholes, self.counts = [None] * len(self.wholes), None
        if known.size * len(self.models) > JOINT:
            known = known[:0]
        values = np.column_stack([m.log2(known) for m in self.models]).astype(np.float32)
        h = mix(known)
        order = np.argsort(h)
        self.joint = h[order], values[order]

    def log2(self, packed: np.ndarray) -> np.ndarray:
        """A column for each language: log2 of the probability of each packed 5-gram's last character.

        The 5-grams of the training data are looked up in one joint array,
        which is made where it is used and not sent; the others back off in
        each model.
        """
        if self.joint is None:
            self._make()
        hashes, values = self.joint
        out = np.empty((len(packed), len(self.models)))
        there = np.zeros(len(packed), dtype=bool)
        if len(hashes):
            h = mix(packed)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            there = hashes[at] == h
            out[there] = values[at[there]]
        rest = packed[~there]
        if len(rest):
            out[~there] = np.column_stack([m.log2(rest) for m in self.models])
        return out


def _pair(packed: np.ndarray) -> np.ndarray:
    """Third and fourth character of packed 5-grams; they decide the slice."""
    return (packed >> U64(BITS)) & U64((1 << (2 * BITS)) - 1)


class Models:
    """The models of all languages over one alphabet, in broadcast slices; the k-th holds the pairs of characters from firsts[k] on."""

    def __init__(self, langs: list[str], alphabet: np.ndarray, firsts: np.ndarray, slices: list):
        self.langs, self.alphabet, self.firsts, self.slices = langs, alphabet, firsts, slices
        self.rank: np.ndarray | None = None

    def _distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The distinct 5-grams of some texts; for each occurrence its 5-gram's place and its document; the number of texts."""
        doc, points = characters(texts)
        doc, packed = grams(doc, self.rank[points], BITS)
        order = np.sort((packed << U64(63 - ORDER * BITS)) | doc.astype(U64))
        gram, doc = order >> U64(63 - ORDER * BITS), (order & U64(CHUNK_DOCS - 1)).astype(np.int64)
        new = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, dtype=bool)
        return gram[new], np.cumsum(new) - 1, doc, len(texts)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each text under each model; NaN for a text without characters."""
        if self.rank is None:
            self.rank = ranks(self.alphabet)
        parts = [np.zeros((0, len(self.langs)))]
        cuts = list(_chunks(texts))
        for group in [[c] for c in cuts] if len(self.slices) == 1 else [cuts]:
            made = [self._distinct(texts[i:j]) for i, j in group]
            found = [np.zeros((len(m[0]), len(self.langs))) for m in made]
            places = [np.searchsorted(self.firsts, _pair(m[0]), side="right") - 1 for m in made]
            for k, shared in enumerate(self.slices):
                for (gram, _, _, _), values, place in zip(made, found, places):
                    own = np.maximum(place, 0) == k
                    values[own] = shared.value.log2(gram[own])
                if len(self.slices) > 1:
                    shared.__dict__.pop("_value", None)  # it is read again from the local file
            for (_, of, doc, n), values in zip(made, found):
                length = np.bincount(doc, minlength=n).astype(float)
                length[length == 0] = np.nan
                parts.append(np.column_stack([-np.bincount(doc, weights=values[of, k], minlength=n) / length for k in range(len(self.langs))]))
        return np.concatenate(parts)

    def score(self, texts: list) -> dict[str, list]:
        """Best language, its bits per character, and how many more the runner-up needs; nulls for null, empty or blank text."""
        some = [k for k, t in enumerate(texts) if t]
        lang, entropy, margin = ([None] * len(texts) for _ in range(3))
        if some and self.langs:
            bits = self.entropies([texts[k] for k in some])
            good = ~np.isnan(bits[:, 0])
            best = np.argmin(np.where(np.isnan(bits), np.inf, bits), axis=1)
            rest = np.sort(bits, axis=1)
            for r, k in enumerate(some):
                if good[r]:
                    lang[k], entropy[k] = self.langs[best[r]], float(bits[r, best[r]])
                    margin[k] = float(rest[r, 1] - rest[r, 0]) if len(self.langs) > 1 else float("inf")
        return {"lang": lang, "cross_entropy": entropy, "margin": margin}


def ranks(alphabet: np.ndarray) -> np.ndarray:
    """Code of every code point: from 1 by its place in the alphabet, one code for all others, 0 for the filler."""
    rank = np.full(0x110000, ALPHABET + 1, dtype=np.uint16)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)
    rank[:2] = 0
    return rank


def train(docs: DataFrame) -> Models:
    """Models of all languages that label a document, over all their 5-grams. What reaches the driver at once is a slice of them."""
    counts = cut(gram_counts(docs))
    rows = counts.groupBy(F.substring("gram", -1, 1).alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(ALPHABET).collect()
    alphabet = np.array([ord(r["c"]) for r in rows], dtype=np.int64)

    def make():
        rank = ranks(alphabet)

        def f(langs: list, texts: list, n: list) -> dict:
            wide = np.array(texts, dtype=f"<U{ORDER}").view("<u4").reshape(-1, ORDER)
            packed = np.zeros(len(wide), dtype=U64)
            for k in range(ORDER):
                packed = (packed << U64(BITS)) | rank[wide[:, k]].astype(U64)
            return {"lang": langs, "gram": packed.astype(np.int64), "n": n}

        return f

    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Models([], alphabet, np.zeros(0, dtype=U64), [])
    coded = cut(map_batches(counts, ["lang", "gram", "n"], "lang string, gram long, n long", make).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    pair = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << (2 * BITS)) - 1))
    sizes = coded.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n")).orderBy("pair").toArrow()
    pairs, n = sizes.column("pair").to_numpy(), sizes.column("n").to_numpy()
    firsts = pairs[np.unique((np.cumsum(n) - n) // SLICE_GRAMS, return_index=True)[1]]
    code = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1

    def rows(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = coded.where(pair >= int(firsts[k])) if k + 1 == len(firsts) else coded.where((pair >= int(firsts[k])) & (pair < int(firsts[k + 1])))
        found = own.select(code.cast("int").alias("of"), "gram", "n").toArrow()  # columns of numbers; rows of Python objects would fill the driver
        return tuple(found.column(c).to_numpy().astype(t) for c, t in (("of", np.int32), ("gram", U64), ("n", np.int64)))

    wholes = [Whole() for _ in langs]
    for k in range(len(firsts)):
        held = rows(k)
        for x, whole in enumerate(wholes):
            own = held[0] == x
            order = np.argsort(held[1][own])
            whole.add(held[1][own][order], held[2][own][order])
    for whole in wholes:
        whole.close()
    only = len(firsts) == 1
    return Models(langs, alphabet, firsts.astype(U64), [docs.sparkSession.sparkContext.broadcast(Slice(wholes, *(held if only else rows(k)), only)) for k in range(len(firsts))])


def scorer(models: Models):
    @F.arrow_udf(SCORE)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [models.score(texts.to_pylist()) for texts in pieces(batch)]
            columns = [pa.array([x for p in parts for x in p[name]], type=kind) for name, kind in (("lang", pa.string()), ("cross_entropy", pa.float64()), ("margin", pa.float64()))]
            yield pa.StructArray.from_arrays(columns, ["lang", "cross_entropy", "margin"])
        settle()

    return score.asNondeterministic()  # as if, so that no filter is moved below it and the text scored twice


def roles(docs: DataFrame) -> tuple[Column, Column]:
    """Whether a labelled document trains, and whether it calibrates."""
    large = sorted(r[0] for r in docs.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HELD_FROM).select("lang").collect())
    own = F.col("lang").isin(large) if large else F.lit(False)
    held = F.pmod(F.xxhash64(F.lit("held out"), "text"), F.lit(HELD)) == 0
    return ~own | ~held, ~own | held


def limits(scores: DataFrame, accepted: float = ACCEPTED) -> dict[str, tuple[float, float]]:
    """By language, over the calibrating documents labelled with it and recognised: the most bits a character and the least margin accepted."""
    own = scores.where("lang = label").groupBy("lang").agg(F.percentile_approx("cross_entropy", F.lit(accepted), F.lit(100_000)).alias("most"), F.percentile_approx("margin", F.lit(1 - accepted), F.lit(100_000)).alias("least"))
    return {r["lang"]: (r["most"], r["least"]) for r in own.collect()}


def accepts(score: Column, found: dict[str, tuple[float, float]]) -> Column:
    """Whether a score passes the limits of its language; false where it is null."""
    ok = F.lit(False)
    for lang, (most, least) in sorted(found.items()):
        ok = ok | ((score["lang"] == lang) & (score["cross_entropy"] <= most) & (score["margin"] >= least))
    return F.coalesce(ok, F.lit(False))


def identify(docs: DataFrame, accepted: float = ACCEPTED) -> DataFrame:
    """(doc_id, lang, cross_entropy, margin) of every accepted document.

    Null, empty and blank texts are rejected; a null label only keeps a document
    out of training and calibration; a null doc_id is carried along; repeated
    rows are scored one by one, and equal texts get equal scores. Of languages
    whose models need equally many bits the first by name is taken, with a margin
    of 0. A very long text is scored as a whole. Without any labelled document,
    and so of an empty table, all are rejected. Columns other than doc_id, text
    and lang are not read.
    """
    trains, calibrates = roles(docs)
    score = scorer(train(docs.where(trains)))
    scores = cut(docs.select("doc_id", F.col("lang").alias("label"), F.coalesce(calibrates, F.lit(False)).alias("calibrates"), score("text").alias("s")).select("doc_id", "label", "calibrates", "s.*"))
    found = limits(scores.where("calibrates"), accepted)
    return scores.where(accepts(F.struct("lang", "cross_entropy", "margin"), found)).select("doc_id", "lang", "cross_entropy", "margin")


def keep_identified(docs: DataFrame, accepted: float = ACCEPTED) -> DataFrame:
    """The accepted documents, see `identify`, with the identified language in lang and all else as it is.

    The text is scored where it calibrates and once more for the decision, so that
    it is never shuffled or written again. Columns of docs may have any names but
    "__brindle_score".
    """
    trains, calibrates = roles(docs)
    score = scorer(train(docs.where(trains)))
    found = limits(docs.where(calibrates).select(F.col("lang").alias("label"), score("text").alias("s")).select("label", "s.*"), accepted)
    scored = docs.withColumn("__brindle_score", score("text")).where(accepts(F.col("__brindle_score"), found))
    return scored.select(*[F.col("__brindle_score.lang").alias(c) if c.lower() == "lang" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
