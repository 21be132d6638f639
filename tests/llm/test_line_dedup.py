import itertools
import random

import numpy as np

from brindle.llm import line_dedup

from .helpers import AWKWARD, empty, frame, prose


def shingles(line, size=line_dedup.SHINGLE):
    t = "".join(x if len(x := c.lower()) == 1 else c for c in line.strip(" "))
    return {t[i : i + size] for i in range(max(len(t) - size + 1, 1))} if t else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def brute(rows, threshold=line_dedup.THRESHOLD):
    """(doc, text, line_no) of the lines that go, by comparing all lines."""
    lines = [(i, t, k, line) for i, t in {(i, t) for i, t, _, _ in rows if i is not None and t is not None} for k, line in enumerate(t.split("\n")) if any(c.isalnum() for c in line)]
    keys = sorted({x[3].strip(" ").lower() for x in lines})
    sets = [shingles(k) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(keys)), 2):
        if jaccard(sets[x], sets[y]) >= threshold:
            root[find(x)] = find(y)
    at = {k: i for i, k in enumerate(keys)}
    first, out = {}, set()
    for i, t, k, line in sorted(lines, key=lambda x: (x[0], x[2])):
        r = find(at[line.strip(" ").lower()])
        if r in first:
            out.add((i, t, k))
        else:
            first[r] = (i, k)
    return out


def corpus():
    draw = random.Random(3)
    base = [prose(k, 14) for k in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(draw.randint(1, 6)):
            line = draw.choice(base) if draw.random() < 0.5 else prose(1000 + draw.randrange(10**6), 12)
            if draw.random() < 0.4:  # a near copy: one word changed
                w = line.split()
                w[draw.randrange(len(w))] = "zz"
                line = " ".join(w)
            lines.append(draw.choice(["", "  "]) + (line.upper() if draw.random() < 0.1 else line))
        rows.append((i, "\n".join([*lines, "---", ""]), "en", "s"))
    return rows


def test_jaccards_are_exact():
    draw = random.Random(1)
    lines = [prose(k, draw.randint(1, 12)) for k in range(40)] + ["a", "ab", "ÄÖ ü straße", "x" * 5000]
    a, b = [draw.choice(lines) for _ in range(200)], [draw.choice(lines) for _ in range(200)]
    number = {x: k for k, x in enumerate(lines)}
    pairs = np.array([number[x] for x in a]), np.array([number[x] for x in b])
    want = np.array([jaccard(shingles(x), shingles(y)) for x, y in zip(a, b)])
    assert np.allclose(line_dedup.jaccards(*pairs, *line_dedup.sets(lines)), want)
    assert ((line_dedup.jaccards(*pairs, *line_dedup.sets(lines), 0.75) >= 0.75) == (want >= 0.75)).all()


def test_bands_recall():
    """Pairs at the threshold share a band nearly always."""
    draw = random.Random(4)
    hit = n = 0
    for k in range(300):
        w = prose(k, 14).split()
        other = list(w)
        other[draw.randrange(14)] = "zz"
        a, b = " ".join(w), " ".join(other)
        if jaccard(shingles(a), shingles(b)) >= line_dedup.THRESHOLD:
            keys = line_dedup.band_keys(line_dedup.signatures(*line_dedup.char_shingles([a, b]), 2))
            n, hit = n + 1, hit + (keys[0] == keys[1]).any()
    assert n > 50 and hit / n >= 0.95


def test_split_buckets_stay_together():
    """Lines that share a band key still share one, or reach one another by way of the bucket's smallest line."""
    draw = np.random.default_rng(0)
    h = draw.integers(-(1 << 62), 1 << 62, 300)
    keys = draw.integers(0, 1 << 63, (300, 4)).astype(np.uint64)
    keys[:200, 1] = keys[0, 1]
    keys[250:260, 2] = keys[250, 2]
    parts = [set(x) for x in line_dedup.split(h, keys, 16).to_pylist()]
    least = int(np.argmin(h[:200]))
    assert all(parts[k] & parts[least] for k in range(200)) and len(parts[least]) == 5 and all(len(p) == 4 for k, p in enumerate(parts) if k != least)
    assert len({x for p in parts[:200] for x in p if (x ^ int(keys[0, 1].astype(np.int64))) & ~line_dedup.PART == 0}) == 2
    assert set.intersection(*parts[250:260]) and not parts[250] & parts[0]


def agrees(spark, rows):
    texts = {i: t for i, t, _, _ in rows}
    found = {(r.doc, texts[r.doc], r.line_no) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    want = brute(rows)
    return len(want) > 40 and len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.03 * len(want)


def test_hot_buckets_against_all_pairs(spark, monkeypatch):
    """Buckets split from two lines on, and tasks that forget at once: the same as brute force."""
    made = line_dedup.split
    monkeypatch.setattr(line_dedup, "split", lambda h, keys: made(h, keys, 2))
    monkeypatch.setattr(line_dedup, "MET", 3)
    assert agrees(spark, corpus())


def test_lines_that_share_one_hash_only(spark, monkeypatch):
    """A collision of the first 64 bits deletes no unequal line."""
    made = line_dedup.digests

    def collide(lines):
        out = made(lines).copy()
        out[[k for k, x in enumerate(lines) if x.startswith("same ")], 0] = 77
        return out

    monkeypatch.setattr(line_dedup, "digests", collide)
    docs = frame(spark, [(1, "same first line of these words", "en", "s"), (2, "same quite another text, unlike it", "en", "s"), (3, "same first line of these words", "en", "s")])
    assert [(r.doc, r.line_no) for r in line_dedup.removed_lines(docs).collect()] == [(3, 0)]


def test_against_all_pairs(spark):
    assert agrees(spark, corpus())


def test_removal(spark):
    docs = frame(spark, [*AWKWARD, (1, "alpha beta gamma delta\nunique words of one\nalpha beta gamma delta", "en", "s"), (2, "alpha beta gamma delta!\nsecond", "en", "s"), (3, "Alpha Beta Gamma Delta", "en", "s"), (4, "***\n\nsecond", "en", "s")])
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.where("doc_id < 100").collect()}
    assert texts[1] == ("alpha beta gamma delta\nunique words of one", 42)
    assert texts[2] == ("second", 6) and 3 not in texts and 4 not in texts
    rest = {r.doc_id: r.text for r in out.where("doc_id is null or doc_id >= 900").collect()}
    assert {None, 900, 901, 902, 903, 908, 909, 910} <= set(rest) and rest[908] == AWKWARD[11][1]
    assert out.where("doc_id = 905").count() in (1, 2)
    assert line_dedup.drop_lines(empty(spark)).count() == 0


def test_buckets_travel_packed(spark):
    """A range of bucket keys is one row of a piece, and its buckets give the pairs that grouping by key gives."""
    rows = corpus() + [(100 + i, "\n".join(prose(5000 + 40 * i + k, 9) for k in range(40)), "en", "s") for i in range(40)]
    sent = line_dedup.sketches(frame(spark, rows).coalesce(1))
    made = [(int(k), int(h)) for r in sent.collect() for k, h in zip(np.frombuffer(r.k, np.int64), np.frombuffer(r.h, np.int64))]
    assert len(made) > 20_000 and sent.count() <= 1 << line_dedup.RANGE_BITS
    buckets = {}
    for k, h in made:
        buckets.setdefault(k, set()).add(h)
    want = {(k, h, min(own)) for k, own in buckets.items() for h in own if h != min(own)}
    assert want and {tuple(r) for r in line_dedup.starred(sent.repartition(3)).collect()} == want


def test_bound_on_similarity_loses_no_pair():
    """The shingles that only one line of a pair has are never fewer than the bound says."""
    lines = [prose(k, 1 + 3 * k) for k in range(30)] + [prose(7, 21) + " zz", "ä" * 3, "x" * 5000]
    items, starts = line_dedup.sets(lines)
    own = [set(items[i:j].tolist()) for i, j in zip(starts, starts[1:])]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
    assert (line_dedup.apart(a, b, items, starts) <= [len(own[i] ^ own[j]) for i, j in zip(a, b)]).all()
