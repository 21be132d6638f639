import itertools
import random
import re
from collections import Counter

import numpy as np

from brindle.llm import near_dup

from .helpers import AWKWARD, empty, frame, prose


def weights(text, size=3):
    w = [x.lower() for x in re.findall(r"\w+", text or "")]
    return Counter(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else Counter()


def jaccard(x, y):
    """Straight from the definition."""
    items = set(x) | set(y)
    total = 0.0
    for d in set(x) & set(y):
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in items)
    return total


def edited(text, seed, share):
    draw = random.Random(seed)
    return " ".join(f"new{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split())


def test_probability_jaccard():
    draw = random.Random(0)
    for _ in range(30):
        x = {k: draw.randint(1, 4) for k in draw.sample(range(12), draw.randint(1, 9))}
        y = {k: draw.randint(1, 4) for k in draw.sample(range(12), draw.randint(1, 9))}
        arrays = [(np.array(sorted(z), dtype=np.uint64), np.array([z[k] for k in sorted(z)])) for z in (x, y)]
        assert np.isclose(near_dup.probability_jaccard(*arrays), jaccard(x, y))


def test_signatures_estimate_it():
    """Early termination or not, registers agree with the probability that the definition gives."""
    a, b = prose(1, 300), edited(prose(1, 300), 2, 0.05)
    doc, item, weight = near_dup.weighted([a, b])
    s = near_dup.probminhash(doc, item, weight, 2, registers=8192)
    assert abs((s[0] == s[1]).mean() - jaccard(weights(a), weights(b))) < 0.03


def test_groups_against_all_pairs(spark):
    rows = []
    for g in range(12):
        base = prose(g, 60 + 40 * g)
        rows += [(100 * g + k, base if k == 0 else edited(base, k, 0.02 * k), "en", "s") for k in range(5)]
    rows += [(5000 + i, "copied all over the place " * 3, "en", "s") for i in range(60)] + [(6000, "Copied, ALL over: the place " * 3, "en", "s")]
    sets = {i: weights(t) for i, t, _, _ in rows}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= near_dup.THRESHOLD}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {i: find(i) for i in sets if find(i) != i}
    found = {r.doc_id: r.kept_doc_id for r in near_dup.groups(frame(spark, rows)).collect()}
    together = lambda of: {(a, b) for a, b in pairs if of.get(a, a) == of.get(b, b)}
    assert len(together(found)) >= 0.97 * len(pairs) and set(found) <= set(want)
    assert all(find(k) == find(v) for k, v in found.items())


def test_frame(spark):
    docs = frame(spark, [*AWKWARD, (1, "tiny", "en", "s"), (2, "Tiny!", "en", "s"), (3, "tiny one", "en", "s"), (None, "tiny", "en", "s")])
    found = {r.doc_id: r.kept_doc_id for r in near_dup.groups(docs).collect()}
    assert found[2] == 1 and not {3, 900, 901, 902, 903, None} & set(found)
    kept = near_dup.keep_one(docs)
    # one of the repeated rows of 905 stays
    assert kept.columns == docs.columns and kept.count() == docs.count() - docs.where(docs.doc_id.isin(list(found))).count() - 1
    assert kept.where("doc_id = 905").count() == 1 and kept.where("doc_id = 906").count() == 2
    assert near_dup.groups(empty(spark)).count() == 0 and near_dup.keep_one(empty(spark)).count() == 0


def test_texts_that_share_an_id(spark):
    """(5, A), (6, A), (6, B): A stays once, and so does B. Of rows that repeat a document the least one stays."""
    a, b, c, d = (prose(k, 200) for k in range(1, 5))
    rows = [(5, a, "en", "s"), (6, a, "en", "s"), (6, b, "en", "s"), (7, c, "en", "t"), (7, edited(c, 1, 0.02), "en", "s"), (8, b, "en", "s"), (8, b, "en", "r"), (8, b, "en", "s")]
    docs = frame(spark, [*rows, (9, d, "en", "s"), (9, d, "en", "r"), (9, d, "en", "s"), (None, d, "en", "s"), (None, d, "en", "s")])
    assert sorted(map(tuple, near_dup.groups(docs).collect())) == [(6, 5), (7, 7), (8, 6)]
    kept = near_dup.keep_one(docs).collect()
    assert sorted((str(r.doc_id), [a, b, c, d].index(r.text) if r.text in (a, b, d) else 2, r.source) for r in kept) == [("5", 0, "s"), ("6", 1, "s"), ("7", 2, next(r.source for r in kept if r.doc_id == 7)), ("9", 3, "r"), ("None", 3, "s"), ("None", 3, "s")]


def test_checkpoints_of_rounds_are_deleted(spark):
    """A chain takes many rounds; only the last one's files are left."""
    import glob

    from brindle.llm.components import components
    from brindle.llm.shared import checkpoint_folder

    count = lambda: len(glob.glob(f"{checkpoint_folder(spark)}/*/rdd-*"))
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").repartition(40)
    before = count()
    found = components(edges)
    assert {r.root for r in found.collect()} == {0} and count() - before <= 1


def test_components_are_searched_by_one_worker(spark, monkeypatch):
    """Both times the edges come from files: a task that also compares the texts would need a second worker, which lives on beside the first."""
    plans = []
    found = near_dup.components
    monkeypatch.setattr(near_dup, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or found(edges))
    rows = [(10 * g + k, edited(prose(g, 200), k, 0.02), "en", "s") for g in range(5) for k in range(6)]
    assert near_dup.groups(frame(spark, rows), threshold=0.99).count() == 0
    assert len(plans) == 2 and not any("MapInArrow" in x for x in plans)
