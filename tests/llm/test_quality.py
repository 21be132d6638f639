import numpy as np

from brindle.llm import quality

from .helpers import AWKWARD, empty, frame, prose


def test_statistics_against_plain_python():
    text = "One two two. THREE 44 ###\nOne two two. THREE 44 ###\nlonger words here!"
    s = dict(zip((*quality.STATISTICS, "n"), quality.statistics(["", text, "!!"])[1]))
    words = ["one", "two", "two", "three", "44"] * 2 + ["longer", "words", "here"]
    assert s["n"] == len(words) and np.isclose(s["word_length"], np.mean([len(w) for w in words]))
    assert np.isclose(s["repeated_words"], 2 / 13) and np.isclose(s["repeated_lines"], 1 / 3) and np.isclose(s["closed_lines"], 1 / 3)
    assert np.isclose(s["symbols"], 7 / len(text)) and np.isclose(s["digits"], 4 / len(text)) and np.isclose(s["capitals"], 12 / sum(c.isalpha() for c in text))
    assert np.isclose(s["repeated_phrases"], 1 / 9) and np.isclose(s["top_word"], 4 / 13)
    assert np.isnan(quality.statistics(["", "!!"])).all()


def test_paths_are_those_of_the_trees():
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(500, 3))
    forest = quality.IsolationForest(rows, trees=10, sample=64)

    def walk(tree, x):
        what, value, child, path = tree
        at = 0
        while what[at] >= 0:
            at = child[at] + (x[what[at]] >= value[at])
        return path[at]

    assert np.allclose(forest.path_lengths(rows[:50]), [np.mean([walk(t, x) for t in forest.trees]) for x in rows[:50]])
    assert forest.score(np.array([[9.0, 9, 9]]))[0] > forest.score(np.zeros((1, 3)))[0]


def test_held_out(spark, small):
    """Fitted and calibrated on half of the labelled documents, the other half is told apart."""
    labels = spark.read.parquet(f"{small.replace('0.001', '0.1')}/labels.parquet")
    docs = spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet")
    kept = {r.doc_id for r in quality.keep(docs, labels.where("doc_id % 2 = 0")).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    good, bad = [r.doc_id in kept for r in rest if r.quality == 1], [r.doc_id in kept for r in rest if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def test_frame(spark):
    rows = [(i, prose(i, 80), "en", "s") for i in range(200)] + [(300 + i, "### " * 60 + prose(i, 50), "en", "s") for i in range(10)]
    docs = frame(spark, [*AWKWARD, *rows])
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(300 + i, 0) for i in range(5)] + [(300, 1), (None, 1), (1, None), (7777, 1)], "doc_id long, quality int")
    found = [r.doc_id for r in quality.keep(docs, labels).collect()]
    assert len(set(range(200)) & set(found)) >= 190 and not {*range(300, 310), 900, 901, 902, 903} & set(found)
    assert found.count(905) in (0, 2)
    assert quality.keep(empty(spark), labels).count() == 0
    unlabelled = quality.keep(docs, labels.where("false")).collect()
    assert all(r.score is None for r in unlabelled) and len(unlabelled) == docs.where("text rlike '\\\\w'").count()


def test_what_is_kept_against_plain_python(spark):
    """The whole of it: statistics, trees walked one by one, the limit with the best F1 over all bins, the documents below it."""
    rows = [(i, prose(i, 30 + i % 40), "en", "s") for i in range(120)] + [(300 + i, "### 12 " * (5 + i) + prose(i, 20), "en", "s") for i in range(12)] + [(500, "", "en", "s")]
    docs = frame(spark, rows)
    marks = [(i, 1) for i in range(100)] + [(300 + i, 0) for i in range(8)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.keep(docs, labels).collect()}

    usual, forest = quality.grow(quality.described(docs), quality.labelled(labels))
    scores = {}
    for i, text, _, _ in rows:
        stats = quality.statistics([text])[0].astype(np.float32).astype(float)
        if np.isnan(stats).any():
            continue
        x = [u + (s - u) * stats[-1] / (stats[-1] + quality.PRIOR_WORDS) for u, s in zip(usual, stats)]
        depth = 0.0
        for what, value, child, path in forest.trees:
            at = 0
            while what[at] >= 0:
                at = child[at] + (x[what[at]] >= value[at])
            depth += path[at]
        scores[i] = 2 ** (-depth / len(forest.trees) / forest.normal)
    bad = {i for i, good in marks if not good}
    bins = sorted({int(scores[i] * quality.BINS) for i, _ in marks}, reverse=True)
    best = (0.0, None)
    for k, b in enumerate(bins):
        above = [i for i, _ in marks if int(scores[i] * quality.BINS) >= b]
        f1 = 2 * len(bad & set(above)) / (len(bad) + len(above))
        if f1 > best[0]:
            best = f1, (b + bins[k + 1] + 1) / 2 / quality.BINS if k + 1 < len(bins) else b / quality.BINS
    want = {i: s for i, s in scores.items() if s < best[1]}
    assert set(found) == set(want) and 100 <= len(want) < len(scores) and np.allclose([found[i] for i in want], list(want.values()))
