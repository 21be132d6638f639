import numpy as np

from brindle.llm import toxicity

from .helpers import AWKWARD, empty, frame, prose


def test_score_is_the_sum_over_all_pairs():
    draw = np.random.default_rng(0)
    m = toxicity.FactorizationMachine(np.arange(6))
    m.bias, m.w, m.v = 0.3, draw.normal(size=6), draw.normal(size=(6, 4))
    x = draw.normal(size=6)
    plain = m.bias + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert np.isclose(m.raw(np.zeros(6, dtype=int), np.arange(6), x, 1)[0][0], plain)


def test_learns_a_pair_that_no_additive_weights_can():
    """Toxic is who uses exactly one of two words: no sum of weights tells that."""
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 2, 4000), draw.integers(0, 2, 4000)
    m = toxicity.FactorizationMachine(np.arange(2), seed=3)
    m.v *= 20
    row = np.repeat(np.arange(4000), a + b)
    col = np.concatenate([[k for k, on in enumerate(p) if on] for p in zip(a, b)]).astype(int)
    m.fit(row, col, np.ones(len(row)), (a ^ b).astype(float), epochs=30)
    score = m.raw(row, col, np.ones(len(row)), 4000)[0]
    assert ((score > 0) == (a ^ b)).mean() > 0.95


def test_insult_with_group_mention():
    words = [prose(i, 30) for i in range(900)]
    kind = np.arange(900) % 3  # insult and group, insult alone, group alone
    texts = [w + (" dolt" if k != 2 else "") + (" martians" if k != 1 else "") for w, k in zip(words, kind)]
    row, bucket, count = toxicity.terms(texts)
    m = toxicity.fitted(row, bucket, count, (kind == 0).astype(float))
    assert min(m.score(["dolt martians here"])[0], 1 - m.score(["dolt here"])[0], 1 - m.score(["martians here"])[0]) > 0.5


def test_pure_pair_by_production_parameters(spark):
    """Toxic is who uses exactly one of two words, each as frequent in either class: none tells anything by itself."""
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 2, 2400), draw.integers(0, 2, 2400)
    texts = [prose(i, 25) + " zork" * x + " grunk" * y for i, (x, y) in enumerate(zip(a, b))]
    row, bucket, count = toxicity.terms(texts[:1600])
    m = toxicity.fitted(row, bucket, count, (a ^ b)[:1600].astype(float))
    assert (((m.score(texts[1600:]) > 0.5) == (a ^ b)[1600:]).mean()) > 0.9
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(a[i] ^ b[i])) for i in range(1600)], "doc_id long, toxic int")
    found = {r.doc_id for r in toxicity.toxic(docs, labels).collect() if r.doc_id >= 1600}
    want = {i for i in range(1600, 2400) if a[i] ^ b[i]}
    assert len(found & want) >= 0.8 * len(want) and len(found - want) <= 0.05 * len(found)


def test_held_out(spark, small):
    big = small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    found = {r.doc_id for r in toxicity.toxic(docs, labels.where("doc_id % 2 = 0")).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([r.doc_id in found for r in rest if r.toxic == 1]) >= 0.8
    assert np.mean([r.doc_id in found for r in rest if r.toxic == 0]) <= 0.02


def test_frame(spark):
    rows = [(i, prose(i, 60) + (" zork grunk" if i % 4 == 0 else ""), "en", "s") for i in range(200)]
    docs = frame(spark, [*AWKWARD, *rows, (500, "zork grunk and so on", "en", "s"), (500, "zork grunk and so on", "en", "s"), (None, "zork grunk", "en", "s")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None), (8888, 1), (4, 0)], "doc_id long, toxic int")
    found = [r.doc_id for r in toxicity.toxic(docs, labels).collect()]
    assert set(found) - {908} == {None, 500, *range(0, 200, 4)} and found.count(500) == 2  # 908 holds so many words that it may go either way
    assert toxicity.toxic(empty(spark), labels).count() == 0
    assert toxicity.toxic(docs, labels.where("toxic = 0")).count() == 0
