import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import decontaminate, shared

from .helpers import AWKWARD, empty, frame, prose


def brute(text, items, length=8, shortest=4):
    """Spans by looking for every phrase at every word."""
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text or "")]
    phrases = set()
    for item in items:
        w = [x.lower() for x in re.findall(r"\w+", item or "")]
        if len(w) >= shortest:
            k = min(length, len(w))
            phrases |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    hit = [False] * len(words)
    for k in {len(p) for p in phrases}:
        for i in range(len(words) - k + 1):
            if tuple(w for w, _, _ in words[i : i + k]) in phrases:
                hit[i : i + k] = [True] * k
    out = []
    for i, (_, a, b) in enumerate(words):
        if hit[i] and i and hit[i - 1]:
            out[-1] = (out[-1][0], b)
        elif hit[i]:
            out.append((a, b))
    return out


def bench(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")


ITEMS = [prose(1, 30), prose(2, 12), "four words are enough", "too short here", "", None, "a a a a a a a a a", prose(1, 30)]


def test_against_brute_force(spark):
    rows = [(i, f"{prose(50 + i, 20)}. {' '.join(ITEMS[i % 2].split()[i % 5 : i % 5 + 4 + i])}! {prose(90 + i, 15)}", "en", "s") for i in range(16)]
    rows += [(40, "Four, WORDS\nare -- enough", "en", "s"), (41, "too short here", "en", "s"), (42, "b " + "a " * 30, "en", "s"), (43, ITEMS[0] + " " + ITEMS[1], "en", "s"), (44, prose(7, 50_000) + " four words are enough " + prose(8, 50_000), "en", "s"), (None, ITEMS[0], "en", "s"), (45, ITEMS[0], "en", "s"), (45, ITEMS[0], "en", "s")]
    docs = frame(spark, [*AWKWARD, *rows])
    found = decontaminate.leaks(docs, bench(spark, ITEMS)).collect()
    got = sorted((str(r.doc_id), [(s.start, s.end) for s in r.spans], r.clean_text) for r in found)
    want = sorted((str(i), s, decontaminate.without(t, s)) for i, t, _, _ in [*AWKWARD, *rows] if (s := brute(t, ITEMS)))
    assert got == want and len(want) > 10


def test_benchmark_in_slices_gives_the_same(spark, monkeypatch):
    docs = frame(spark, [(i, f"{prose(i, 5)} {t}", "en", "s") for i, t in enumerate(ITEMS)])
    whole = decontaminate.leaks(docs, bench(spark, ITEMS)).collect()
    monkeypatch.setattr(decontaminate, "SLICE", 10)
    assert sorted(decontaminate.leaks(docs, bench(spark, ITEMS)).collect()) == sorted(whole)


def test_removal_keeps_everything_else(spark):
    docs = frame(spark, [*AWKWARD, (1, f"before {ITEMS[0]} after", "en", "s"), (2, ITEMS[0], "en", "s"), (3, "clean", "en", "s")])
    out = decontaminate.remove_leaks(docs, bench(spark, ITEMS))
    assert out.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.where("doc_id < 100").collect()}
    assert texts == {1: ("before  after", 13), 3: ("clean", 5)}
    assert out.where("doc_id is null or doc_id >= 900").count() == len(AWKWARD)
    assert decontaminate.remove_leaks(docs, bench(spark, [])).count() == docs.count()
    assert decontaminate.leaks(empty(spark), bench(spark, ITEMS)).count() == 0


def test_benchmark_passages_in_the_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in decontaminate.query(spark, small).collect()}
    assert found == {d.doc_id: s for d in docs if (s := brute(d.text, items))}


def test_rest_in_any_script_stays(spark):
    rests = ["чистый текст", "καθαρό κείμενο", "نص نظيف", "干净的文字", "٣٤", "clean"]
    docs = frame(spark, [*[(i, f"{t} {ITEMS[0]}", "xx", "s") for i, t in enumerate(rests)], (50, f"… {ITEMS[0]} — _", "xx", "s")])
    assert {r.doc_id: r.text.strip() for r in decontaminate.remove_leaks(docs, bench(spark, ITEMS)).collect()} == dict(enumerate(rests))


def test_phrases_are_narrowed_to_the_words_of_the_shard():
    """Only phrases all of whose words occur are searched, each once."""
    import numpy as np

    items = ["one two three four five", "five four three two", "one two three four five", "a b"]
    p = decontaminate.Phrases(items, 4, 3)
    every = p.among(np.ones(len(p.vocabulary) + 2, dtype=bool))
    assert {k: len(v) for k, v in every.items()} == {4: 3} and p.shortest == 4
    some = np.ones(len(p.vocabulary) + 2, dtype=bool)
    some[every[4][0][0]] = False
    assert sum(map(len, p.among(some).values())) == sum(every[4][0][0] not in row for row in every[4])
    assert decontaminate.Phrases([None, "", "x y"]).among(np.ones(2, dtype=bool)) == {}


def test_batches_are_bounded_by_bytes(spark):
    """Long documents reach a worker in batches of a few MB, whichever way they go; a size that the session sets is kept."""
    docs = frame(spark, [(i, "word " * 20_000, "en", "s") for i in range(120)]).coalesce(1)
    before = spark.conf.get(shared.BATCH_SETTING, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    @F.arrow_udf("long")
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([batch.nbytes] * len(batch), type=pa.int64())

    try:
        spark.conf.unset(shared.BATCH_SETTING)
        decontaminate.remove_leaks(docs, docs.limit(1))
        mapped, scored = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()], [r.n for r in docs.select(size("text").alias("n")).collect()]
        assert sum(mapped) > 12_000_000 and max(mapped + scored) <= shared.BATCH + 300_000
        spark.conf.set(shared.BATCH_SETTING, "7000000")
        decontaminate.remove_leaks(docs, docs.limit(1))
        assert spark.conf.get(shared.BATCH_SETTING) == "7000000"
    finally:
        spark.conf.unset(shared.BATCH_SETTING)
        if before is not None:
            spark.conf.set(shared.BATCH_SETTING, before)


def test_memory_of_a_shard_is_bounded_by_its_words():
    import tracemalloc
    from types import SimpleNamespace

    texts = [prose(k, 1000) for k in range(100)] * 4 + [f"before {ITEMS[2]} after"]
    sent = [SimpleNamespace(value=decontaminate.Phrases([ITEMS[2]]))]
    decontaminate.spans(sent, texts)  # the tables of the characters are made once
    tracemalloc.start()
    try:
        found = decontaminate.spans(sent, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [k for k, s in enumerate(found) if s] == [400] and found[400] == [(7, 7 + len(ITEMS[2]))]
    assert peak < 64 * 400_000, peak
