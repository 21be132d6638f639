"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import itertools
import random

import duckdb
import pytest

import corpus_pipeline
from brindle.llm import lang_id, near_dup, mixing

from .helpers import prose
from .test_decontaminate import brute as leaked
from .test_line_dedup import brute as duplicate_lines
from .test_near_dup import edited, jaccard, weights

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    draw = random.Random(0)
    items = [prose(700 + k, 20) for k in range(5)]
    rows = []
    for i in range(120):
        text = prose(i, 40 + i) if i % 6 else edited(prose(i - 6 if i % 12 else i, 90), i, 0.03)
        lines = [" ".join(text.split()[k : k + 15]) for k in range(0, len(text.split()), 15)]
        if i % 5 == 0:
            lines.insert(1, "all rights reserved by the people who wrote this page")
        if i % 7 == 0:
            lines.append(" ".join(draw.choice(items).split()[3:15]) + " and more of it")
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
    rows += [(200, None, "en", "src1", None), (201, "", "en", "src1", 0), (202, "ΩΨ ЖЩ " * 30, None, "src1", 180), (None, prose(900, 30), "en", "src2", 0), (5, rows[5][1], "en", "src2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    key = lambda r: (str(r.doc_id), r.text)

    # language: the models and limits, document by document
    stage = corpus_pipeline.language(spark, docs, folder)
    assert stage.columns == COLUMNS
    models = lang_id.train(docs)
    scores = models.score([r.text for r in docs.collect()])
    own = sorted((e, m) for r, a, e, m in zip(docs.collect(), *scores.values()) if a is not None and a == r.lang)
    most, least = own[-1][0], min(m for _, m in own)
    kept = [r for r, a, e, m in zip(docs.collect(), *scores.values()) if a is not None and e <= most and m >= least]
    assert sorted(map(key, stage.collect())) == sorted(map(key, kept)) and 0 < len(kept) < docs.count()

    # lines
    before = stage.collect()
    stage = spark.createDataFrame(corpus_pipeline.lines(spark, stage, folder).collect(), docs.schema)
    gone = duplicate_lines([(r.doc_id, r.text, None, None) for r in before])
    want = []
    for r in before:
        left = [x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, r.text, k) not in gone]
        if r.doc_id is None or any(c.isalnum() for x in left for c in x):
            want.append((str(r.doc_id), "\n".join(left)))
    got = sorted(map(key, stage.collect()))
    assert len(set(got) & set(want)) >= 0.95 * len(want) and abs(len(got) - len(want)) <= 2 and gone

    # near-duplicates: exactly one of each group
    before = {r.doc_id: weights(r.text) for r in stage.where("doc_id is not null").collect()}
    stage = spark.createDataFrame(corpus_pipeline.near_duplicates(spark, stage, folder).collect(), docs.schema)
    root = {i: i for i in before}
    for a, b in itertools.combinations(sorted(before), 2):
        if before[a] and before[b] and jaccard(before[a], before[b]) >= near_dup.THRESHOLD:
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert {r.doc_id for r in stage.where("doc_id is not null").collect()} == set(root.values())

    # benchmark
    before = stage.collect()
    stage = spark.createDataFrame(corpus_pipeline.decontamination(spark, stage, folder).collect(), docs.schema)
    want = []
    for r in before:
        text, cuts = r.text, leaked(r.text, items)
        for a, b in reversed(cuts):
            text = text[:a] + text[b:]
        if not cuts or any(c.isalnum() for c in text):
            want.append((str(r.doc_id), text))
    assert sorted(map(key, stage.collect())) == sorted(want) and any(leaked(r.text, items) for r in before)

    # mixture, by SQL
    stage.write.mode("overwrite").parquet(f"{folder}/left.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{folder}/left.parquet/*.parquet'")
    theirs = con.execute(mixing.sql())
    names = [x[0] for x in theirs.description]
    want = sorted(map(str, theirs.fetchall()))
    assert sorted(map(str, map(tuple, corpus_pipeline.mixture(spark, stage, folder).select(*names).collect()))) == want
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, folder).select(*names).collect()))) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_are_carried(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    spark.read.parquet(f"{folder}/documents.parquet").withColumns({"id": F.lit("x"), "h": F.col("doc_id"), "node": F.lit(1.5), "block": F.lit("b")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"id", "h", "node", "block"} <= set(out.columns) and out.where("id = 'x' and h = doc_id").count() == out.count() > 0
