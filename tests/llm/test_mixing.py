import re
from collections import Counter

import duckdb
import pytest

from brindle.llm import mixing

from .helpers import AWKWARD, empty, frame, prose


def test_quotas_are_sainte_lague():
    """A shard's blocks by hand: seats go to the highest quotients."""
    blocks, weights, seats = {"a": 5, "b": 3, "c": 9}, {"a": 2.0, "b": 3.0, "c": 0.5}, 8
    got = Counter()
    for _ in range(seats):
        s = max((s for s in blocks if got[s] < blocks[s]), key=lambda s: (weights[s] / (2 * got[s] + 1), [-ord(c) for c in s]))
        got[s] += 1
    assert got == {"a": 4, "b": 3, "c": 1}


def test_shares_follow_weights(spark):
    docs = frame(spark, [(i, prose(i, 100), "en", f"src{i % 3}") for i in range(300)])
    parts = mixing.slices(docs, {"src0": 1.0, "src1": 2.0, "src2": 1.0}, block=50, budget=0.4, shard_tokens=10**6).collect()
    quota = Counter(s for s, _ in {(r.source, r.block) for r in parts})
    assert quota == {"src0": 60, "src1": 120, "src2": 60}
    assert sum(r.last_token - r.first_token + 1 for r in parts) == 240 * 50


def test_text_is_the_slice(spark):
    rows = [(i, prose(i, 37 + i), "en", f"src{i % 4}") for i in range(80)]
    by = {i: re.findall(r"[^ \t\n\r]+", t) for i, t, _, _ in rows}
    found = mixing.mixed(frame(spark, rows), block=16, shard_tokens=900).collect()
    assert len({r.shard for r in found}) > 1
    for r in found:
        assert r.text == " ".join(by[r.doc_id][r.first_token - 1 : r.last_token]) and r.n_tokens == r.last_token - r.first_token + 1
    seen = [(r.doc_id, t) for r in found for t in range(r.first_token, r.last_token + 1)]
    assert len(seen) == len(set(seen))


def test_sql_gives_the_same(spark, tmp_path):
    rows = [*AWKWARD[:11], *[(i, prose(i, 30 + 7 * (i % 50)), "en", None if i == 7 else f"src{i % 5}") for i in range(400)], (3, prose(3, 500), "en", "src3"), (3, prose(3, 500), "en", "src3")]
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows if t is None or "\0" not in t], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    for parameters in ({}, {"block": 16, "shard_tokens": 5000}, {"block": 7, "budget": 1.0, "shard_tokens": 20_000, "seed": 3}):
        mine = mixing.mixed(spark.read.parquet(str(tmp_path / "documents.parquet")), **parameters)
        theirs = con.execute(mixing.sql(**parameters))
        names = [x[0] for x in theirs.description]
        assert sorted(map(str, map(tuple, mine.select(*names).collect()))) == sorted(map(str, theirs.fetchall()))


def test_frame(spark):
    docs = frame(spark, AWKWARD)
    found = mixing.mixed(docs, budget=1.0)
    assert {r.doc_id for r in found.collect()} == {903, 905, 906, 907, 908, 909}
    assert "label" in found.columns and [c.lower() for c in found.columns].count("shard") == 1
    assert mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixed(docs, budget=0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.slices(docs, block=0)


def test_long_texts_take_time_in_proportion(spark):
    """Twice the tokens: no more than about twice the time, since a text is cut into tokens once."""
    import time

    took = []
    for n in (20_000, 160_000, 320_000):
        docs = spark.range(1).selectExpr("1L as doc_id", f"repeat('word ', {n}) as text", "'src1' as source").checkpoint()
        began = time.perf_counter()
        rows = mixing.mixed(docs, budget=1.0).agg({"n_tokens": "sum", "block": "count"}).first()
        took.append(time.perf_counter() - began)
        assert rows["sum(n_tokens)"] == n
    assert took[2] < 3 * took[1] + 2
