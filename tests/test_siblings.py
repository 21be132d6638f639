import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import documents, expressions
from brindle.operators import join_orders, stores


def test_expression_values():
    cases = {"1 + 1": 2, "1 + -1": 0, "2 * 3 - 4 / 3": 5, "-7 / 2": -3, "-(3 - 5) * -2": -4, "((4))": 4, "10 - 4 - 3": 3, "100 / 5 / 2": 10, "--3": 3, " 8 ": 8}
    assert {k: expressions.evaluate(k) for k in cases} == cases
    for bad in ("", None, "1 +", "(1", "1)", "1 2", "* 3", "1 / 0", "9223372036854775807 + 1", "a + 1", "()", "1 (2)"):
        assert expressions.evaluate(bad) is None, bad
    assert expressions.evaluate("(" * 20_000 + "1" + ")" * 20_000) == 1
    assert expressions.evaluate("-".join(["1"] * 50_000)) == 2 - 50_000


def truncating(text):
    """Python's own parser, with division cut towards zero."""

    class I(int):
        def __add__(self, o): return I(int(self) + int(o))  # noqa: E704
        def __sub__(self, o): return I(int(self) - int(o))  # noqa: E704
        def __mul__(self, o): return I(int(self) * int(o))  # noqa: E704
        def __neg__(self): return I(-int(self))  # noqa: E704
        def __truediv__(self, o): return I(abs(int(self)) // abs(int(o)) * (1 if (self < 0) == (o < 0) else -1))  # noqa: E704

    import re

    return int(eval(re.sub(r"\d+", lambda m: f"I({m[0]})", text), {"I": I}))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 10**6))
def test_generated_expressions(n, seed):
    text = expressions.generated(n, seed)
    assert expressions.evaluate(text) == truncating(text)


def test_expressions_in_columns(monkeypatch):
    """Texts of a shape that many have are worked off in columns, with the values of `evaluate`, and the shape is read once."""
    import re

    import pyarrow as pa

    draw = random.Random(0)
    numbers = [0, 1, 2, 7, 46341, 3037000499, 3037000500, 1 << 62, (1 << 63) - 1, 1 << 63, 10**18 - 1, 10**18, 10**20]
    forms = ["-# * (# - #) / (-#) + # / # * 2", "#", "-#", "#*#", "-#/-#", "# - # - #", "--# + #", "-(#*#)/#", "(#", "# #", "", "a#", "#.#", " # \n", "\x1c#+#", "\u0663+#", "é#", "00#"]
    texts = [re.sub("#", lambda _: str(draw.choice([*numbers, draw.randint(0, 10**6)])), draw.choice(forms)) for _ in range(3000)]
    texts[5::50] = [None] * len(texts[5::50])
    want = [expressions.evaluate(x) for x in texts]
    assert sum(x is not None for x in want) > 1000
    for limit in (expressions.SLICE, 300, 1):
        monkeypatch.setattr(expressions, "SLICE", limit)
        assert expressions.evaluate_all(pa.array(texts, pa.string())).to_pylist() == want
        assert expressions.evaluate_all(pa.array(texts, pa.string())[7:2000]).to_pylist() == want[7:2000]
    monkeypatch.undo()
    assert expressions.evaluate_all(pa.array([], pa.string())).to_pylist() == [] and expressions.evaluate_all(pa.array([None] * 20, pa.string())).null_count == 20
    read = []
    postfix = expressions.postfix
    monkeypatch.setattr(expressions, "postfix", lambda text: read.append(text) or postfix(text))
    assert expressions.evaluate_all(pa.array([f"{i} + {i * i}" for i in range(1000)])).to_pylist() == [i + i * i for i in range(1000)]
    assert read == ["0 + 0"]


def test_chunks(spark):
    lines = ["abcd1234x", "abcd", "abcde", "", "12345678", "é bcd5"]
    expected: dict = {}
    for line in lines:
        plain = "".join("0" if "0" <= c <= "9" else c for c in line)
        for i in range(0, len(plain) - 4, 4):
            expected[plain[i : i + 4]] = expected.get(plain[i : i + 4], 0) + 1
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "text string")
    assert {r.chunk: r.n for r in expressions.chunk_counts(df).collect()} == expected


def test_legal_words(spark):
    follow = {" ": "(*+-/0", "(": "(-0", ")": " )", "*": " ", "+": " ", "/": " ", "-": " 0", "0": " )0"}
    words = [""]
    for _ in range(4):
        words = [w + c for w in words for c in (follow[w[-1]] if w else " ()*+-/0") if not any((w + c).endswith(b) for b in expressions.forbidden())]
    assert sorted(r.word for r in expressions.legal_words(spark, 4).collect()) == sorted(words)


def test_store_and_directories(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, t string")
    store = stores.put_files(files, "k", "t")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert {r.id: (r.data, r.first_key, r.n_puts) for r in store.collect()} == {sha(b"a"): ("a", 1, 2), sha(b"b"): ("b", 2, 1)}
    entries = spark.createDataFrame([("d", "y", sha(b"a")), ("d", "x", sha(b"b")), ("e", "x", sha(b"nowhere"))], "dir string, name string, child string")
    put, missing = stores.put_directories(entries, store, ["dir"], "name", "child")
    assert put.collect() == [("d", sha(b"x" + bytes.fromhex(sha(b"b")) + b"y" + bytes.fromhex(sha(b"a"))))]
    assert [r.dir for r in missing.collect()] == ["e"]


def test_tables_of_contents_and_paths(spark):
    files = spark.createDataFrame([("a/x", "one", "r1"), ("b/x", "one", "r2"), ("c", "two", "r1"), ("d", None, "r1"), (None, "three", "r1")], "p string, t string, r string")
    contents, paths = stores.put_tables(files, "p", "t", "r")
    assert contents.count() == 2 and paths.count() == 3
    assert sorted(map(tuple, stores.look_up(contents, paths, ["b/x", "c"]).collect())) == [("b/x", "r2", "one"), ("c", "r1", "two")]
    with pytest.raises(KeyError, match="d"):
        stores.look_up(contents, paths, ["c", "d"])


def test_large_directories_are_hashed_as_they_pass(spark):
    """More entries than an Arrow batch holds, in one directory."""
    n = 25_000
    rows = spark.range(n).selectExpr("'d' as dir", "cast(id as string) as name", "sha2(cast(id as string), 256) as child")
    want = hashlib.sha256(b"".join(k.encode() + hashlib.sha256(k.encode()).digest() for k in sorted(map(str, range(n))))).hexdigest()
    assert stores.directory_ids(rows, ["dir"], "name", "child").collect() == [("d", want)]


def test_edges_of_predicates():
    columns = [["a", "b"], ["c"], ["d", "e"]]
    assert join_orders.edges_of(columns, ["a = c", "b + c < e", "a > 3", "d = e"]) == [({1}, {2}), ({1, 2}, {3})]


def test_merkle(spark):
    rows = [("p", "q", 1, "a"), ("p", "q", 10, "b"), ("p", "r", 2, "c"), ("s", "q", 3, "d")]
    found = {r.path: r.id for r in stores.merkle(spark.createDataFrame(rows, "x string, y string, k int, t string"), ["x", "y"], "k", "t").collect()}
    h = lambda b: hashlib.sha256(b).digest()
    d = lambda *e: h(b"".join(n.encode() + i for n, i in sorted(e)))
    pq, pr, sq = d(("1", h(b"a")), ("10", h(b"b"))), d(("2", h(b"c"))), d(("3", h(b"d")))
    p, s = d(("q", pq), ("r", pr)), d(("q", sq))
    assert found[""] == d(("p", p), ("s", s)).hex() and found["p"] == p.hex() and found["p/q"] == pq.hex() and found["s/q/3"] == h(b"d").hex() and len(found) == 10


def test_trees_and_aliases(spark):
    tree = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("1", "c", "2"), ("2", "d", "3")], "parent string, name string, child string")
    assert sorted(map(tuple, stores.materialise(tree, "r").collect())) == [("a", "1"), ("a/c", "2"), ("a/c/d", "3"), ("b", "2"), ("b/d", "3")]
    assert stores.materialise(tree, "nothing").count() == 0
    assert stores.get_file(tree, "r", "a/c/d").collect() == [("3",)] and stores.get_file(tree, "r", "a/x").count() == 0
    edges = spark.createDataFrame([("all", "x"), ("all", "y"), ("x", "f1"), ("x", "f2"), ("y", "f2")], "output string, input string")
    inputs = spark.createDataFrame([("t", "all"), ("u", "f9"), ("u", "y")], "target string, input string")
    assert sorted(map(tuple, stores.expand_aliases(inputs, edges).collect())) == [("t", "f1"), ("t", "f2"), ("u", "f2"), ("u", "f9")]
    with pytest.raises(ValueError):
        stores.expand_aliases(inputs, edges.union(spark.createDataFrame([("y", "all")], edges.schema)))


def test_html_tables(spark):
    html = "<table><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table><table><tbody><tr><td> 你 </td><td><b>nǐ</b></td><td>you &amp; me</td><td></td></tr><tr><td>a</td><td></td><td>c</td><td>d</td></tr><tr><td>a</td></tr><tr><td>x</td><td>y</td><td>z</td><td>HSK 1</td></tr></tbody></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "no table"), (4, "<table><tbody><tr><td>broken")], "page_id long, html string")
    assert sorted(map(tuple, documents.html_tables(df, "page_id", "html").collect())) == [("1", "x", "y", "z", "HSK 1"), ("1", "你", "nǐ", "you & me", "")]


def test_json_kinds(spark):
    df = spark.createDataFrame([('{"kind": "a", "x": [{"kind": "b"}, {"y": {}}]}',), ("[1, 2]",), ("broken",), (None,)], "t string")
    assert {r.kind: r.n for r in documents.kind_counts(df, "t").collect()} == {"a": 1, "b": 1, "unknown": 2}


def test_join_orders():
    chain = [({k}, {k + 1}) for k in range(1, 5)]
    pairs = join_orders.csg_cmp_pairs(5, chain)
    assert len(pairs) == (5**3 - 5) // 6  # the known count of a chain
    star = [({1}, {k}) for k in range(2, 6)]
    assert len(join_orders.csg_cmp_pairs(5, star)) == 4 * 2**3
    both = [({1}, {2}), ({2}, {3}), ({4}, {5}), ({5}, {6}), ({1, 2, 3}, {4, 5, 6})]
    assert join_orders.csg_cmp_pairs(6, both)[-1] == (frozenset({1, 2, 3}), frozenset({4, 5, 6}))
    assert join_orders.any_plan(3, [({1}, {2})]) is None and join_orders.any_plan(2, [({1}, {2})]) == "(R1 x R2)"


def test_random_graphs_are_enumerated_whole():
    draw = random.Random(0)
    for _ in range(20):
        n = 5
        edges = [(a, b) for _ in range(6) if (a := set(draw.sample(range(1, n + 1), draw.randint(1, 2)))) and (b := set(draw.sample(sorted(set(range(1, n + 1)) - a), draw.randint(1, 2))))]
        joined = lambda x, y: any((u <= x and v <= y) or (v <= x and u <= y) for u, v in edges)
        sets = [frozenset(k for k in range(1, n + 1) if m >> (k - 1) & 1) for m in range(1, 1 << n)]
        good = {s for s in sets if len(s) == 1}
        for s in sorted(sets, key=len):
            if any(a < s and a in good and s - a in good and joined(a, s - a) for a in sets):
                good.add(s)
        want = {(a, b) for a in good for b in good if min(a) < min(b) and not a & b and joined(a, b)}
        assert set(join_orders.csg_cmp_pairs(n, edges)) == want


def test_late_events_and_exact_paths(spark, tmp_path):
    """A file beside the named one isn't read; what comes later than the watermark is dropped from closed windows."""
    from brindle.streaming import windows

    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-03 00:00:00", "a", 1.0)], "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "event_type", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df.write.parquet(f"{tmp_path}/events_old.parquet")
    found = windows.run_once(windows.tumbling(windows.source(spark, f"{tmp_path}/events.parquet")), "append").collect()
    assert [(str(r.start), r.n) for r in found] == [("2024-01-01 00:00:00", 1)]  # the second window is still open


def test_streams_agree_with_batches(spark, small):
    from brindle.plans import siblings

    found = siblings.stream_tumbling(spark, small)
    assert found.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()
