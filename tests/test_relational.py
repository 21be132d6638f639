import pytest
from pyspark.sql import functions as F

from brindle.functions.scalar import int_divide, money, ratio, stamp
from brindle.operators import relational as R
from brindle.sources.catalog import Catalog, DuplicateTable, UnknownTable, write_csv, write_json_lines, write_lines, write_parquet


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_catalog(spark, small, tmp_path):
    c = Catalog(spark).add_dir(small)
    assert {"region", "lineitem", "events"} <= set(c.names()) and c.get("nothing") is None and "REGION" in c
    assert c["Region"].count() == 5 and c.columns("region")[0] == ("r_regionkey", "int")
    with pytest.raises(DuplicateTable):
        c.add("REGION", f"{small}/region.parquet")
    with pytest.raises(UnknownTable):
        c["nothing"]
    assert c.sql("SELECT count(*) AS n FROM nation").first().n == 25
    assert [r.r_name for r in c.sql("SELECT r_name FROM region ORDER BY r_name DESC LIMIT 2").collect()] == sorted((r.r_name for r in c["region"].collect()), reverse=True)[:2]
    # braces and quotes are text
    assert c.sql("SELECT '{x} {region}' AS a, count(*) AS n FROM region WHERE r_name NOT LIKE '%{x}%'").first() == ("{x} {region}", 5)
    c.views()
    assert spark.sql("SELECT count(*) AS n FROM region").first().n == 5


def test_unreadable_entries_are_a_warning(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    (tmp_path / "note.txt").write_text("passed over")
    spark.range(3).write.parquet(str(tmp_path / "good.parquet"))
    with pytest.warns(UserWarning, match="bad.parquet"):
        c = Catalog(spark).add_dir(str(tmp_path))
    assert c.names() == ["good"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, s string, t string")
    write_parquet(df, f"{tmp_path}/p", ["k"])
    assert spark.read.parquet(f"{tmp_path}/p").where("k = 2").count() == 1
    write_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2
    write_lines(df, f"{tmp_path}/l")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/l").collect()) == ["1a", "2bx"]


def test_operators(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, 10), (3, 20), (None, 30)], "j int, w int")
    count = lambda how: R.join(a, b, [("k", "j")], how).count()
    assert [count(h) for h in R.JOINS] == [2, 4, 4, 6, 2, 2]
    assert R.cross(a, b).count() == 12 and R.join(a, b, F.col("k") < F.col("j")).count() == 4
    with pytest.raises(ValueError):
        R.join(a, b, [("k", "j")], "sideways")
    with pytest.raises(ValueError):
        R.cross(a, a)
    assert R.not_in(a, "k", b.select("j")).count() == 0
    assert R.not_in(a, "k", b.where("j = 3").select("j")).count() == 3
    assert R.not_in(a, "k", b.where("false").select("j")).count() == 4
    assert R.aggregate(a, ["k"]).count() == 3
    assert R.aggregate(a.where("false"), n=("count", "*"), s=("sum", "k")).first() == (0, None)
    assert R.aggregate(a, ["k"], F.col("n") > 1, n=("count", "*")).collect() == [(2, 2)]
    with pytest.raises(ValueError):
        R.aggregate(a, ["k"], n=("median", "k"))
    assert [r.k for r in R.order_by(a, "-k").collect()] == [2, 2, 1, None]
    assert R.top(a, 1, "k").first().k == 1
    with pytest.raises(ValueError):
        R.union(a, b)
    assert R.union(a, a, a).count() == 12
    assert R.constants(spark, x=1, y="s").collect() == [(1, "s")]
    assert R.select(a).count() == 4 and R.project(a, "k", u=F.upper("v")).columns == ["k", "u"]


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(int_divide(F.lit(-7), F.lit(2)), money(F.lit(1.005)).cast("string"), ratio(F.lit(1), F.lit(3)).cast("string"), ratio(F.lit(1), F.lit(0))).first()
    assert row[0] == -3 and row[2] == "0.333333" and row[3] is None
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        one.select(money(F.lit("99999999999.99"))).collect()


def test_filters_and_columns_reach_the_scan(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    orders = spark.read.parquet(f"{small}/orders.parquet")
    early = lambda df: R.select(df, F.col("l_shipdate") < stamp("1996-01-01"))
    p = plan(early(lines).select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate," in p and "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in p
    # through a join, a union, a projection and (by its keys) an aggregate
    assert "LessThan(l_shipdate," in plan(early(R.join(lines, orders, [("l_orderkey", "o_orderkey")])))
    assert plan(early(R.union(lines, lines))).count("LessThan(l_shipdate,") >= 2
    assert "GreaterThan(l_linenumber,3)" in plan(lines.select((F.col("l_linenumber")).alias("n")).where("n > 3"))
    kept = R.aggregate(lines, ["l_returnflag"], n=("count", "*")).where((F.col("l_returnflag") == "A") & (F.col("n") > 1))
    assert "EqualTo(l_returnflag,A)" in plan(kept)
    assert "TakeOrderedAndProject" in plan(R.top(lines.select("l_orderkey"), 3, "l_orderkey"))
    assert R.aggregate(lines, n=("count", "*")).where(F.lit(False)).count() == 0


def test_not_in_broadcasts_no_values(spark, small):
    lines, parts = spark.read.parquet(f"{small}/lineitem.parquet"), spark.read.parquet(f"{small}/part.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(R.not_in(parts, "p_partkey", lines.where("l_quantity < 3").select("l_partkey")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" not in p and "LeftAnti" in p


def test_sketches_are_not_kept_for_every_value(spark, small):
    import re

    from brindle import plans

    p = plan(plans.queries()["extension_approximate"](spark, small))
    by_value = re.findall(r"Aggregate\(keys=\[l_returnflag#\d+, l_\w+#\d+L?[^]]*\], functions=\[(.*)\]", p)
    assert by_value and not [f for f in by_value if "approx" in f or "percentile" in f]


def test_median(spark):
    import statistics

    rows = [("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", 7.0), (None, 2.0), (None, None), ("b", None), ("c", -1.0), ("c", 5.0), ("c", 5.0)]
    found = {r.k: r.m for r in R.median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    assert found == {k: statistics.median(v for g, v in rows if g == k and v is not None) for k in ("a", None, "c")}


def test_orders(spark):
    df = spark.createDataFrame([(1, "b"), (None, "a"), (3, "c"), (3, "a"), (2, None)], "k int, s string")
    rows = lambda *keys: [tuple(r) for r in R.order_by(df, *keys).collect()]
    assert rows("k nulls first", "s")[0] == (None, "a") and rows("-k nulls first", "s")[:2] == [(None, "a"), (3, "a")]
    assert rows(1, -2)[2:4] == [(3, "c"), (3, "a")] and rows(F.coalesce("k", F.lit(2)) % 3, "s")[0] == (3, "a")
    with pytest.raises(ValueError):
        rows(3)
    assert sorted(map(tuple, R.top_with_ties(df, 1, "-k").collect())) == [(3, "a"), (3, "c")]
    assert R.top_with_ties(df, 1, "k nulls first").collect() == [(None, "a")] and R.top_with_ties(df, 9, "k").count() == 5
    assert sorted((r.k or 0) for r in R.top_by(df, ["s"], 1, "-k").collect()) == [1, 2, 3, 3]


def test_as_of_and_range_joins(spark):
    import random

    draw = random.Random(1)
    when = "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, t)"
    a = spark.createDataFrame([(i, draw.choice([1, 2, None]), draw.choice([None, *range(40)])) for i in range(60)], "x int, k int, t int").selectExpr("x", "k", f"{when} as ts", "t")
    b = spark.createDataFrame([(i, draw.choice([1, 2, None]), draw.choice([None, *range(40)])) for i in range(30)], "y int, k int, t int").selectExpr("y", "k", f"{when} as ts")
    got = {r.x: r.y for r in R.join_as_of(a.drop("t"), b, ["k"], "ts").collect()}
    rows = b.collect()
    for r in a.collect():
        before = [(o.ts, o.y) for o in rows if r.ts is not None and o.ts is not None and r.k is not None and o.k == r.k and o.ts <= r.ts]
        assert got[r.x] == (max(before)[1] if before else None)
    pairs = {(r.x, r.y) for r in R.join_range(a.selectExpr("x", "ts as since"), b.select("y", "ts"), "since", "ts", 7).collect()}
    assert pairs == {(p.x, q.y) for p in a.collect() for q in rows if p.ts is not None and q.ts is not None and 0 <= (q.ts - p.ts).total_seconds() < 7}


def test_range_join_adds_nothing_to_times_of_pairs(spark, small):
    """The end of a range is a column of its row: adding an interval costs more than all else that is done for a pair."""
    from brindle import plans

    joins = [x for x in plan(plans.queries()["extension_join_range"](spark, small)).splitlines() if "Join" in x]
    assert joins and not [x for x in joins if "interval" in x.lower()]


def test_range_join_in_the_hour_that_clocks_skip(spark):
    """Stamps without a zone are joined as they are, to the microsecond, in whatever zone the session is."""
    left = spark.createDataFrame([(1, "2024-03-10 02:58:00"), (2, "2024-03-10 01:59:00"), (3, "1969-12-31 23:59:59.5"), (4, "9000-01-01 00:00:00.000001"), (5, None)], "x int, t string").selectExpr("x", "cast(t as timestamp_ntz) since")
    right = spark.createDataFrame([(1, "2024-03-10 03:02:59.999999"), (2, "2024-03-10 03:03:00"), (3, "2024-03-10 02:58:00"), (4, "2024-03-10 02:03:59"), (5, "1970-01-01 00:04:59.499999"), (6, "9000-01-01 00:05:00"), (7, "9000-01-01 00:05:00.000001"), (8, None)], "y int, t string").selectExpr("y", "cast(t as timestamp_ntz) ts")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = {(r.x, r.y) for r in R.join_range(left, right, "since", "ts", 300).select("x", "y").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert found == {(1, 1), (1, 3), (2, 4), (3, 5), (4, 6)}


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'say "x"', 2.5)], "k int, s string, d double")
    write_csv(df, f"{tmp_path}/one.csv")
    write_json_lines(df, f"{tmp_path}/two.jsonl")
    df.write.orc(f"{tmp_path}/three.orc")
    write_lines(df.select("s"), f"{tmp_path}/four.txt")
    c = Catalog(spark).add_dir(str(tmp_path), ("csv", "jsonl", "orc", "txt"))
    for name in ("one", "two", "three"):
        assert sorted(map(tuple, c[name].select("k", "s", "d").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert sorted(r.value for r in c["four"].collect()) == ["a,b", 'say "x"'] and Catalog(spark).add_dir(str(tmp_path)).names() == []
    with pytest.raises(ValueError):
        Catalog(spark).add("x", str(tmp_path), "xml")
