"""One query for each operator, beside its SQL: scans, filters, joins, aggregates, order, sets, sub-queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.scalar import int_divide, money, ratio, stamp
from brindle.operators import relational as R
from brindle.sources.catalog import Catalog, table

FOUND: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of a table reader, under its name, with its SQL."""

    def put(f):
        FOUND[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _scan(name: str) -> None:
    FOUND[f"scan_{name}"] = lambda t: t(name)
    SQL[f"scan_{name}"] = f"FROM {name}"


for _name in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
    _scan(_name)


@query("SELECT p_partkey AS partkey, p_name FROM part")
def project_alias(t) -> DataFrame:
    return R.project(t("part"), partkey=F.col("p_partkey"), p_name=F.col("p_name"))


@query("SELECT 1 + 2 AS a, 1 - 2 AS b, 1 * 2 AS c, -7 // 2 AS d, 'Hello, World!' LIKE '%World!' AS e, 'Hello, World!' NOT LIKE '%World!' AS f, 1.25::DECIMAL(12,2) AS g, DATE '1998-09-02' AS h")
def constant_row(t) -> DataFrame:
    one = R.constants(t.spark, x=1, y=2, z=-7, s="Hello, World!")
    return one.select((F.col("x") + F.col("y")).alias("a"), (F.col("x") - F.col("y")).alias("b"), (F.col("x") * F.col("y")).alias("c"), int_divide(F.col("z"), F.col("y")).alias("d"), F.col("s").like("%World!").alias("e"), (~F.col("s").like("%World!")).alias("f"), money(F.lit("1.25")).alias("g"), F.lit("1998-09-02").cast("date").alias("h"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3")
def filter_int(t) -> DataFrame:
    return R.select(t("lineitem"), F.col("l_linenumber") < 3).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_quantity::DECIMAL(12,2) AS qty FROM lineitem WHERE l_quantity::DECIMAL(12,2) <= 5.00")
def filter_decimal(t) -> DataFrame:
    return R.select(t("lineitem").withColumn("qty", money("l_quantity")), F.col("l_quantity") <= 5).select("l_orderkey", "qty")


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderdate >= DATE '1998-01-01'")
def filter_date(t) -> DataFrame:
    return R.select(t("orders"), F.col("o_orderdate") >= stamp("1998-01-01")).select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query("SELECT count(*) FILTER (p_size = 7) AS eq, count(*) FILTER (p_size <> 7) AS ne, count(*) FILTER (p_size < 7) AS lt, count(*) FILTER (p_size <= 7) AS le, count(*) FILTER (p_size > 7) AS gt, count(*) FILTER (p_size >= 7) AS ge FROM part")
def comparisons(t) -> DataFrame:
    s = F.col("p_size")
    return t("part").agg(F.count_if(s == 7).alias("eq"), F.count_if(s != 7).alias("ne"), F.count_if(s < 7).alias("lt"), F.count_if(s <= 7).alias("le"), F.count_if(s > 7).alias("gt"), F.count_if(s >= 7).alias("ge"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = 'Brand#12' AND NOT p_type = 'PROMO'")
def filter_and_between_not(t) -> DataFrame:
    return R.select(t("part"), F.col("p_size").between(10, 20), F.col("p_brand") == "Brand#12", ~(F.col("p_type") == "PROMO")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = 3 OR p_brand IN ('Brand#3', 'Brand#4')")
def filter_or_in(t) -> DataFrame:
    return R.select(t("part"), (F.col("p_size") == 3) | F.col("p_brand").isin("Brand#3", "Brand#4")).select("p_partkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%O%' AND p_type NOT LIKE 'E%'")
def filter_like(t) -> DataFrame:
    return R.select(t("part"), F.col("p_type").like("%O%"), ~F.col("p_type").like("E%")).select("p_partkey", "p_type")


@query("SELECT l_orderkey, l_linenumber + 1 AS a, l_linenumber - 1 AS b, l_linenumber * 2 AS c, l_linenumber // 2 AS d, l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(12,2)) AS e FROM lineitem")
def arithmetic(t) -> DataFrame:
    n = F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", (n + 1).alias("a"), (n - 1).alias("b"), (n * 2).alias("c"), int_divide(n, F.lit(2)).cast("int").alias("d"), (money("l_extendedprice") * (1 - money("l_discount"))).cast("decimal(25,4)").alias("e"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, substring(p_name, 1, 4) AS head FROM part")
def case_substring(t) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return t("part").select("p_partkey", size.alias("class"), F.substring("p_name", 1, 4).alias("head"))


@query("SELECT nullif(n_regionkey, 2) AS k, n_regionkey IS DISTINCT FROM 3 AS d, n_name ILIKE '%_1%' AS i, n_name SIMILAR TO '.*_2[0-9]' AS s FROM nation")
def other_predicates(t) -> DataFrame:
    k = F.col("n_regionkey")
    return t("nation").select(F.nullif(k, F.lit(2)).alias("k"), (~k.eqNullSafe(3)).alias("d"), F.col("n_name").ilike("%_1%").alias("i"), F.col("n_name").rlike("^.*_2[0-9]$").alias("s"))


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(t) -> DataFrame:
    return R.cross(t("nation"), t("region")).select("n_name", "r_name")


@query("SELECT r.r_name AS a, n.n_name AS b, s.s_name AS c FROM region r, nation n, supplier s")
def join_cross_three(t) -> DataFrame:
    return R.cross(t("region"), t("nation"), t("supplier")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"), F.col("s_name").alias("c"))


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def join_inner(t) -> DataFrame:
    return R.join(t("nation"), t("region"), [("n_regionkey", "r_regionkey")]).select("n_name", "r_name")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def join_three(t) -> DataFrame:
    return R.join(R.join(t("customer"), t("nation"), [("c_nationkey", "n_nationkey")]), t("region"), [("n_regionkey", "r_regionkey")]).select("c_custkey", "n_name", "r_name")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(t) -> DataFrame:
    return R.join(t("nation"), t("region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_nationkey", "r_regionkey")


def _outer(kind: str, words: str) -> None:
    """Customers and their urgent orders: about a tenth of the customers have none, and most orders aren't urgent."""

    def f(t) -> DataFrame:
        urgent = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderpriority") == "1-URGENT")
        found = R.join(t("customer"), t("orders"), urgent, kind)
        return found.select("c_custkey", *(["o_orderkey"] if "semi" not in kind and "anti" not in kind else []))

    FOUND[f"join_{kind}"] = f
    SQL[f"join_{kind}"] = f"SELECT c_custkey{', o_orderkey' if words not in ('SEMI', 'ANTI') else ''} FROM customer {words} JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'"


for _kind, _words in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI")):
    _outer(_kind, _words)


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t) -> DataFrame:
    a = t("nation").select(F.col("n_name").alias("first"), F.col("n_regionkey").alias("r1"), F.col("n_nationkey").alias("k1"))
    b = t("nation").select(F.col("n_name").alias("second"), F.col("n_regionkey").alias("r2"), F.col("n_nationkey").alias("k2"))
    return R.join(a, b, (F.col("r1") == F.col("r2")) & (F.col("k1") < F.col("k2"))).select("first", "second")


@query("SELECT sum(p_retailprice::DECIMAL(12,2))::DECIMAL(24,2) AS s FROM part")
def sum_global(t) -> DataFrame:
    return R.aggregate(t("part"), s=F.sum(money("p_retailprice")).cast("decimal(24,2)"))


@query("SELECT p_brand, sum(p_retailprice::DECIMAL(12,2))::DECIMAL(24,2) AS s, min(p_size) AS lo, max(p_size) AS hi, (sum(p_size)::DOUBLE / count(*))::DECIMAL(18,6) AS mean, count(p_name) AS n, count(*) AS rows FROM part GROUP BY ALL")
def aggregate_keyed(t) -> DataFrame:
    return R.aggregate(t("part"), ["p_brand"], s=F.sum(money("p_retailprice")).cast("decimal(24,2)"), lo=("min", "p_size"), hi=("max", "p_size"), mean=ratio(F.sum("p_size"), F.count("p_size")), n=("count", "p_name"), rows=("count", "*"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY ALL")
def count_distinct(t) -> DataFrame:
    return R.aggregate(t("orders"), ["o_custkey"], kinds=("count_distinct", "o_orderpriority"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_keys(t) -> DataFrame:
    return R.aggregate(t("part"), ["p_brand", "p_type"])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 15")
def having(t) -> DataFrame:
    return R.aggregate(t("orders"), ["o_custkey"], F.col("n") > 15, n=("count", "*"))


@query("SELECT n FROM (SELECT count(*) AS n FROM nation) WHERE 1 = 0")
def having_false(t) -> DataFrame:
    return R.aggregate(t("nation"), (), F.lit(False), n=("count", "*"))


@query("SELECT l_returnflag, (100 * sum(l_tax::DECIMAL(12,2))::DOUBLE / sum(l_quantity::DECIMAL(12,2))::DOUBLE)::DECIMAL(18,6) AS share FROM lineitem GROUP BY ALL")
def aggregate_expression(t) -> DataFrame:
    return R.aggregate(t("lineitem"), ["l_returnflag"], share=F.try_divide(F.sum(money("l_tax")).cast("double") * 100, F.sum(money("l_quantity")).cast("double")).cast("decimal(18,6)"))


@query("SELECT * FROM region ORDER BY r_name")
def order_ascending(t) -> DataFrame:
    return R.order_by(t("region"), "r_name")


@query("SELECT * FROM region ORDER BY r_name DESC")
def order_descending(t) -> DataFrame:
    return R.order_by(t("region"), "-r_name")


@query("SELECT * FROM nation ORDER BY n_nationkey LIMIT 7")
def limit_rows(t) -> DataFrame:
    return R.order_by(t("nation"), "n_nationkey").limit(7)


@query("SELECT o_orderkey, o_totalprice::DECIMAL(12,2) AS price FROM orders ORDER BY price DESC, o_orderkey LIMIT 25")
def top_k(t) -> DataFrame:
    return R.top(t("orders").select("o_orderkey", money("o_totalprice").alias("price")), 25, "-price", "o_orderkey")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def union_all(t) -> DataFrame:
    return R.union(t("nation").select(F.col("n_name").alias("name")), t("region").select("r_name"), t("supplier").select("s_name"))


@query("SELECT p_partkey FROM part WHERE p_retailprice::DECIMAL(12,2) * (SELECT count(*) FROM part) > (SELECT sum(p_retailprice::DECIMAL(12,2)) FROM part)")
def subquery_scalar(t) -> DataFrame:
    whole = t("part").agg(F.sum(money("p_retailprice")).alias("s"), F.count(F.lit(1)).alias("n"))
    return R.cross(t("part"), whole).where(money("p_retailprice") * F.col("n") > F.col("s")).select("p_partkey")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_correlated(t) -> DataFrame:
    return t("orders").withColumn("most", F.max("o_totalprice").over(Window.partitionBy("o_custkey"))).where("o_totalprice = most").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def subquery_in(t) -> DataFrame:
    return R.join(t("supplier"), R.select(t("lineitem"), F.col("l_quantity") == 50), [("s_suppkey", "l_suppkey")], "left_semi").select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def subquery_not_in(t) -> DataFrame:
    return R.not_in(t("part"), "p_partkey", R.select(t("lineitem"), F.col("l_quantity") < 3).select("l_partkey")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderdate < DATE '1997-01-01')")
def subquery_not_exists(t) -> DataFrame:
    return R.join(t("customer"), R.select(t("orders"), F.col("o_orderdate") < stamp("1997-01-01")), [("c_custkey", "o_custkey")], "left_anti").select("c_custkey")


@query("SELECT p_partkey, p_size NOT BETWEEN 10 AND 20 AS n, p_size BETWEEN least(20, 10) AND greatest(20, 10) AS s FROM part")
def between_forms(t) -> DataFrame:
    """NOT BETWEEN, and BETWEEN SYMMETRIC, whose bounds come in any order."""
    size = F.col("p_size")
    return t("part").select("p_partkey", (~size.between(10, 20)).alias("n"), size.between(F.least(F.lit(20), F.lit(10)), F.greatest(F.lit(20), F.lit(10))).alias("s"))


@query("SELECT p_partkey, p_size = ANY (SELECT n_nationkey FROM nation) AS some, p_size > ALL (SELECT n_nationkey FROM nation) AS every FROM part")
def any_all(t) -> DataFrame:
    """= ANY is membership, > ALL is more than the greatest; the sub-query has no nulls."""
    keys = t("nation").agg(F.collect_set("n_nationkey").alias("keys"), F.max("n_nationkey").alias("most"))
    return R.cross(t("part"), keys).select("p_partkey", F.array_contains("keys", F.col("p_size")).alias("some"), (F.col("p_size") > F.col("most")).alias("every"))


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (NULL, 'none')) v(k, name)")
def values_rows(t) -> DataFrame:
    return R.values(t.spark, "k int, name string", [(1, "one"), (2, "two"), (None, "none")])


@query("SELECT l_returnflag, round(avg(l_quantity), 9) AS mean, round(avg(l_discount), 9) AS discount, count(*) AS n FROM lineitem GROUP BY ALL")
def aggregate_avg(t) -> DataFrame:
    """Averages, rounded since engines add doubles in different orders."""
    found = R.aggregate(t("lineitem"), ["l_returnflag"], mean=("avg", "l_quantity"), discount=("avg", "l_discount"), n=("count", "*"))
    return found.select("l_returnflag", F.round("mean", 9).alias("mean"), F.round("discount", 9).alias("discount"), "n")


@query("SELECT p_brand, avg(p_size::DECIMAL(12,2))::DECIMAL(16,6) AS mean FROM part GROUP BY ALL")
def aggregate_avg_decimal(t) -> DataFrame:
    return R.aggregate(t("part"), ["p_brand"], mean=F.avg(money("p_size")).cast("decimal(16,6)"))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def limit_offset(t) -> DataFrame:
    return R.order_by(t("customer").select("c_custkey"), "c_custkey").offset(40).limit(20)


@query("SELECT k, place FROM (SELECT k, row_number() OVER (ORDER BY k DESC NULLS FIRST, n_name) AS place FROM (SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation)) WHERE place <= 12")
def order_nulls_first(t) -> DataFrame:
    keyed = t("nation").select(F.nullif(F.col("n_regionkey"), F.lit(2)).alias("k"), "n_name")
    first = R.order_by(keyed, "-k nulls first", "n_name").limit(12)
    return first.select("k", F.row_number().over(Window.orderBy(F.col("k").desc_nulls_first(), "n_name")).cast("long").alias("place"))


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size % 7 DESC, length(p_name), p_partkey LIMIT 30")
def order_by_expression(t) -> DataFrame:
    return R.order_by(t("part"), (F.col("p_size") % 7).desc(), F.length("p_name"), "p_partkey").limit(30).select("p_partkey", "p_size")


@query("SELECT p_brand, p_size FROM part ORDER BY 2 DESC, 1 LIMIT 40")
def order_by_ordinal(t) -> DataFrame:
    return R.order_by(t("part").select("p_brand", "p_size"), -2, 1).limit(40)


@query("SELECT p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 5))")
def limit_with_ties(t) -> DataFrame:
    """The five largest sizes, and all that equal the last of them."""
    return R.top_with_ties(t("part").select("p_size"), 5, "-p_size")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT r_regionkey FROM region")
def union_distinct(t) -> DataFrame:
    return R.union(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select("s_nationkey"), t("region").select("r_regionkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t) -> DataFrame:
    return t("customer").select(F.col("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t) -> DataFrame:
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("SELECT n_name, o.o_orderkey FROM nation, LATERAL (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
def subquery_lateral(t) -> DataFrame:
    """The two dearest orders of every nation: a limit within a group, kept so small before its shuffle."""
    orders = R.join(t("orders"), t("customer"), [("o_custkey", "c_custkey")])
    dear = R.top_by(orders, ["c_nationkey"], 2, "-o_totalprice", "o_orderkey")
    return R.join(t("nation"), dear, [("n_nationkey", "c_nationkey")]).select("n_name", "o_orderkey")


_TEXT = """WITH busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT n_name, sum(n) AS orders FROM busy JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n > 10 GROUP BY n_name"""


@query(_TEXT)
def sql_text(t) -> DataFrame:
    """SQL text over a registered directory."""
    return Catalog(t.spark).add_dir(t.path).sql(_TEXT)


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS r, (sum(o_totalprice::DECIMAL(12,2)) OVER (w ROWS UNBOUNDED PRECEDING))::DECIMAL(24,2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def extension_window(t) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("r"), F.sum(money("o_totalprice")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(24,2)").alias("running"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extension_rollup(t) -> DataFrame:
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extension_cube(t) -> DataFrame:
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def extension_grouping_sets(t) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return t("lineitem").groupingSets([[flag, status], [status], []], flag, status).agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY ALL")
def extension_approximate(t) -> DataFrame:
    """Sketches against the exact count and median: within 5 %.

    Each kind of figure is an aggregate of its own: in one with a distinct count,
    Spark keeps and shuffles the sketches of every single value counted.
    """
    lines, flag = t("lineitem"), "l_returnflag"
    sketches = lines.groupBy(flag).agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"), F.percentile_approx("l_quantity", 0.5, 10_000).alias("c"))
    parts = R.aggregate(lines, [flag], b=("count_distinct", "l_partkey"))
    both = sketches.unionByName(parts, allowMissingColumns=True).unionByName(R.median(lines, [flag], "l_quantity", "d"), allowMissingColumns=True)
    found = both.groupBy(flag).agg(*[F.max(x).alias(x) for x in "abcd"])
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.05 * F.col(y)
    return found.select("l_returnflag", (near("a", "b") & near("c", "d")).alias("near"))


@query("SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def extension_join_as_of(t) -> DataFrame:
    """Each event with its user's last purchase up to then."""
    bought = t("events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return R.join_as_of(t("events").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts").select("event_id", "purchase")


@query("SELECT a.event_id AS error, b.event_id AS event FROM events a JOIN events b ON b.ts >= a.ts AND b.ts < a.ts + INTERVAL 5 MINUTE WHERE a.event_type = 'error' AND a.event_id <> b.event_id")
def extension_join_range(t) -> DataFrame:
    """The events of all users within five minutes after an error."""
    errors = t("events").where("event_type = 'error'").select(F.col("event_id").alias("error"), F.col("ts").alias("since"))
    return R.join_range(errors, t("events").select(F.col("event_id").alias("event"), "ts"), "since", "ts", 300).where("error != event").select("error", "event")


@query("""SELECT o_orderkey, abs(-o_totalprice) AS a, floor(o_totalprice)::BIGINT AS f, year(o_orderdate)::INT AS y, strftime(o_orderdate, '%Y-%m') AS m, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days,
upper(o_orderstatus) || '-' || lpad(o_custkey::VARCHAR, 8, '0') AS s, regexp_replace(o_orderpriority, '[0-9]-', '') AS r, string_split(o_orderpriority, '-')[1] AS first, length(o_orderpriority) AS n, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS later FROM orders""")
def scalar_functions(t) -> DataFrame:
    day, rank = F.col("o_orderdate"), F.col("o_orderpriority")
    return t("orders").select(
        "o_orderkey", F.abs(-F.col("o_totalprice")).alias("a"), F.floor("o_totalprice").alias("f"), F.year(day).alias("y"), F.date_format(day, "yyyy-MM").alias("m"), F.datediff(day.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"),
        F.concat(F.upper("o_orderstatus"), F.lit("-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("s"), F.regexp_replace(rank, "[0-9]-", "").alias("r"), F.split(rank, "-")[0].alias("first"), F.length(rank).cast("long").alias("n"), F.add_months(day.cast("date"), 1).alias("later"),
    )


@query("SELECT event_id, (props->>'k')::INT AS k, list_sum([x * 2 FOR x IN [1, (props->>'k')::INT] IF x > 1])::BIGINT AS doubled, map_extract(MAP {'a': value, 'b': -value}, 'b')[1] AS b FROM events")
def nested_functions(t) -> DataFrame:
    """JSON, arrays with lambdas and maps."""
    k = F.get_json_object("props", "$.k").cast("int")
    twice = F.transform(F.filter(F.array(F.lit(1), k), lambda x: x > 1), lambda x: x * 2)
    total = F.when(F.size(twice) > 0, F.aggregate(twice, F.lit(0).cast("long"), lambda a, x: a + x))
    return t("events").select("event_id", k.alias("k"), total.alias("doubled"), F.element_at(F.create_map(F.lit("a"), F.col("value"), F.lit("b"), -F.col("value")), "b").alias("b"))


@query("SELECT p_partkey, upper(p_brand[1]) || p_size AS code FROM part")
def extension_udf(t) -> DataFrame:
    """A function of the user's, registered by name and called from SQL text."""
    c = Catalog(t.spark).add_dir(t.path)
    c.function("part_code", lambda brand, size: brand.str[:1].str.upper() + size.astype(str), "string")
    return c.sql("SELECT p_partkey, part_code(p_brand, p_size) AS code FROM part")


@query("SELECT p_brand, max(p_size) - min(p_size) AS width FROM part GROUP BY ALL")
def extension_udaf(t) -> DataFrame:
    c = Catalog(t.spark).add_dir(t.path)
    c.aggregate("width", lambda size: int(size.max() - size.min()), "int")
    return c.sql("SELECT p_brand, width(p_size) AS width FROM part GROUP BY p_brand")


@query("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS piece FROM nation")
def extension_udtf(t) -> DataFrame:
    class Pieces:
        def eval(self, name: str):
            for piece in name.split("_"):
                yield (piece,)

    c = Catalog(t.spark).add_dir(t.path)
    c.table_function("pieces", Pieces, "piece string")
    return c.sql("SELECT n_nationkey, piece FROM nation, LATERAL pieces(n_name)")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def extension_intersect(t) -> DataFrame:
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def extension_except(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("k")).subtract(t("supplier").where("s_acctbal < 0").select("s_nationkey"))


class Reader:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)


def queries() -> dict:
    return {k: lambda spark, sf_dir, f=f: f(Reader(spark, sf_dir)) for k, f in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
