"""The 22 queries of the TPC-H shape on the tables at hand, as DataFrame plans with their SQL.

`partsupp` isn't there, so `lineitem` stands for it; columns that are missing are
left out or replaced, and windows of time lie where the data do. Amounts are
decimals and results are cast to fixed types. Filters compare stored columns with
constants, so that they reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.scalar import days_after, money, ratio, stamp
from brindle.operators.relational import aggregate, join, not_in, order_by, top
from brindle.sources.catalog import table

D4 = "decimal(24,4)"


class Tables:
    """The tables of a directory, amounts as decimals beside the stored columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._read = lambda name: table(spark, sf_dir, name)

    @property
    def lineitem(self) -> DataFrame:
        return self._read("lineitem").withColumns({"qty": money("l_quantity"), "price": money("l_extendedprice"), "disc": money("l_discount"), "tax": money("l_tax"), "net": money("l_extendedprice") * (1 - money("l_discount"))})

    def __getattr__(self, name: str) -> DataFrame:
        return self._read(name)


def _within(column: str, first: str, end: str):
    return (F.col(column) >= stamp(first)) & (F.col(column) < stamp(end))


def _revenue(kind: str = D4):
    return F.sum("net").cast(kind)


def q01(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= stamp("1998-09-02"))
    n = F.count(F.lit(1))
    mean = lambda c: ratio(F.sum(c), n)
    return aggregate(rows, ["l_returnflag", "l_linestatus"], sum_qty=F.sum("qty").cast("decimal(24,2)"), sum_base_price=F.sum("price").cast("decimal(24,2)"), sum_disc_price=_revenue(), sum_charge=F.sum(F.col("net") * (1 + F.col("tax"))).cast("decimal(28,6)"), avg_qty=mean("qty"), avg_price=mean("price"), avg_disc=mean("disc"), count_order=n)


def q02(t: Tables) -> DataFrame:
    parts = t.part.where((F.col("p_size") == 15) & F.col("p_type").like("%ECON%")).select("p_partkey")
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", money("s_acctbal").alias("s_acctbal"), "s_name", "n_name")
    offers = t.lineitem.select("l_partkey", "l_suppkey", "price").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    cheapest = offers.withColumn("low", F.min("price").over(Window.partitionBy("p_partkey"))).where("price = low")
    return top(cheapest.select("s_acctbal", "s_name", "n_name", "p_partkey").distinct(), 100, "-s_acctbal", "n_name", "s_name", "p_partkey")


def q03(t: Tables) -> DataFrame:
    buyers = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = t.orders.where(F.col("o_orderdate") < stamp("1996-03-15")).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = t.lineitem.where(F.col("l_shipdate") > stamp("1996-03-15"))
    found = join(lines, orders, [("l_orderkey", "o_orderkey")]).groupBy("l_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate")).agg(_revenue().alias("revenue"))
    return top(found, 10, "-revenue", "o_orderdate", "l_orderkey")


def q04(t: Tables) -> DataFrame:
    orders = t.orders.where(_within("o_orderdate", "1996-07-01", "1996-10-01"))
    lines = t.lineitem
    late = join(orders, lines, (orders["o_orderkey"] == lines["l_orderkey"]) & (lines["l_shipdate"] > days_after(orders["o_orderdate"], 60)), "left_semi")
    return aggregate(late, ["o_orderpriority"], order_count=("count", "*"))


def _nations_of(t: Tables, region: str) -> DataFrame:
    return t.nation.join(t.region.where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")


def q05(t: Tables) -> DataFrame:
    asia = _nations_of(t, "ASIA").select("n_nationkey", "n_name")
    orders = t.orders.where(_within("o_orderdate", "1995-01-01", "1996-01-01")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    suppliers = t.supplier.join(asia, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return lines.groupBy("n_name").agg(_revenue().alias("revenue"))


def q06(t: Tables) -> DataFrame:
    # the bounds on the stored doubles reach the scan; the decimals decide
    rows = t.lineitem.where(_within("l_shipdate", "1995-01-01", "1996-01-01") & F.col("l_discount").between(0.045, 0.075) & (F.col("l_quantity") < 24) & F.col("disc").between(F.lit("0.05").cast("decimal(12,2)"), F.lit("0.07").cast("decimal(12,2)")))
    return aggregate(rows, revenue=F.sum(F.col("price") * F.col("disc")).cast(D4))


def q07(t: Tables) -> DataFrame:
    pair = t.nation.where(F.col("n_name").isin("NATION_6", "NATION_7"))
    sellers = t.supplier.join(pair, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supp_nation"))
    buyers = t.customer.join(pair, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cust_nation"))
    lines = t.lineitem.where(_within("l_shipdate", "1995-01-01", "1997-01-01")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    orders = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation")
    shipped = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("supp_nation <> cust_nation")
    return shipped.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(_revenue().alias("revenue"))


def q08(t: Tables) -> DataFrame:
    buyers = t.customer.join(_nations_of(t, "AMERICA"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    orders = t.orders.where(_within("o_orderdate", "1995-01-01", "1997-01-01")).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    sellers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    parts = t.part.where("p_type = 'ECONOMY'").select("p_partkey")
    lines = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    own = F.sum(F.when(F.col("n_name") == "NATION_2", F.col("net")).otherwise(F.lit(0)))
    return lines.groupBy("o_year").agg(ratio(own, F.sum("net")).alias("mkt_share"))


def q09(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_name").like("%blue%")).select("p_partkey")
    sellers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    lines = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("nation", F.year("o_orderdate").alias("o_year")).agg(_revenue().alias("sum_profit"))


def q10(t: Tables) -> DataFrame:
    orders = t.orders.where(_within("o_orderdate", "1995-10-01", "1996-01-01")).select("o_orderkey", "o_custkey")
    lost = t.lineitem.where("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(_revenue().alias("revenue"))
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", money("c_acctbal").alias("c_acctbal"), "n_name")
    return top(lost.join(named, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name"), 20, "-revenue", "c_custkey")


def q11(t: Tables) -> DataFrame:
    sellers = t.supplier.join(t.nation.where("n_name = 'NATION_7'"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")
    value = t.lineitem.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("price") * F.col("qty")).cast(D4).alias("value"))
    total = value.agg((F.sum("value") * F.lit("0.001").cast("decimal(4,3)")).alias("least"))
    return value.crossJoin(total).where("value > least").select("p_partkey", "value")


def q12(t: Tables) -> DataFrame:
    lines = t.lineitem.where(F.col("l_returnflag").isin("A", "R") & _within("l_shipdate", "1995-01-01", "1996-01-01"))
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    both = join(lines, t.orders, [("l_orderkey", "o_orderkey")])
    return aggregate(both, ["l_linestatus"], high_line_count=F.count_if(high), low_line_count=F.count_if(~high))


def q13(t: Tables) -> DataFrame:
    orders = t.orders.where(~F.col("o_orderpriority").like("1-%")).groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    each = t.customer.select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return aggregate(each, ["c_count"], custdist=("count", "*"))


def q14(t: Tables) -> DataFrame:
    rows = join(t.lineitem.where(_within("l_shipdate", "1995-09-01", "1995-10-01")), t.part, [("l_partkey", "p_partkey")])
    promo = F.sum(F.when(F.col("p_type").like("PROMO%"), F.col("net")).otherwise(F.lit(0)))
    return aggregate(rows, promo_revenue=F.try_divide(promo.cast("double") * 100, F.sum("net").cast("double")).cast("decimal(18,6)"))


def q15(t: Tables) -> DataFrame:
    total = t.lineitem.where(_within("l_shipdate", "1996-01-01", "1996-04-01")).groupBy("l_suppkey").agg(_revenue().alias("total_revenue"))
    best = total.agg(F.max("total_revenue").alias("most"))
    return total.join(best, F.col("total_revenue") == F.col("most")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total_revenue")


def q16(t: Tables) -> DataFrame:
    parts = t.part.where((F.col("p_brand") != "Brand#45") & ~F.col("p_type").like("MEDIUM%") & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49)).select("p_partkey", "p_brand", "p_type", "p_size")
    refused = t.supplier.where("s_acctbal < 0").select("s_suppkey")
    offers = not_in(join(t.lineitem.select("l_partkey", "l_suppkey"), parts, [("l_partkey", "p_partkey")]), "l_suppkey", refused)
    return aggregate(offers, ["p_brand", "p_type", "p_size"], supplier_cnt=("count_distinct", "l_suppkey"))


def q17(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_partkey", "qty", "price").join(t.part.where("p_brand = 'Brand#12'").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    w = Window.partitionBy("l_partkey")
    small = lines.withColumns({"s": F.sum("qty").over(w), "n": F.count(F.lit(1)).over(w)}).where(F.col("qty") * F.col("n") * 5 < F.col("s"))
    return aggregate(small, avg_yearly=ratio(F.sum("price"), F.lit(7)))


def q18(t: Tables) -> DataFrame:
    large = t.lineitem.groupBy("l_orderkey").agg(F.sum("qty").cast("decimal(18,2)").alias("sum_qty")).where("sum_qty > 300")
    orders = t.orders.join(large, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return top(orders.select("c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), money("o_totalprice").alias("o_totalprice"), "sum_qty"), 100, "-o_totalprice", "o_orderdate", "o_orderkey")


def q19(t: Tables) -> DataFrame:
    branch = lambda brand, least, most, size: (F.col("p_brand") == brand) & F.col("l_quantity").between(least, most) & F.col("p_size").between(1, size)
    both = join(t.lineitem, t.part, [("l_partkey", "p_partkey")])
    return aggregate(both.where(branch("Brand#12", 1, 11, 5) | branch("Brand#23", 10, 20, 10)), revenue=_revenue())


def q20(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_name").like("blue%")).select("p_partkey")
    lines = t.lineitem.where(_within("l_shipdate", "1996-01-01", "1997-01-01")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    w = Window.partitionBy("l_partkey")
    much = lines.select("l_suppkey", "l_partkey", "qty").withColumns({"s": F.sum("qty").over(w), "n": F.count(F.lit(1)).over(w)}).where(F.col("qty") * F.col("n") * 2 > F.col("s"))
    near = t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return near.join(much, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


def q21(t: Tables) -> DataFrame:
    orders = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.col("l_shipdate") > days_after("o_orderdate", 60)
    w = Window.partitionBy("l_orderkey")
    # one supplier alone is late among several: no other line of the order needs to be looked up again
    marked = lines.withColumns({"late": late, "suppliers": F.size(F.collect_set("l_suppkey").over(w)), "late_suppliers": F.size(F.collect_set(F.when(late, F.col("l_suppkey"))).over(w))})
    waiting = marked.where("late and suppliers > 1 and late_suppliers = 1")
    near = t.supplier.join(t.nation.where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")
    return top(waiting.join(near, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.count(F.lit(1)).alias("numwait")), 100, "-numwait", "s_name")


def q22(t: Tables) -> DataFrame:
    people = t.customer.select("c_custkey", F.substring("c_mktsegment", 1, 2).alias("cntrycode"), money("c_acctbal").alias("bal")).where(F.col("cntrycode").isin("BU", "AU", "MA", "HO"))
    mean = people.where("bal > 0").agg(F.sum("bal").alias("s"), F.count(F.lit(1)).alias("n"))
    rich = people.crossJoin(mean).where("bal * n > s")
    early = t.orders.where(F.col("o_orderdate") < stamp("1997-01-01"))
    return rich.join(early, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("cntrycode").agg(F.count(F.lit(1)).alias("numcust"), F.sum("bal").cast("decimal(24,2)").alias("totacctbal"))


PLANS = {f"tpch_{f.__name__}": f for f in (q01, q02, q03, q04, q05, q06, q07, q08, q09, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22)}

_LI = "li AS (SELECT * EXCLUDE (l_quantity, l_extendedprice, l_discount, l_tax), l_quantity::DECIMAL(12,2) AS qty, l_extendedprice::DECIMAL(12,2) AS price, l_discount::DECIMAL(12,2) AS disc, l_tax::DECIMAL(12,2) AS tax, l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(12,2)) AS net FROM lineitem)"
_REV = "CAST(sum(net) AS DECIMAL(24,4)) AS revenue"

ORACLES = {
    "q01": """SELECT l_returnflag, l_linestatus, sum(qty)::DECIMAL(24,2) AS sum_qty, sum(price)::DECIMAL(24,2) AS sum_base_price, sum(net)::DECIMAL(24,4) AS sum_disc_price,
        sum(net * (1 + tax))::DECIMAL(28,6) AS sum_charge, (sum(qty)::DOUBLE / count(*))::DECIMAL(18,6) AS avg_qty, (sum(price)::DOUBLE / count(*))::DECIMAL(18,6) AS avg_price,
        (sum(disc)::DOUBLE / count(*))::DECIMAL(18,6) AS avg_disc, count(*) AS count_order FROM li WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""",
    "q02": """, offers AS (SELECT p_partkey, price, s_acctbal::DECIMAL(12,2) AS s_acctbal, s_name, n_name FROM li JOIN part ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE p_size = 15 AND contains(p_type, 'ECON') AND r_name = 'EUROPE')
        SELECT DISTINCT s_acctbal, s_name, n_name, p_partkey FROM offers o WHERE price = (SELECT min(price) FROM offers i WHERE i.p_partkey = o.p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03": f"""SELECT l_orderkey, o_orderdate::DATE AS o_orderdate, {_REV} FROM li JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1996-03-15' AND DATE '1996-03-15' < l_shipdate GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
        AND EXISTS (FROM li WHERE o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY ALL""",
    "q05": f"""SELECT n_name, {_REV} FROM li JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND year(o_orderdate) = 1995 GROUP BY ALL""",
    "q06": "SELECT sum(price * disc)::DECIMAL(24,4) AS revenue FROM li WHERE year(l_shipdate) = 1995 AND disc >= 0.05 AND disc <= 0.07 AND qty < 24",
    "q07": f"""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate)::INT AS l_year, {_REV} FROM li JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
        WHERE (a.n_name, b.n_name) IN (('NATION_6', 'NATION_7'), ('NATION_7', 'NATION_6')) AND year(l_shipdate) IN (1995, 1996) GROUP BY ALL""",
    "q08": """SELECT year(o_orderdate)::INT AS o_year, (sum(CASE WHEN b.n_name = 'NATION_2' THEN net ELSE 0 END)::DOUBLE / sum(net)::DOUBLE)::DECIMAL(18,6) AS mkt_share
        FROM li JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation a ON a.n_nationkey = c_nationkey JOIN region ON r_regionkey = a.n_regionkey JOIN nation b ON b.n_nationkey = s_nationkey
        WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND year(o_orderdate) IN (1995, 1996) GROUP BY ALL""",
    "q09": """SELECT n_name AS nation, year(o_orderdate)::INT AS o_year, sum(net)::DECIMAL(24,4) AS sum_profit FROM li JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey WHERE contains(p_name, 'blue') GROUP BY ALL""",
    "q10": f"""SELECT c_custkey, c_name, {_REV}, c_acctbal::DECIMAL(12,2) AS c_acctbal, n_name FROM li JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= DATE '1995-10-01' AND o_orderdate < DATE '1996-01-01' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": """, v AS (SELECT l_partkey AS p_partkey, sum(price * qty)::DECIMAL(24,4) AS value FROM li JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7' GROUP BY ALL)
        SELECT p_partkey, value FROM v WHERE value > (SELECT sum(value) * 0.001 FROM v)""",
    "q12": """SELECT l_linestatus, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
        FROM li JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND year(l_shipdate) = 1995 GROUP BY ALL""",
    "q13": """, each AS (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND NOT starts_with(o_orderpriority, '1-') GROUP BY ALL) SELECT c_count, count(*) AS custdist FROM each GROUP BY ALL""",
    "q14": "SELECT (100 * sum(CASE WHEN starts_with(p_type, 'PROMO') THEN net ELSE 0 END)::DOUBLE / sum(net)::DOUBLE)::DECIMAL(18,6) AS promo_revenue FROM li JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'",
    "q15": """, r AS (SELECT l_suppkey, sum(net)::DECIMAL(24,4) AS total_revenue FROM li WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY ALL)
        SELECT s_suppkey, s_name, total_revenue FROM r JOIN supplier ON l_suppkey = s_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r)""",
    "q16": """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM li JOIN part ON p_partkey = l_partkey
        WHERE p_brand <> 'Brand#45' AND NOT starts_with(p_type, 'MEDIUM') AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""",
    "q17": """SELECT (sum(price)::DOUBLE / 7)::DECIMAL(18,6) AS avg_yearly FROM li l JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#12'
        AND qty * 5 * (SELECT count(*) FROM li i WHERE i.l_partkey = p_partkey) < (SELECT sum(qty) FROM li i WHERE i.l_partkey = p_partkey)""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice::DECIMAL(12,2) AS o_totalprice, sum(qty)::DECIMAL(18,2) AS sum_qty
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN li ON o_orderkey = l_orderkey GROUP BY ALL HAVING sum(qty) > 300 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": f"""SELECT {_REV} FROM li JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND qty >= 1 AND qty <= 11 AND p_size >= 1 AND p_size <= 5)
        OR (p_brand = 'Brand#23' AND qty >= 10 AND qty <= 20 AND p_size >= 1 AND p_size <= 10)""",
    "q20": """, y AS (SELECT l_partkey, l_suppkey, qty FROM li WHERE year(l_shipdate) = 1996 AND l_partkey IN (SELECT p_partkey FROM part WHERE starts_with(p_name, 'blue')))
        SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1
        AND s_suppkey IN (SELECT l_suppkey FROM y o WHERE 2 * qty * (SELECT count(*) FROM y i WHERE i.l_partkey = o.l_partkey) > (SELECT sum(qty) FROM y i WHERE i.l_partkey = o.l_partkey))""",
    "q21": """, w AS (SELECT l_orderkey, l_suppkey, l_shipdate > o_orderdate + INTERVAL 60 DAY AS late FROM li JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
        SELECT s_name, count(*) AS numwait FROM w a JOIN supplier ON s_suppkey = a.l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 AND late
        AND EXISTS (FROM w b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (FROM w c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.late)
        GROUP BY ALL ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22": """, p AS (SELECT c_custkey, c_mktsegment[1:2] AS cntrycode, c_acctbal::DECIMAL(12,2) AS bal FROM customer WHERE c_mktsegment[1:2] IN ('AU', 'BU', 'HO', 'MA')), m AS (SELECT sum(bal) AS s, count(*) AS n FROM p WHERE bal > 0)
        SELECT cntrycode, count(*) AS numcust, sum(bal)::DECIMAL(24,2) AS totacctbal FROM p, m WHERE bal * n > s AND NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderdate < DATE '1997-01-01') GROUP BY ALL""",
}


def queries() -> dict:
    return {name: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for name, f in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {f"tpch_{k}": f"WITH {_LI} {v}" for k, v in ORACLES.items()}
