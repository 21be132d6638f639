"""Queries beside the relational core: chunk counts, stores and hashes, expressions, trees, HTML tables, join orders, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import documents, expressions
from brindle.operators import join_orders, stores
from brindle.session import scratch
from brindle.sources.catalog import Catalog, table, write_csv, write_json_lines, write_lines
from brindle.streaming import windows


def chunk_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expressions.chunk_counts(table(spark, sf_dir, "documents"))


def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.put_files(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", F.length("data").alias("length"), F.col("first_key").alias("first_doc"), "n_puts")


def content_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document looked up by its path in the tables of contents and of paths."""
    docs = table(spark, sf_dir, "documents")
    paths = docs.select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text", F.col("lang").alias("rule"))
    contents, files = stores.put_tables(paths, "path", "text", "rule")
    return stores.look_up(contents, files).select("path", "rule", F.length("data").alias("length"))


def directory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory for each source and language, all of whose children are in the store."""
    docs = table(spark, sf_dir, "documents")
    store = stores.put_files(docs, "doc_id", "text")
    entries = docs.select("source", "lang", "doc_id", stores.content_id("text").alias("child"))
    return stores.put_directories(entries, store, ["source", "lang"], "doc_id", "child")[0]


def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.merkle(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", "text")


def _expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    n = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("-"), n("l_orderkey"), F.lit(" * ("), n("l_partkey"), F.lit(" - "), n("l_suppkey"), F.lit(") / (-"), n("l_linenumber"), F.lit(") + "), n("l_partkey"), F.lit(" / "), n("l_linenumber"), F.lit(" * 2"))
    return lines.select(text.alias("value"))


def expression_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression made of each line item, evaluated from its text."""
    return expressions.evaluated(_expressions(spark, sf_dir))


def legal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expressions.legal_words(spark, 4)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, name, child): the world holds regions, these nations, these suppliers."""
    region, nation, supplier = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    r, n, s = (lambda c, p=p: F.concat(F.lit(p), F.col(c).cast("string")) for p in "rns")
    return (
        region.select(F.lit("world").alias("parent"), F.col("r_name").alias("name"), r("r_regionkey").alias("child"))
        .union(nation.select(r("n_regionkey"), "n_name", n("n_nationkey")))
        .union(supplier.select(n("s_nationkey"), "s_name", s("s_suppkey")))
    )


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.materialise(_tree(spark, sf_dir), "world")


def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers that the world and every region stand for."""
    edges = _tree(spark, sf_dir).select(F.col("parent").alias("output"), F.col("child").alias("input"))
    targets = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target"))
    return stores.expand_aliases(targets.union(spark.createDataFrame([("world",)], "target string")).withColumn("input", F.col("target")), edges)


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand written as a page with a table, and read from it again."""
    cell = lambda c: F.concat(F.lit("<td> "), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("p_partkey"), cell("p_name"), cell("p_type"), cell("p_size"), F.lit("</tr>"))
    pages = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    html = F.concat(F.lit("<html><table><thead><tr><th>a</th></tr></thead><tbody><tr><td>short row</td></tr>"), "rows", F.lit("</tbody></table></html>"))
    return documents.html_tables(pages.withColumn("html", html), "p_brand", "html", ("key", "name", "kind", "size"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, which hold no tables, with one of their address and language put before the article of each, among all that a page has."""
    pages = table(spark, sf_dir, "pages")
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</td>"))
    row = F.concat(F.lit("<table><tbody><tr><td>too short</td></tr><tr>"), cell(F.col("page_id").cast("string")), cell(F.col("url")), cell(F.regexp_extract("html", 'lang="([a-z]+)"', 1)), F.lit("<td></td></tr></tbody></table><article>"))
    return documents.html_tables(pages.withColumn("html", F.replace(F.col("html"), F.lit("<article>"), row)), "page_id", "html")


def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the nodes of a JSON tree made of each event."""
    tree = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.lit("user").alias("kind"), "user_id").alias("by"), F.array(F.struct("value")).alias("parts")))
    return documents.kind_counts(table(spark, sf_dir, "events").select(tree.alias("tree")), "tree")


_CHAINS = [({1}, {2}), ({2}, {3}), ({4}, {5}), ({5}, {6}), ({1, 2, 3}, {4, 5, 6})]


def _pairs(spark: SparkSession, edges: list) -> DataFrame:
    name = lambda s: ",".join(map(str, sorted(s)))
    return spark.createDataFrame([(name(a), name(b)) for a, b in join_orders.csg_cmp_pairs(6, edges)], "left string, right string")


def join_order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for two chains of three relations that one complex predicate joins."""
    return _pairs(spark, _CHAINS)


_Q5 = ("customer", "orders", "lineitem", "supplier", "nation", "region")
_Q5_PREDICATES = ("c_custkey = o_custkey", "l_orderkey = o_orderkey", "l_suppkey = s_suppkey", "c_nationkey = s_nationkey", "s_nationkey = n_nationkey", "n_regionkey = r_regionkey")


def join_order_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for the six tables and the predicates of the fifth query of TPC-H; columns are looked up in the tables."""
    columns = [table(spark, sf_dir, name).columns for name in _Q5]
    return _pairs(spark, join_orders.edges_of(columns, _Q5_PREDICATES))


def _reread(spark: SparkSession, sf_dir: str, name: str, kind: str, write) -> DataFrame:
    """A table written in a format and read from it again."""
    df = table(spark, sf_dir, name)
    path = f"{scratch(spark, 'format')}/{name}.{kind}"
    write(df, path)
    return Catalog(spark).add(name, path, kind, ", ".join(f"{c} {t}" for c, t in df.dtypes))


def format_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, sf_dir, "customer", "csv", write_csv)


def format_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, sf_dir, "part", "jsonl", write_json_lines)


def format_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, sf_dir, "supplier", "orc", lambda df, path: df.write.orc(path))


def format_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table as lines of text."""
    path = f"{scratch(spark, 'format')}/nation.txt"
    write_lines(table(spark, sf_dir, "nation"), path, "|")
    return Catalog(spark).add("nation", path, "txt")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.run_once(windows.tumbling(windows.source(spark, f"{sf_dir}/events.parquet")), "update", ("start", "event_type"))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.run_once(windows.tumbling(windows.source(spark, f"{sf_dir}/events.parquet"), "1 day", "1 hour", "6 hours"), "update", ("start", "event_type"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("since"), "event_type", "n", "total")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are over: they ended before the watermark, an hour before the last event."""
    found = windows.run_once(windows.sessions(windows.source(spark, f"{sf_dir}/events.parquet")))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice, counted once."""
    twice = windows.source(spark, f"{sf_dir}/events.parquet")
    found = windows.run_once(windows.first_of_each(twice.union(windows.source(spark, f"{sf_dir}/events.parquet")), ["event_id"]))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expressions as lines of text files, evaluated as they arrive."""
    folder = scratch(spark, "lines")
    write_lines(_expressions(spark, sf_dir), folder)
    return windows.run_once(windows.evaluated_lines(spark, folder))


PLANS = (
    chunk_frequency, content_store, content_tables, directory_store, merkle_tree, expression_values, legal_words, tree_paths, alias_expansion, html_tables, page_tables, json_kinds, join_order_pairs, join_order_predicates,
    format_csv, format_json_lines, format_orc, format_text, stream_tumbling, stream_sliding, stream_sessions, stream_distinct, stream_expressions,
)


def _words_sql() -> str:
    bad = ", ".join(f"'{x}'" for x in [*expressions.forbidden(), "000000"])
    return f"""WITH RECURSIVE w(word) AS (
  SELECT unnest(string_split(' |(|)|*|+|-|/|0', '|'))
  UNION ALL SELECT word || c FROM (SELECT word, unnest(string_split(CASE word[-1] WHEN ' ' THEN '(|*|+|-|/|0' WHEN '(' THEN '(|-|0' WHEN ')' THEN ' |)' WHEN '-' THEN ' |0' WHEN '0' THEN ' |)|0' ELSE ' ' END, '|')) AS c FROM w WHERE length(word) < 4)
  WHERE NOT list_bool_or([suffix(word || c, b) FOR b IN [{bad}]])
) SELECT word FROM w WHERE length(word) = 4"""


def _dir(name: str, child: str) -> str:
    return f"sha256(unhex(string_agg(hex(({name})::VARCHAR) || {child}, '' ORDER BY ({name})::VARCHAR)))"


def _pairs_sql(edges: list) -> str:
    """Connected sets of relations as bit masks, size by size."""
    mask = lambda s: sum(1 << (x - 1) for x in s)
    both = ", ".join(f"({mask(u)}, {mask(v)})" for a, b in edges for u, v in ((a, b), (b, a)))
    steps = [f"e(u, v) AS (VALUES {both})", "c1 AS (SELECT 1 << i AS m FROM range(6) t(i))"]
    for size in range(2, 7):
        halves = " UNION ALL ".join(f"SELECT a.m AS a, b.m AS b FROM c{k} a, c{size - k} b" for k in range(1, size))
        steps.append(f"p{size} AS (SELECT DISTINCT a, b FROM ({halves}), e WHERE a & b = 0 AND a & -a < b & -b AND a & u = u AND b & v = v)")
        steps.append(f"c{size} AS (SELECT DISTINCT a | b AS m FROM p{size})")
    name = lambda c: f"array_to_string([i + 1 FOR i IN range(6) IF ({c} >> i) & 1 = 1], ',')"
    return f"WITH {', '.join(steps)} SELECT {name('a')} AS \"left\", {name('b')} AS \"right\" FROM ({' UNION ALL '.join(f'FROM p{k}' for k in range(2, 7))})"


_EVALUATED_SQL = """SELECT '-' || l_orderkey || ' * (' || l_partkey || ' - ' || l_suppkey || ') / (-' || l_linenumber || ') + ' || l_partkey || ' / ' || l_linenumber || ' * 2' AS expression,
        sign(l_orderkey * (l_partkey - l_suppkey)) * (abs(l_orderkey * (l_partkey - l_suppkey)) // l_linenumber) + l_partkey // l_linenumber * 2 AS result FROM lineitem"""

_TREE_SQL = """tree AS (SELECT 'world' AS parent, r_name AS name, 'r' || r_regionkey AS child FROM region
  UNION ALL SELECT 'r' || n_regionkey, n_name, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, s_name, 's' || s_suppkey FROM supplier)"""

ORACLES = {
    "chunk_frequency": """WITH l AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), '[0-9]', '0', 'g') AS line FROM documents)
        SELECT chunk, count(*) AS n FROM (SELECT unnest([line[i + 1 : i + 4] FOR i IN range(0, length(line) - 4, 4)]) AS chunk FROM l WHERE length(line) > 4) GROUP BY ALL""",
    "content_store": "SELECT sha256(text) AS id, any_value(length(text))::INT AS length, min(doc_id) AS first_doc, count(*) AS n_puts FROM documents GROUP BY ALL",
    "content_tables": "SELECT source || '/' || lang || '/' || doc_id AS path, lang AS rule, length(text)::INT AS length FROM documents",
    "directory_store": f"SELECT source, lang, {_dir('doc_id', 'sha256(text)')} AS id FROM documents GROUP BY ALL",
    "merkle_tree": f"""WITH f AS (SELECT source, lang, doc_id, sha256(text) AS id FROM documents), l AS (SELECT source, lang, {_dir("doc_id", "id")} AS id FROM f GROUP BY ALL), s AS (SELECT source, {_dir("lang", "id")} AS id FROM l GROUP BY ALL)
        SELECT source || '/' || lang || '/' || doc_id AS path, 3 AS level, id FROM f UNION ALL SELECT source || '/' || lang, 2, id FROM l UNION ALL SELECT source, 1, id FROM s UNION ALL SELECT '', 0, {_dir("source", "id")} FROM s""",
    "expression_values": _EVALUATED_SQL,
    "stream_expressions": _EVALUATED_SQL,
    "join_order_pairs": _pairs_sql(_CHAINS),
    "join_order_predicates": _pairs_sql([({1}, {2}), ({3}, {2}), ({3}, {4}), ({1}, {4}), ({4}, {5}), ({5}, {6})]),
    "format_csv": "FROM customer",
    "format_json_lines": "FROM part",
    "format_orc": "FROM supplier",
    "format_text": "SELECT n_nationkey || '|' || n_name || '|' || n_regionkey AS value FROM nation",
    "stream_sliding": """SELECT strftime(s, '%Y-%m-%d %H') AS since, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DECIMAL(24,4) AS total
        FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR FOR k IN range(4)]) AS s FROM events) GROUP BY ALL""",
    "stream_distinct": "SELECT event_type, count(*) AS n FROM events GROUP BY ALL",
    "legal_words": _words_sql(),
    "tree_paths": f"WITH RECURSIVE {_TREE_SQL}, p(path, id) AS (SELECT name, child FROM tree WHERE parent = 'world' UNION ALL SELECT path || '/' || name, child FROM p JOIN tree ON parent = id) SELECT path, id FROM p",
    "alias_expansion": f"WITH RECURSIVE {_TREE_SQL}, x(target, input) AS (SELECT parent, child FROM tree WHERE parent = 'world' OR starts_with(parent, 'r') UNION SELECT target, child FROM x JOIN tree ON parent = input) SELECT DISTINCT target, input FROM x WHERE input NOT IN (SELECT parent FROM tree)",
    "html_tables": "SELECT p_brand, p_partkey::VARCHAR AS key, trim(p_name) AS name, trim(p_type) AS kind, p_size::VARCHAR AS size FROM part",
    "json_kinds": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'user', count(*) FROM events UNION ALL SELECT 'unknown', count(*) FROM events",
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DECIMAL(24,4) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
        SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY ALL""",
    "page_tables": "SELECT page_id::VARCHAR AS page_id, page_id::VARCHAR AS chinese, trim(url) AS pinyin, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS english, '' AS level FROM pages",
}


def queries() -> dict:
    return {f.__name__: f for f in PLANS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
