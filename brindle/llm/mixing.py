"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are dealt to shards by hash. In a shard, the documents of a source are
laid end to end in seeded order and cut into blocks of BLOCK tokens; a token is a
run of characters other than space, tab and line ends. Of the blocks of a shard,
the share BUDGET is to be filled: its seats go to the sources by the highest
quotients weight / (2k - 1), k = 1, 2, ..., where a source stops at the blocks it
has. This gives every source an integer quota; so many of its blocks are then
chosen by seeded hash.

The whole is declarative: counting and cutting need only (doc_id, source, tokens),
and the text is joined to the chosen slices at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, parted, table

BLOCK = 512
BUDGET = 0.5
#: Tokens of a shard; their number follows the corpus.
SHARD_TOKENS = 1_000_000
SEED = 17
#: Target weights; a source that is not named has weight 1, and one of weight 0 gets nothing.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}
TOKEN = "[^ \\t\\n\\r]+"


def _number(text: Column) -> Column:
    """First 8 hexadecimal digits of an MD5 digest as an integer."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and source is not null and text is not null")


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n, rows): the most tokens of the rows of each document, and how many rows it has."""
    counted = _usable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n"))
    return counted.groupBy("doc_id", "source").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0")


def _slices(counted: DataFrame, weights: dict[str, float] = WEIGHTS, block: int = BLOCK, budget: float = BUDGET, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    if block < 1 or shard_tokens < 1 or not 0 <= budget <= 1 or any(w < 0 for w in weights.values()):
        raise ValueError("block and shard_tokens start at 1, budget lies in 0..1, weights are not negative")
    total = counted.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(shard_tokens))).cast("long").alias("shards"))
    dealt = counted.crossJoin(F.broadcast(total)).select("doc_id", "source", "n", (_number(F.concat_ws("|", F.lit(seed), "doc_id")) % F.coalesce("shards", F.lit(1))).alias("shard"), F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "doc_id")).alias("o"))
    line = Window.partitionBy("shard", "source").orderBy("o", "doc_id")
    laid = dealt.withColumn("last", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.col("last") - F.col("n"))
    pieces = laid.select("doc_id", "source", "shard", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))).alias("block"))
    pieces = pieces.select("doc_id", "source", "shard", "block", (F.greatest("first", F.col("block") * block) - F.col("first") + 1).alias("first_token"), (F.least("last", (F.col("block") + 1) * block) - F.col("first")).alias("last_token"))

    sizes = laid.groupBy("shard", "source").agg(F.ceil(F.max("last") / block).cast("long").alias("blocks"))
    weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in sorted(weights.items())], F.lit(1.0))
    seats = F.floor(F.sum("blocks").over(Window.partitionBy("shard")) * F.lit(float(budget))).cast("long")
    claims = sizes.withColumn("seats", seats).select("shard", "source", weight.alias("w"), "seats", F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("k")).where("w > 0")
    ranked = claims.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(F.col("w") / (2 * F.col("k") - 1)), "source", "k")))
    quotas = ranked.where("r <= seats").groupBy("shard", "source").agg(F.count(F.lit(1)).alias("quota"))

    order = Window.partitionBy("shard", "source").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "shard", "source", "block")), "block")
    blocks = sizes.select("shard", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).withColumn("r", F.row_number().over(order))
    chosen = blocks.join(quotas, ["shard", "source"]).where("r <= quota").select("shard", "source", "block")
    return pieces.join(chosen, ["shard", "source", "block"]).select("doc_id", "source", "shard", "block", "first_token", "last_token")


def slices(docs: DataFrame, weights: dict[str, float] = WEIGHTS, **parameters) -> DataFrame:
    """(doc_id, source, shard, block, first_token, last_token) of the chosen slices, both ends included and counted from 1 in the document.

    Parameters are block, budget, shard_tokens and seed. A block at the
    end of a source may hold fewer tokens. Documents with null doc_id, source or
    text, or without a token, are in no block. Equal quotients go to the smaller
    source name, equal hashes to the smaller block. Rows that repeat a doc_id in
    one source are counted as one document, whose text is that with the most
    tokens, the greatest of them; the order of a shard is by hash, then doc_id. A
    very long text spreads over as many blocks as it has tokens for, all in one
    shard. An empty table has no block. Other columns of docs are not read.
    """
    return _slices(cut(token_counts(docs)), weights, **parameters)


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The chosen slices with their text: the tokens of the slice with single spaces between them, and the other columns of docs.

    See `slices` for what is chosen. A text is cut into tokens once, however many
    of its slices are chosen, and only texts of which one may be are shuffled.
    Columns of docs named shard, block, first_token, last_token or n_tokens give
    way to those of the slice; other names may be any but those that begin with
    "__brindle_".
    """
    own = ("shard", "block", "first_token", "last_token", "n_tokens")
    rest = [c for c in docs.columns if c.lower() not in (*own, "doc_id", "source", "text", "n_chars")]
    counted = cut(token_counts(docs))
    lists = _slices(counted, **parameters).groupBy("doc_id", "source").agg(F.collect_list(F.struct("shard", "block", "first_token", "last_token")).alias("__brindle_slices"))  # no more than a document has blocks
    chosen = cut(lists.withColumn("__brindle_key", F.xxhash64("doc_id", "source")))
    texts = _usable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.struct(*[f"`{c}`" for c in rest] or [F.lit(1).alias("none")]).alias("__brindle_rest"))
    texts = parted(texts, F.xxhash64("doc_id", "source"), chosen, "__brindle_key")[0]
    if not counted.where("rows > 1").isEmpty():
        texts = texts.groupBy("doc_id", "source").agg(F.max_by(F.struct("text", "__brindle_rest"), F.struct(F.regexp_count("text", F.lit(TOKEN)), "text")).alias("__brindle_x")).select("doc_id", "source", "__brindle_x.*")
    tokens = F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1))
    # the array of tokens is bound to a name of the inner function, so that it is made once for all slices
    cuts = F.transform(F.array(tokens), lambda t: F.transform("__brindle_slices", lambda s: F.struct(s.alias("at"), F.array_join(F.slice(t, s["first_token"].cast("int"), (s["last_token"] - s["first_token"] + 1).cast("int")), " ").alias("text"))))
    found = texts.join(chosen, ["doc_id", "source"]).select("doc_id", "source", "__brindle_rest", F.explode(cuts[0]).alias("__brindle_cut"))
    found = found.select("doc_id", "source", "__brindle_rest", F.col("__brindle_cut.text").alias("text"), "__brindle_cut.at.*")
    n_chars = [F.length("text").cast("long").alias("n_chars")] if "n_chars" in docs.columns else []
    return found.select("doc_id", "text", *[F.col(f"__brindle_rest.`{c}`") for c in rest], "source", *n_chars, "shard", "block", "first_token", "last_token", (F.col("last_token") - F.col("first_token") + 1).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def sql(source: str = "documents", block: int = BLOCK, budget: float = BUDGET, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> str:
    weight = " ".join(f"WHEN '{s}' THEN {float(w)}::DOUBLE" for s, w in sorted(WEIGHTS.items()))
    token = "[^ \\t\\n\\r]+"
    return f"""
WITH counted AS (
  SELECT doc_id, source, max(len(regexp_extract_all(text, '{token}')))::BIGINT AS n FROM {source}
  WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL GROUP BY ALL HAVING n > 0
), total AS (SELECT greatest(1, coalesce(ceil(sum(n) / {shard_tokens}), 1))::BIGINT AS shards FROM counted
), dealt AS (
  SELECT doc_id, source, n, ('0x' || substr(md5('{seed}|' || doc_id), 1, 8))::BIGINT % shards AS shard, md5('{seed}|order|' || doc_id) AS o
  FROM counted, total
), laid AS (
  SELECT *, last - n AS first FROM (
    SELECT *, (sum(n) OVER (PARTITION BY shard, source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS last FROM dealt)
), pieces AS (
  SELECT doc_id, source, shard, first, last, unnest(range(first // {block}, (last - 1) // {block} + 1)) AS block FROM laid
), sizes AS (
  SELECT shard, source, ceil(max(last) / {block})::BIGINT AS blocks FROM laid GROUP BY ALL
), claims AS (
  SELECT shard, source, w, seats, unnest(range(1, blocks + 1)) AS k FROM (
    SELECT *, CASE source {weight} ELSE 1.0::DOUBLE END AS w, floor((sum(blocks) OVER (PARTITION BY shard))::DOUBLE * {float(budget)}::DOUBLE)::BIGINT AS seats FROM sizes)
), quotas AS (
  SELECT shard, source, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY shard ORDER BY w / (2 * k - 1)::DOUBLE DESC, source, k) AS r FROM claims WHERE w > 0)
  WHERE r <= seats GROUP BY ALL
), blocks AS (
  SELECT *, row_number() OVER (PARTITION BY shard, source ORDER BY md5('{seed}|' || shard || '|' || source || '|' || block), block) AS r
  FROM (SELECT shard, source, unnest(range(0, blocks)) AS block FROM sizes)
), chosen AS (SELECT b.shard, b.source, b.block FROM blocks b JOIN quotas q ON b.shard = q.shard AND b.source = q.source WHERE b.r <= q.quota
), slices AS (
  SELECT p.doc_id, p.source, p.shard, p.block, greatest(first, p.block * {block}) - first + 1 AS first_token, least(last, (p.block + 1) * {block}) - first AS last_token
  FROM pieces p JOIN chosen c ON p.shard = c.shard AND p.source = c.source AND p.block = c.block
), texts AS (
  SELECT doc_id, source, text, lang FROM {source} WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY len(regexp_extract_all(text, '{token}')) DESC, text DESC) = 1
), found AS (
  SELECT s.doc_id, array_to_string(list_slice(regexp_extract_all(t.text, '{token}'), s.first_token, s.last_token), ' ') AS text,
    t.lang, s.source, s.shard, s.block, s.first_token, s.last_token
  FROM slices s JOIN texts t ON s.doc_id = t.doc_id AND s.source = t.source
)
SELECT doc_id, text, lang, source, length(text)::BIGINT AS n_chars, shard, block, first_token, last_token, last_token - first_token + 1 AS n_tokens FROM found
"""
