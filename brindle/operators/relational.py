"""Relational operators as functions of DataFrames.

They add checks and defaults to the DataFrame API, no execution: a plan made of
them is an ordinary logical plan, which Catalyst rewrites as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.scalar import int_divide

JOINS = ("inner", "left", "right", "full", "left_semi", "left_anti")
AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count, "count_distinct": F.count_distinct}


def constants(spark: SparkSession, **values) -> DataFrame:
    """One row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def project(df: DataFrame, *columns: str, **computed: Column) -> DataFrame:
    """Named columns in order, then computed ones."""
    return df.select(*columns, *[c.alias(k) for k, c in computed.items()])


def select(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which all predicates are true; without predicates all rows."""
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def cross(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All combinations of rows, the columns of all tables in order; equal column names are an error."""
    for other in others:
        _distinct_names(first, other)
        first = first.crossJoin(other)
    return first


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """A join by pairs of equal columns or by any condition; the columns of both sides, of the left one for semi and anti joins.

    Null keys are equal to nothing. The strategy (broadcast of a side that is
    small enough, sort-merge or hash, split of skewed partitions) is chosen by
    Spark from sizes, at run time where need be.
    """
    if how not in JOINS:
        raise ValueError(f"join kind {how}; there are {', '.join(JOINS)}")
    if how not in ("left_semi", "left_anti"):
        _distinct_names(left, right)
    condition = on if isinstance(on, Column) else reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in on])
    return left.join(right, condition, how)


def not_in(left: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column isn't among the values, as SQL's NOT IN: none where a value is null, none with a null column unless there are no values.

    One aggregate tells whether there are values and nulls among them; the rest
    is an anti-join on keys, which needs no broadcast of the values.
    """
    value = values.columns[0]
    known = values.agg(F.count(F.lit(1)).alias("__all"), F.count(value).alias("__known"))
    side = values.select(F.col(value).alias("__value")).where("__value is not null")
    rest = left.join(side, left[column] == side["__value"], "left_anti").crossJoin(F.broadcast(known))  # one row
    return rest.where((F.col("__all") == 0) | (F.col("__all") == F.col("__known")) & F.col(column).isNotNull()).select(*[f"`{c}`" for c in left.columns])


def join_as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Every row of left with the other columns of that row of right with equal keys whose time is the last one up to its own; nulls where there is none.

    Rows with a null key or time have no partner. Of rows of right with equal keys
    and time one is taken, the greatest by its other columns. Both sides are laid
    together and scanned once in order of time, so there is one shuffle, by the
    keys, and no pair is made that isn't in the result.
    """
    own = [c for c in right.columns if c not in (*keys, time)]
    usable = F.col(time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    rest = F.struct(*[f"`{c}`" for c in own])
    latest = right.where(usable).groupBy(*keys, time).agg(F.max(rest).alias("__right"))
    none = F.lit(None)
    both = latest.select(*keys, time, F.lit(0).alias("__side"), "__right", none.cast(_struct_of(left)).alias("__left"))
    both = both.unionByName(left.select(*keys, time, F.lit(1).alias("__side"), none.cast(latest.schema["__right"].dataType).alias("__right"), F.struct(*[f"`{c}`" for c in left.columns]).alias("__left")))
    line = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_first(), "__side")
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))).where("__side = 1")
    matched = F.when(usable, F.col("__found"))
    return found.select(*[F.col(f"__left.`{c}`") for c in left.columns], *[matched[c].alias(c) for c in own])


def _struct_of(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


def _micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970, in no time zone for stamps that have none."""
    if isinstance(df.schema[c].dataType, T.TimestampNTZType):
        return ((F.col(c) - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(c))


#: Buckets for the width of a range join's interval. Of n + 1 pairs that are compared one is in vain, and an interval is copied n or n + 1 times.
RANGE_BUCKETS = 2


def join_range(left: DataFrame, right: DataFrame, start: str, time: str, seconds: int) -> DataFrame:
    """Pairs where right's time lies in [start, start + seconds), by an equi-join on buckets of a part of `seconds`: an interval is copied to those that it touches.

    The end of an interval is made before the join, so that a pair costs two
    comparisons of columns: there can be many more pairs than rows.
    """
    _distinct_names(left, right)
    width = F.lit(seconds * 1_000_000 // RANGE_BUCKETS)
    bucket = lambda micros: int_divide(micros - F.pmod(micros, width), width)
    ranges = left.withColumn("__end", F.col(start) + F.expr(f"interval {seconds} seconds")).withColumn("__from", _micros(left, start))
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__from")), bucket(F.col("__from") + (seconds * 1_000_000 - 1))))).drop("__from")
    met = spread.join(right.withColumn("__own", bucket(_micros(right, time))), F.col("__bucket") == F.col("__own"))
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col("__end"))).drop("__bucket", "__own", "__end")


def aggregate(df: DataFrame, keys: Sequence[str] = (), having: Column | None = None, **aggregates: tuple[str, str | Column] | Column) -> DataFrame:
    """Keys and named aggregates, each a (function, column) or a column; without aggregates the distinct keys, without keys one row."""
    for v in aggregates.values():
        if isinstance(v, tuple) and v[0] not in AGGREGATES:
            raise ValueError(f"aggregate {v[0]}; there are {', '.join(AGGREGATES)}")
    made = [(AGGREGATES[v[0]](F.lit(1) if v[1] == "*" else v[1]) if isinstance(v, tuple) else v).alias(k) for k, v in aggregates.items()]
    if not made:
        if not keys:
            raise ValueError("neither keys nor aggregates")
        out = df.select(*keys).distinct()
    else:
        out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return out if having is None else out.where(having)


def median(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The exact median of each group, the mean of both middle values where there are two; groups without a value have no row.

    Values are counted first, and the counts added up in order of the values, so
    that what a task sorts are the distinct values of a group, not its rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    line = group.orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(*keys, F.col("__value").cast("double").alias("__value"), F.sum("__n").over(line).alias("__upto"), F.sum("__n").over(group).alias("__all"))
    at = lambda place: F.min(F.when(F.col("__upto") >= F.expr(place), F.col("__value")))
    return placed.groupBy(*keys).agg((0.5 * at("(__all + 1) div 2") + 0.5 * at("__all div 2 + 1")).alias(name))


def _key(df: DataFrame, key: str | int | Column) -> Column:
    if isinstance(key, Column):
        return key
    if isinstance(key, int):
        if not 1 <= abs(key) <= len(df.columns):
            raise ValueError(f"there is no column {abs(key)}")
        key = ("-" if key < 0 else "") + df.columns[abs(key) - 1]
    name, _, first = key.partition(" nulls ")
    column = F.col(name.removeprefix("-"))
    if first == "first":
        return column.desc_nulls_first() if name.startswith("-") else column.asc_nulls_first()
    return column.desc_nulls_last() if name.startswith("-") else column.asc_nulls_last()


def order_by(df: DataFrame, *keys: str | int | Column) -> DataFrame:
    """Rows in order of the keys: names, "-name" for descending, numbers of columns from 1 (negative for descending) or expressions; nulls last, or first with "name nulls first"."""
    return df.orderBy(*[_key(df, k) for k in keys])


def top(df: DataFrame, n: int, *keys: str | int | Column) -> DataFrame:
    """The first n rows in order; each task keeps n rows, and nothing is sorted as a whole."""
    return order_by(df, *keys).limit(n)


def top_with_ties(df: DataFrame, n: int, *keys: str | int | Column) -> DataFrame:
    """The first n rows in order and all that equal the last of them in the keys; the bound is found by `top`, so nothing is ranked as a whole."""
    marked = df.withColumns({f"__k{i}": _value(df, k) for i, k in enumerate(keys)})
    order = [_key(df, k) for k in keys]
    names = [f"__k{i}" for i in range(len(keys))]
    last = marked.orderBy(*order).limit(n)
    seen = last.select(*names).distinct()
    # all rows whose keys are among those of the first n: these rows themselves, and the ties of the last one
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in names])
    return marked.join(seen.select(*[F.col(k).alias(f"{k}s") for k in names]), same, "left_semi").select(*[f"`{c}`" for c in df.columns])


def _value(df: DataFrame, key: str | int | Column) -> Column:
    if isinstance(key, Column):
        raise ValueError("ties are told by columns: name them")
    return F.col(df.columns[abs(key) - 1] if isinstance(key, int) else key.partition(" nulls ")[0].removeprefix("-"))


def top_by(df: DataFrame, by: Sequence[str], n: int, *keys: str | int | Column) -> DataFrame:
    """The first n rows in order of each group; Spark keeps n rows a group before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*[_key(df, k) for k in keys]))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def values(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """Rows that are written out."""
    return spark.createDataFrame(list(rows), schema)


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of tables whose columns agree in number and type, with the names of the first."""
    for other in others:
        if [t for _, t in first.dtypes] != [t for _, t in other.dtypes]:
            raise ValueError(f"columns {first.dtypes} and {other.dtypes} differ in type")
        first = first.union(other)
    return first


def _distinct_names(left: DataFrame, right: DataFrame) -> None:
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}; rename one")
