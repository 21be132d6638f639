"""Content-addressed stores, directory hashes, trees and expansion of aliases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import cut


def content_id(data: str | Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(data, 256)


def put_files(files: DataFrame, key: str, data: str) -> DataFrame:
    """(id, data, first_key, n_puts) of a store after all files were put: one row for each content, whose first key (the least one) was new."""
    return files.where(F.col(data).isNotNull()).groupBy(content_id(data).alias("id")).agg(F.min_by(data, key).alias("data"), F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n_puts"))


def put_tables(files: DataFrame, path: str, data: str, rule: str) -> tuple[DataFrame, DataFrame]:
    """(sha256, data) of all contents and (path, sha256, rule) of all files; the smallest of several contents of a path counts, null ones are no files."""
    own = files.where(F.col(data).isNotNull() & F.col(path).isNotNull()).select(F.col(path).alias("path"), content_id(data).alias("sha256"), F.col(data).alias("data"), F.col(rule).alias("rule"))
    return own.select("sha256", "data").dropDuplicates(["sha256"]), own.groupBy("path").agg(F.min(F.struct("sha256", "rule")).alias("f")).select("path", "f.sha256", "f.rule")


def look_up(contents: DataFrame, files: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(path, rule, data) of the files at these paths, of all by default; a path that is no file is an error."""
    if paths is not None:
        files = files.where(F.col("path").isin(paths))
        missing = set(paths) - {r.path for r in files.select("path").collect()}  # no more rows than were asked for
        if missing:
            raise KeyError(f"no file {', '.join(sorted(missing))}")
    return files.join(contents, "sha256").select("path", "rule", "data")


def directory_ids(entries: DataFrame, directory: list[str], name: str, child: str) -> DataFrame:
    """The directory columns and id: SHA-256 over names and the bytes of the children's ids, in order of name.

    The hash of a directory is one sequence of bytes, so a directory is one
    task's; but it is hashed from sorted rows as they pass by, and never held.
    """
    rows = entries.select(*directory, F.col(name).cast("string").alias("__name"), F.col(child).alias("__child"))
    rows = rows.repartition(*directory).sortWithinPartitions(*directory, "__name", "__child")
    schema = T.StructType([*(rows.schema[c] for c in directory), T.StructField("id", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            *keys, names, children = (c.to_pylist() for c in batch.columns)
            for key, n, c in zip(zip(*keys), names, children):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(n.encode() + bytes.fromhex(c))
            yield _rows(done, arrow)
        if now is not None:
            yield _rows([(*now, digest.hexdigest())], arrow)

    return rows.mapInArrow(run, schema)


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)], schema=arrow)


def put_directories(entries: DataFrame, store: DataFrame, directory: list[str], name: str, child: str) -> tuple[DataFrame, DataFrame]:
    """Directories all of whose children are in the store, with their ids; and the entries whose child is missing, for which a directory is refused."""
    missing = entries.join(store.select(F.col("id").alias("__id")), F.col(child) == F.col("__id"), "left_anti")
    whole = entries.join(missing.select(*directory).distinct(), directory, "left_anti")
    return directory_ids(whole, directory, name, child), missing


def merkle(files: DataFrame, levels: list[str], name: str, data: str) -> DataFrame:
    """(path, level, id) of a tree of directories, one level of folders for each column, and its files below; the root has the path ""."""
    own = files.select(*levels, F.col(name).cast("string").alias("__name"), content_id(data).alias("id"))
    path = lambda columns: F.concat_ws("/", *columns)
    out = own.select(path([*levels, "__name"]).alias("path"), F.lit(len(levels) + 1).alias("level"), "id")
    entries = own
    for k in range(len(levels), -1, -1):
        folder = levels[:k]
        if folder:
            made = directory_ids(entries, folder, "__name", "id")
        else:
            listed = directory_ids(entries.withColumn("__root", F.lit("")), ["__root"], "__name", "id")
            made = listed.drop("__root")
        out = out.union(made.select(path(folder).alias("path") if folder else F.lit("").alias("path"), F.lit(k).alias("level"), "id"))
        if folder:
            entries = made.select(*folder[:-1], F.col(folder[-1]).cast("string").alias("__name"), "id")
    return out


def materialise(entries: DataFrame, root: str) -> DataFrame:
    """(path, id) of everything below a root, from entries (parent, name, child); an object that several parents hold appears under each path.

    One join a level, each cut off, until no object has children.
    """
    e = entries.select(F.col("parent").alias("__parent"), F.col("name").alias("__name"), F.col("child").alias("__child"))
    now = e.where(F.col("__parent") == root).select(F.col("__name").alias("path"), F.col("__child").alias("id"))
    out = None
    for _ in range(10_000):
        now = cut(now)
        if now.isEmpty():
            return now if out is None else out
        out = now if out is None else out.union(now)
        now = now.join(e, F.col("id") == F.col("__parent")).select(F.concat_ws("/", "path", "__name").alias("path"), F.col("__child").alias("id"))
    raise ValueError("the entries have a cycle")


def get_file(entries: DataFrame, root: str, path: str) -> DataFrame:
    """(id) of the object at a path below a root; no row where a part of the path doesn't exist. Reads one entry a level."""
    at = entries.sparkSession.createDataFrame([(root,)], "id string")
    for part in [p for p in path.split("/") if p]:
        at = entries.where(F.col("name") == part).join(at, F.col("parent") == F.col("id"), "left_semi").select(F.col("child").alias("id"))
    return at


def expand_aliases(inputs: DataFrame, edges: DataFrame) -> DataFrame:
    """inputs (target, input) with every input that an alias edge (output, input) produces replaced by the edge's inputs, over and over.

    A cycle of aliases is an error. Repeated results of a target stay one.
    """
    e = edges.select(F.col("output").alias("__output"), F.col("input").alias("__input")).distinct()
    longest = e.select("__output").distinct().count() + 1
    now, out = inputs.select("target", "input").distinct(), None
    for _ in range(longest + 1):
        now = cut(now)
        done = now.join(e, F.col("input") == F.col("__output"), "left_anti")
        out = done if out is None else out.union(done)
        now = now.join(e, F.col("input") == F.col("__output")).select("target", F.col("__input").alias("input")).distinct()
        if now.isEmpty():
            return out.distinct()
    raise ValueError("the aliases have a cycle")
