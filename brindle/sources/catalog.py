"""Directories of files as tables, functions of the user's, and sinks.

Every `name.parquet` of a directory, a file or a folder of files, is the table
`name`; its schema is that of the Parquet footers. Other entries are passed over,
but for those of FORMATS that the caller asks for.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from pathlib import PurePosixPath
from typing import Any

import pandas as pd

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Formats by the ending of a name, with Spark's name and options. The columns of text formats may be given as a schema.
FORMATS = {"parquet": ("parquet", {}), "csv": ("csv", {"header": "true", "inferSchema": "true"}), "jsonl": ("json", {}), "orc": ("orc", {}), "txt": ("text", {})}


class DuplicateTable(ValueError):
    pass


class UnknownTable(KeyError):
    pass


class Catalog:
    """Tables by lower-case name; a name is taken once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def add(self, name: str, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
        """A table of any of FORMATS; options are those of Spark's reader."""
        key = name.lower()
        if key in self._tables:
            raise DuplicateTable(f"table {key} is registered already")
        if kind not in FORMATS:
            raise ValueError(f"format {kind}; there are {', '.join(FORMATS)}")
        form, usual = FORMATS[kind]
        if schema:
            usual = {k: v for k, v in usual.items() if k != "inferSchema"}
        reader = self.spark.read.format(form).options(**(usual | options))
        self._tables[key] = (reader.schema(schema) if schema else reader).load(path)
        return self._tables[key]

    def add_dir(self, path: str, kinds: tuple[str, ...] = ("parquet",)) -> Catalog:
        """All tables of these formats in a directory on any file system Spark reads; one that can't be read is a warning."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in sorted(str(s.getPath()) for s in system.listStatus(folder)):
            name = PurePosixPath(entry)
            if (kind := name.suffix.removeprefix(".")) in kinds:
                try:
                    self.add(name.stem, entry, kind)
                except (PySparkException, Py4JJavaError) as e:
                    warnings.warn(f"{entry} can't be read: {str(e).splitlines()[0]}", stacklevel=2)
        return self

    def names(self) -> list[str]:
        return sorted(self._tables)

    def columns(self, name: str) -> list[tuple[str, str]]:
        return self[name].dtypes

    def get(self, name: str) -> DataFrame | None:
        return self._tables.get(name.lower())

    def __getitem__(self, name: str) -> DataFrame:
        found = self.get(name)
        if found is None:
            raise UnknownTable(f"no table {name}; there are {', '.join(self.names())}")
        return found

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._tables

    def views(self) -> Catalog:
        """Register every table as a temporary view, for SQL text."""
        for name, df in self._tables.items():
            df.createOrReplaceTempView(name)
        return self

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables. They are bound by name for this statement and leave no view behind; braces in the text are text."""
        bound = "WITH " + ", ".join(f"`{n}` AS (SELECT * FROM {{{n}}})" for n in self.names()) + " " if self._tables else ""
        return self.spark.sql(f"{bound}SELECT * FROM ({text.replace('{', '{{').replace('}', '}}')})", **self._tables)

    def function(self, name: str, f: Callable[..., pd.Series], kind: str) -> None:
        """A function of columns for SQL text, called with a batch of each as a pandas Series and returning one."""

        def run(*columns: pd.Series) -> pd.Series:
            return f(*columns)

        self.spark.udf.register(name, F.pandas_udf(run, kind))

    def aggregate(self, name: str, f: Callable[..., Any], kind: str) -> None:
        """An aggregate function for SQL text, called with a group's columns as pandas Series. Spark brings a group into one task for it: prefer a built-in one for groups of any size."""

        def run(*columns: pd.Series) -> Any:
            return f(*columns)

        self.spark.udf.register(name, F.pandas_udf(run, kind))

    def table_function(self, name: str, made: type, schema: str) -> None:
        """A class whose `eval` yields rows of the schema, for LATERAL in SQL text."""
        self.spark.udtf.register(name, F.udtf(made, returnType=schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """df as Parquet, in folders by the columns `by` where given, so that filters on them prune files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", header).csv(path)


def write_lines(df: DataFrame, path: str, separator: str = "", mode: str = "errorifexists") -> None:
    """A line of text for each row: its columns as strings, nulls empty."""
    df.select(F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode(mode).text(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object a line; null fields are left out."""
    df.write.mode(mode).json(path)
