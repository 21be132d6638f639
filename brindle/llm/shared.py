"""What the training-data operators share: reading tables, cutting lineage, mapping batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import checkpoint_folder, cut, remove  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the files of a result of `cut` that no plan will read any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles nothing refers to any more, and which checkpoints where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: An Arrow batch is worked off in pieces of about so many bytes, which bounds the Python objects made of it at once.
PIECE = 4_000_000


#: The session's setting for the bytes of a batch that Spark sends to Python, and what the operators set it to where the session doesn't.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Batches of BATCH bytes and one row more: by rows alone, 10,000 documents are one, which an executor holds several times for each of its cores, outside of the heap. A session that sets a size keeps it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def pieces(batch):
    """Slices of a record batch or an array."""
    n = batch.num_rows if isinstance(batch, pa.RecordBatch) else len(batch)
    step = max(1, int(n * PIECE / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def settle() -> None:
    """Give memory that a worker has freed back to the system; workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it has its own ways
        pass


def map_batches(df: DataFrame, columns: list, schema: str | T.StructType, make: Callable[[], Callable[..., dict | None]]) -> DataFrame:
    """Arrow-batched map: `make()` runs once in each task and returns a function of the columns' Python lists.

    The function returns a dict of equally long columns in the order of the
    schema, or None where a batch yields no row.
    """
    bound_batches(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        f = make()
        for batch in batches:
            for piece in pieces(batch):
                out = f(*(c.to_pylist() for c in piece.columns))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(k).type) for k, x in zip(names, (out[k] for k in names))], schema=arrow)
                    del out
        del f
        settle()

    return df.select(*columns).mapInArrow(run, schema)


def long_lists(matrix) -> pa.ListArray:
    """Rows of a 2-d int64 array as an Arrow list column, without a Python loop."""
    n, k = matrix.shape
    offsets = pa.array(range(0, n * k + 1, k) if k else [0] * (n + 1), type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), type=pa.int64()))


def replaced(docs: DataFrame, columns: dict) -> DataFrame:
    """docs with columns added; one of the same name (in any case) gives way."""
    taken = {c.lower() for c in columns}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def bounded(df: DataFrame, keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """At most n rows of df, those with the smallest hashes of their keys; all rows where there are no more than n.

    The hashes are first cut off at about the share that is wanted, so that no
    task sorts or sends more than a fraction of n rows for it.
    """
    total = df.count()
    h = F.xxhash64(F.lit(seed), *keys)
    if total > n:
        share = min(1.0, 1.1 * n / total + 100 / total)
        df = df.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), *keys).limit(n)


def _marked(rows: DataFrame, value: Column, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """rows with __maybe: whether the bigint value may be among the keys.

    A bitmap of 2**bits positions, as at most 2**(bits - 6) words, is broadcast
    whatever the number of keys.
    """
    place = lambda c: F.xxhash64(F.lit(7), c).bitwiseAND(F.lit((1 << bits) - 1))
    word = lambda p: F.shiftright(p, 6)
    words = keys.select(place(F.col(key)).alias("__p")).groupBy(word(F.col("__p")).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__p & 63 as int))")).alias("__bits"))
    placed = rows.withColumn("__p", place(value))
    hit = placed.join(F.broadcast(words), word(F.col("__p")) == F.col("__word"), "left")
    return hit.select(*[f"`{c}`" for c in rows.columns], F.expr("coalesce(__bits & shiftleft(1L, cast(__p & 63 as int)), 0) != 0").alias("__maybe"))


def maybe_in(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """The rows whose bigint column may be among the keys: all that are, and few others while there are fewer than 2**bits keys. It spares a later join the shuffle of most rows that have no partner."""
    return _marked(rows, F.col(column), keys, key, bits).where("__maybe").drop("__maybe")


def parted(rows: DataFrame, value: Column, keys: DataFrame, key: str, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """The rows whose bigint value may be among the keys, and the others, which need no join; each is a pass over the rows."""
    marked = _marked(rows, value, keys, key, bits)
    return marked.where("__maybe").drop("__maybe"), marked.where("not __maybe").drop("__maybe")


def bitmap(keys: DataFrame, key: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function for workers that tells of 64-bit hashes which may be among the keys: all that are, and some others.

    The bitmap has 8 positions or more for each key, but at most 2**27 in all
    (16 MB); with more keys than it has room for it lets more others through.
    """
    bits = min(27, max(16, (8 * keys.count() - 1).bit_length()))
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    made = np.zeros(1 << (bits - 6), dtype=np.int64)
    made[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(made)

    def among(hashes: np.ndarray) -> np.ndarray:
        p = hashes & ((1 << bits) - 1)
        return (sent.value[p >> 6] >> (p & 63)) & 1 == 1

    return among
