"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.shipping import ship

#: One input table of the corpus.
Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text column with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, one is made, but only for a master that runs on this machine alone."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root and sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc._jsc.sc().getCheckpointDir().get()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        root = tempfile.mkdtemp(prefix="loomdex-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Drops the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written in here go at its end: nothing else reads them. If an executor is lost meanwhile, Spark makes them anew."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, its lineage cut there.

    Unlike a stored table it has no size that the planner knows, so joins with it are the same at every size.
    """
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


#: Folders of the tables stored so far, by application.
_stored: dict[str, list[str]] = {}


def store(df: DataFrame) -> DataFrame:
    """df computed once into a table of the shared checkpoint folder, and read from there: its lineage is cut.

    Shuffles that only its plan needed go at once. The folder is removed when the application ends, if step() has not before.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = f"{shared_folder(spark)}/tables-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    name = f"{folder}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(name)
    _stored.setdefault(sc.applicationId, []).append(name)
    return spark.read.schema(df.schema).parquet(name)


def step(spark: SparkSession, f: Callable[[], DataFrame | None]) -> DataFrame | None:
    """f(), stored; the tables that f stored on its way are removed, so nothing else may read them."""
    made = _stored.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    out = f()
    if out is not None:
        out = store(out)
    kept = made[-1:] if out is not None else []
    for name in made[before : len(made) - len(kept)]:
        remove(spark, name)
    made[before:] = kept
    return out


#: At most so many rows of keys are broadcast.
BROADCAST_IDS = 500_000


def bounded(keys: DataFrame) -> DataFrame:
    """keys, stored and counted; marked for a broadcast if they are few, else left to be joined by a shuffle."""
    held = store(keys)
    return held.hint("broadcast") if held.count() <= BROADCAST_IDS else held


def matched(rows: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined with side, whose columns are the keys with "_" behind, null-safely.

    The join goes by one hash of the keys, a long, and then by the keys: a broadcast table of longs is as large as its
    rows, one of other keys takes a page of memory, however few they are.
    """
    hashed, other = rows.withColumn("__hash", F.xxhash64(*keys)), side.withColumn("__hash_", F.xxhash64(*(f"{k}_" for k in keys)))
    same = [F.coalesce(F.col(k) == F.col(f"{k}_"), F.col(k).isNull() & F.col(f"{k}_").isNull()) for k in keys]
    return hashed.join(other, reduce(Column.__and__, same, F.col("__hash") == F.col("__hash_")), how).drop("__hash", "__hash_")


def without(docs: DataFrame, keys: list[str], dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in `dropped`; of those whose keys are in `repeated`, any one stays.

    Keys compare null-safely. Where few rows go, no text moves.
    """
    named = lambda df: df.select(*(F.col(k).alias(f"{k}_") for k in keys))
    again = store(named(repeated))
    out = matched(docs, bounded(named(dropped).unionByName(again).distinct()), keys, "left_anti")
    if again.isEmpty():
        return out
    return out.unionByName(matched(docs, bounded(again), keys, "left_semi").dropDuplicates(keys))


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column without nulls, as views on its buffers."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def by_bytes(batch: pa.RecordBatch, column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in a string or binary column; a longer value is a part of its own."""
    at, lo = text_bytes(batch.column(column))[1], 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def lines_by_hash(key: Column, text: Column, most: int, chars: int) -> Column:
    """The `most` lines with the least hash of key, place and text, blank ones left out, as structs of hash h and text x.

    A line of more than `chars` characters is read from a place in it that its hash gives, so no part of a text is favoured.
    """
    keyed = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.xxhash64(key, i, x).alias("h"), x.alias("x"))), lambda s: F.trim(s.x) != "")
    start = lambda s: F.pmod(s.h, F.greatest(F.length(s.x) - chars, F.lit(0)).cast("long") + 1).cast("int") + 1
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda s: F.struct(s.h.alias("h"), F.substr(s.x, start(s), F.lit(chars)).alias("x")))


def sample_by_hash(df: DataFrame, key: str, rows: int, salt: int = 7) -> DataFrame:
    """At most `rows` rows, those with the least hash of the key: the same rows for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.col(key)).limit(rows)


BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def map_arrow(df: DataFrame, f: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, with the package known to the workers, by batches of about BATCH_BYTES: rows may be long."""
    ship(df.sparkSession)
    if int(df.sparkSession.conf.get(BATCH_LIMIT).removesuffix("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)
