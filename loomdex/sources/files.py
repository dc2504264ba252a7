"""Validated sources and create-only sinks."""

from __future__ import annotations

import csv
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import safe_relative_path


class SourceError(ValueError):
    """A source that breaks its contract."""


def read_registry(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV registry: header names trimmed, without a byte-order mark; blank rows skipped; a blank, repeated or missing column,
    or a row with too many fields, is an error. Columns beyond the required ones go into extras, a map."""
    head = spark.read.text(path).limit(1).head()
    if head is None:
        raise SourceError("the registry is empty")
    names = [c.strip() for c in next(csv.reader([head[0].lstrip("\ufeff")]))]
    if any(not c for c in names) or len(set(names)) < len(names):
        raise SourceError("blank or repeated column names")
    if missing := [c for c in required if c not in names]:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in names) + ", `__over` string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).csv(path)
    rows = rows.where(F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names)).isNotNull())
    if not rows.where("__over is not null").isEmpty():
        raise SourceError("a row has more fields than the header")
    extras = [c for c in names if c not in required]
    pairs = F.create_map(*(x for c in extras for x in (F.lit(c), F.trim(F.col(f"`{c}`"))))) if extras else F.create_map().cast("map<string,string>")
    return rows.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in required), pairs.alias("extras"))


def read_manifest(spark: SparkSession, root: str, manifest: DataFrame, schema: str) -> DataFrame:
    """Records of exactly the files that the manifest (pos, record_path, record_file_hash) lists, in its order.

    A path that is absolute or leaves the root, one that is not there, or a file with another SHA-256 fails the query.
    """
    listed = manifest.select("pos", "record_path", "record_file_hash", F.assert_true(safe_relative_path(F.col("record_path")), "a path leaves the root").alias("__safe"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    files = files.select(F.expr(f"regexp_replace(path, '^.*{root.rstrip('/')}/', '')").alias("record_path"), "content")
    joined = listed.join(files, "record_path", "left")
    checked = joined.where(F.assert_true(F.coalesce(F.sha2("content", 256) == F.col("record_file_hash"), F.lit(False)), "a listed file is missing or was changed").isNull() & F.col("__safe").isNull())
    return checked.select("pos", "record_path", F.from_json(F.decode("content", "UTF-8"), schema).alias("record")).orderBy("pos")


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a tree of files (path, content): SHA-256 over path, length and digest in order of paths.

    The files' digests are computed where they are read; only these meet.
    """
    per = files.select("path", F.concat_ws("\x1f", "path", F.octet_length("content").cast("string"), F.sha2("content", 256)).alias("t"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "t"))), lambda x: x.t), "\n"), 256).alias("fingerprint"))


def write_new(df: DataFrame, path: str) -> None:
    """Writes a table that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, root: str, at_least: int = 1) -> str:
    """Writes a snapshot to a folder of its own and then adds a pointer to it; a snapshot of fewer rows is refused.

    Pointers are only added, each as one file that appears when its write is committed, so readers always find the one or
    the other snapshot as a whole. Old snapshots stay until their owner removes them.
    """
    spark = df.sparkSession
    staged = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    n = spark.read.parquet(staged).count()
    if n < at_least:
        raise SourceError(f"{n} rows are fewer than {at_least}")
    spark.createDataFrame([(time.time_ns(), staged, n)], "version long, path string, n long").coalesce(1).write.mode("append").json(f"{root}/pointers")
    return staged


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot of the latest pointer."""
    pointers = spark.read.schema("version long, path string, n long").json(f"{root}/pointers")
    return spark.read.parquet(pointers.orderBy(F.desc("version")).head().path)
