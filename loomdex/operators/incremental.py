"""Snapshots: change summaries, upserts, stale deletes, reuse of vectors, and guards before publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)), 256)


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: new, updated, removed or unchanged, of two snapshots (key, content)."""
    o, n = old.select(key, F.col(content).alias("__old"), F.lit(1).alias("__o")), new.select(key, F.col(content).alias("__new"), F.lit(1).alias("__n"))
    change = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their keys, and added."""
    return old.join(new, key, "left_anti").unionByName(new)


def stale(stored: DataFrame, incoming: DataFrame, processed: DataFrame, key: str, document: str) -> DataFrame:
    """Stored keys of processed documents that no longer come in."""
    return stored.join(processed.select(document).distinct(), document, "left_semi").join(incoming, key, "left_anti").select(key)


def reuse(candidates: DataFrame, stored: DataFrame, key: str, content: str, vector: str) -> DataFrame:
    """candidates with the stored vector where key and content are the same; needs_embedding marks the others."""
    s = stored.select(key, content, vector)
    return candidates.join(s, [key, content], "left").withColumn("needs_embedding", F.col(vector).isNull())


def guard(condition: Column, message: str) -> Column:
    """Null where the condition holds; else the query fails with the message."""
    return F.assert_true(F.coalesce(condition, F.lit(False)), message)


def collapse_guard(n: Column, previous: Column, ratio: float) -> Column:
    """Whether a count is at least 1 and the ratio of the previous one."""
    return n >= F.greatest(F.lit(1), F.ceil(previous * ratio))


def immutable_append(stored: DataFrame, incoming: DataFrame, digest: str, by: str) -> DataFrame:
    """incoming rows whose content is not stored yet, of each digest the first one by a column."""
    fresh = incoming.join(stored.select(digest), digest, "left_anti")
    return fresh.groupBy(digest).agg(F.min_by(F.struct(*incoming.columns), by).alias("__r")).select("__r.*")


def set_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
