"""Catalogs: merging of rows of one name, unique ids, groups, look-ups and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import slug


def merge_by_name(rows: DataFrame, name: str, ord_col: str, *fill: str) -> DataFrame:
    """One row of each name in any case: the first by ord, its nulls filled from the next rows that have a value."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ord_col))).alias(c)
    return rows.groupBy(F.lower(name).alias("__name")).agg(F.min_by(name, ord_col).alias(name), F.min(ord_col).alias(ord_col), *(first(c) for c in fill)).drop("__name")


def unique_ids(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    """unique_id: the id for the first row of it by name, and the id with the slug of the name for others."""
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.lower(name), name))
    return rows.withColumn("__n", nth).withColumn("unique_id", F.when(F.col("__n") == 1, F.col(id_col)).otherwise(F.concat_ws("-", F.col(id_col), slug(F.col(name))))).drop("__n")


def by_group(rows: DataFrame, group: str, name: str) -> DataFrame:
    """group, n, names: how many distinct names each group has, sorted in any case."""
    d = rows.select(group, name).distinct()
    return d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(name)), "|").alias("names"))


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns holds the text, in any case. An empty text finds all."""
    hit = F.lit(needle == "")
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return rows.where(hit)


def registry_rows(rows: DataFrame, **allowed: list[str]) -> DataFrame:
    """Rows whose columns hold, in any case and without outer blanks, one of the values given for each; no values: all rows."""
    for c, values in allowed.items():
        if values:
            rows = rows.where(F.lower(F.trim(c)).isin(*(v.strip().lower() for v in values)))
    return rows


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the most frequent value of each key, null where two are."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(key).agg(F.max(F.struct("n", value)).alias("t"), F.max("n").alias("m"))
    ties = n.join(top.select(key, F.col("m").alias("n")), [key, "n"]).groupBy(key).agg(F.count(F.lit(1)).alias("ties"))
    return top.join(ties, key).select(key, F.when(F.col("ties") == 1, F.col(f"t.{value}")).alias(value))


def first_match(left: DataFrame, right: DataFrame, key: str, ord_col: str, *take: str) -> DataFrame:
    """left with columns of the first row (by ord) of right with its key; nulls without one."""
    r = right.groupBy(key).agg(F.min_by(F.struct(*take), ord_col).alias("__r"))
    return left.join(r, key, "left").select(*left.columns, *(F.col(f"__r.{c}").alias(c) for c in take))


def alias_merge(rows: DataFrame, id_col: str, full: str) -> DataFrame:
    """canonical: the full id where exactly one full row of the alias exists, else the id."""
    n = rows.where(F.col(full).isNotNull()).groupBy(id_col).agg(F.countDistinct(full).alias("__n"), F.min(full).alias("__full"))
    return rows.join(n, id_col, "left").withColumn("canonical", F.when(F.col("__n") == 1, F.col("__full")).otherwise(F.col(id_col))).drop("__n", "__full")
