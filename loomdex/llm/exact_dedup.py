"""Exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by successive runs of their bytes ("digits"). A group that is a singleton or whose
texts have ended is done; only the others go on, with the bytes that are left. Equality is that of the
bytes themselves, so no digest decides anything. Digits widen by a fixed factor, so a text of n bytes
takes O(log n) rounds, and each round shuffles only what is still undecided.

A hot group (a third of all rows with one text) never meets in one task: sizes and survivors come from a
group-by that combines on the map side, and the join that hands them back is a plain equi-join, which the
adaptive planner splits where a key is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, store, text_of, without

FIRST_DIGIT, WIDEN = 64, 32
REST = 2**31 - 1


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST_DIGIT, widen: int = WIDEN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. Of equal texts the largest id stays. A null id
    ranks below every other; in a group with null ids only, keep_id is null and the rows are kept. If an id
    itself repeats within a group, each of its rows is marked kept. Other columns of docs are not read. An empty
    table gives no rows.
    """
    rest = docs.select(F.col(id_col).alias("doc_id"), F.lit(-1).cast("long").alias("gid"), F.encode(text_of(text_col), "UTF-8").alias("rest"))
    rest = rest.withColumn("text_sha256", F.unhex(F.sha2("rest", 256)))
    width, done = first, []
    while True:
        digit = F.substring("rest", 1, width)
        groups = rest.select("doc_id", "gid", digit.alias("digit")).groupBy("gid", "digit").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = cut(groups.where("group_size > 1").select("*", F.monotonically_increasing_id().alias("next_gid"), (F.octet_length("digit") < width).alias("ended")))
        shown = rest.select("doc_id", "gid", digit.alias("digit"), "text_sha256").join(groups, ["gid", "digit"], "left")
        done.append(shown.where("coalesce(ended, true)").select("doc_id", F.when(F.col("ended"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256"))
        going = groups.where(~F.col("ended")).select("gid", "digit", "next_gid")
        if going.isEmpty():
            break
        longer = rest.where(F.octet_length("rest") >= width).select("*", digit.alias("digit"))
        rest = cut(longer.join(going, ["gid", "digit"]).select("doc_id", F.col("next_gid").alias("gid"), F.substring("rest", width + 1, REST).alias("rest"), "text_sha256"))
        width *= widen
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, with one row of each text: one of the largest id. A null id ranks below every other.

    Each row is a document of its own, also where ids repeat or are null: rows that share id and text are copies, and any
    one of them stays; rows that share the id only are not. Null texts count as empty. An empty table stays empty.
    """
    same = radix_groups(docs, id_col, text_col).where("group_size > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__text"), "kept")
    same = store(same)
    rows = docs.withColumns({"__id": F.col(id_col), "__text": F.sha2(F.encode(text_of(text_col), "UTF-8"), 256)})
    repeated = same.where("kept").groupBy("__id", "__text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return without(rows, ["__id", "__text"], same.where("not kept"), repeated).select(*docs.columns)
