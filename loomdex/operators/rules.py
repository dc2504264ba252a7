"""A rule engine over tables: rules are rows, applicants are rows, and decisions are aggregates.

A rule has rule_id, ord, type, field, low, high, decisive, description. Types: numeric_range (within inclusive bounds, each
may be null), required (the field is there), registry (the field's value is registered). A rule whose input is missing is
`missing`; an unknown type is `not_applicable`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_id string, ord int, type string, field string, low double, high double, decisive boolean, description string"


def matches(applicants: DataFrame, rules: DataFrame, registered: DataFrame | None = None, id_col: str = "applicant_id", values: str = "inputs") -> DataFrame:
    """applicant_id, rule columns, status. applicants hold inputs as map<string,string>; rules are few and are broadcast."""
    joined = applicants.select(id_col, values).crossJoin(F.broadcast(rules))
    value = F.try_element_at(F.col(values), F.col("field"))
    number = F.expr("try_cast(__value as double)")
    joined = joined.withColumn("__value", value)
    known = F.lit(False)
    if registered is not None:
        names = F.broadcast(registered.select(F.lower("name").alias("__name")).distinct().withColumn("__known", F.lit(True)))
        joined = joined.join(names, F.lower("__value") == F.col("__name"), "left")
        known = F.coalesce("__known", F.lit(False))
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    inside = F.coalesce(number >= F.col("low"), F.lit(True)) & F.coalesce(number <= F.col("high"), F.lit(True)) & number.isNotNull()
    status = (
        F.when(~F.col("type").isin("numeric_range", "required", "registry"), "not_applicable")
        .when(F.col("__value").isNull(), "missing")
        .when(F.col("type") == "numeric_range", verdict(inside))
        .when(F.col("type") == "registry", verdict(known))
        .otherwise("pass")
    )
    return joined.withColumn("status", status).drop("__value", "__name", "__known", values)


def decisions(found: DataFrame, id_col: str = "applicant_id") -> DataFrame:
    """applicant_id, decision, reason.

    In this order: a decisive rule fails; an input is missing; a rule fails or does not apply; no decisive rule; all pass.
    """
    has = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    status, decisive = F.col("status"), F.col("decisive")
    verdict = F.when(has((status == "fail") & decisive), "not_eligible").when(has(status == "missing"), "insufficient_information").when(has(status.isin("fail", "not_applicable")), "insufficient_information").when(~has(decisive), "insufficient_information").otherwise("eligible")
    parts = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(": ", "rule_id", "status").alias("t"))))
    return found.groupBy(id_col).agg(verdict.alias("decision"), F.array_join(F.transform(parts, lambda x: x.t), "; ").alias("reason"))


def invalid_rules(rules: DataFrame) -> DataFrame:
    """rule_id, error: schema violations of a rule table, one row each."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("rule_id")) > 1
    checks: list[tuple[Column, str]] = [
        (F.coalesce(F.trim("rule_id") == "", F.lit(True)), "rule_id is blank"),
        (twice, "rule_id is not unique"),
        (~F.col("type").isin("numeric_range", "required", "registry"), "unknown type"),
        ((F.col("type") == "numeric_range") & (F.col("field").isNull() | (F.col("low").isNull() & F.col("high").isNull())), "numeric_range needs a field and a bound"),
        (F.col("low") > F.col("high"), "bounds are in the wrong order"),
    ]
    return rules.select("rule_id", F.array_compact(F.array(*(F.when(c, m) for c, m in checks))).alias("errors")).select("rule_id", F.explode("errors").alias("error"))


def registry_lookup(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """key, entry: the first registry row (by ord) whose id, name or any tag is the key, in any case; null without one."""
    names = registry.select("ord", "id", F.explode(F.array_distinct(F.transform(F.concat(F.array("id", "name"), "tags"), F.lower))).alias("__k"))
    found = keys.select("key").distinct().join(names, F.lower("key") == F.col("__k")).groupBy("key").agg(F.min_by("id", "ord").alias("entry"))
    return keys.join(found, "key", "left")
