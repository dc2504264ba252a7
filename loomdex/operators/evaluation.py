"""Answer metrics over pairs of texts. Multisets are counted per gram, so repeats weigh as they should."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.functions.binding import bound


def exact_match(prediction: Column, reference: Column) -> Column:
    return (T.normal_words(prediction) == T.normal_words(reference)).cast("double")


SCORES = "id long, precision double, recall double, f1 double"


def _scored(pairs: DataFrame, id_col: str, shared) -> DataFrame:
    """Scores of two lists of a row by shared(p, r) -> (in both, of the prediction, of the reference). Narrow: a row holds both texts."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, p, r in pdf.itertuples(index=False):
                s, n_p, n_r = shared(list(p), list(r))
                precision, recall = s / n_p if n_p else 0.0, s / n_r if n_r else 0.0
                rows.append((i, precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0))
            yield pd.DataFrame(rows, columns=["id", "precision", "recall", "f1"])

    words = lambda c: T.word_list(F.coalesce(F.col(c), F.lit("")))
    return pairs.select(F.col(id_col).alias("id"), words("prediction"), words("reference")).mapInPandas(run, SCORES)


def ngram_scores(pairs: DataFrame, n: int = 1, id_col: str = "id") -> DataFrame:
    """id, precision, recall, f1 of multisets of word n-grams. pairs: id, prediction, reference. Nothing shared: zeros."""

    def shared(p, r):
        x, y = (Counter(zip(*(w[k:] for k in range(n)), strict=False)) for w in (p, r))
        return (x & y).total(), x.total(), y.total()

    out = _scored(pairs, id_col, shared)
    return out.select(F.col("id").alias(id_col), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def containment(answer: Column, evidence: Column, n: int) -> Column:
    """Share of the answer's distinct word n-grams that the evidence holds; n shrinks to the answer's length."""
    return groundedness(answer, F.array(evidence), n)


def groundedness(answer: Column, evidence: Column, n: int = 4) -> Column:
    """Share of the answer's distinct word n-grams that any text of an array holds; n shrinks to the answer's length. Nothing: 0."""

    def share(a: Column, width: Column) -> Column:
        held = F.flatten(F.transform(evidence, lambda t: bound(T.word_list(t), lambda w: T.runs(w, width, n))))
        part = lambda own: F.try_divide(F.size(F.array_intersect(own, held)).cast("double"), F.size(own).cast("double"))
        return F.when(F.size(a) > 0, F.coalesce(bound(F.array_distinct(T.runs(a, width, n)), part), F.lit(0.0))).otherwise(F.lit(0.0))

    return bound(T.word_list(answer), lambda a: bound(F.greatest(F.least(F.lit(n), F.size(a)), F.lit(1)), lambda width: share(a, width)))


def domain_adherence(refused: Column, expected: Column) -> Column:
    """1 where an answer is refused just when it should be."""
    return (F.coalesce(refused, F.lit(False)) == F.coalesce(expected, F.lit(False))).cast("double")


def generation_summary(records: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: means of the in-domain answers, rounded to 4 digits, how many of them cite what they were not given, and how
    often the others are refused as they should. records: in_domain, domain_adherence, n_fabricated and the metrics."""
    own, other = F.col("in_domain"), ~F.col("in_domain")
    mean = lambda c, where: F.round(F.coalesce(F.avg(F.when(where, F.col(c))), F.lit(0.0)), 4)
    return records.agg(
        F.count_if(own).alias("in_domain_count"), F.count_if(other).alias("out_of_domain_count"), F.count_if(own & (F.col("n_fabricated") > 0)).alias("fabricated_question_count"),
        F.round(F.coalesce(F.avg(F.when(other, (F.col("domain_adherence") == 1).cast("double"))), F.lit(0.0)), 4).alias("refusal_accuracy"), *(mean(m, own).alias(m) for m in metrics),
    )


def deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """metric, base, other, delta (4 digits) of two tables of metric and value; null where one of them lacks the metric."""
    sides = base.select("metric", F.col("value").alias("base")).join(other.select("metric", F.col("value").alias("other")), "metric", "full_outer")
    return sides.select("metric", "base", "other", F.round(F.col("other") - F.col("base"), 4).alias("delta"))


def longest_common(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """id, precision, recall, f1 of the longest common subsequence of words (ROUGE-L), one word of the prediction at a time
    against all of the reference, whose places are bits of one number."""

    def shared(p, r):
        at: dict[str, int] = {}
        for j, y in enumerate(r):
            at[y] = at.get(y, 0) | 1 << j
        full = (1 << len(r)) - 1
        open_ = full
        for x in p:
            hit = open_ & at.get(x, 0)
            open_ = (open_ + hit | open_ - hit) & full
        return len(r) - open_.bit_count(), len(p), len(r)

    return _scored(pairs, id_col, shared)


def fabricated_urls(answer: Column, evidence_urls: Column) -> Column:
    return F.filter(T.urls_in(answer), lambda u: ~F.array_contains(evidence_urls, u))


def summarise(scores: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Means, rounded to 4 digits, overall and by each of some columns, in one pass of grouping sets."""
    sets = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in metrics]
    return scores.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), *sets)
