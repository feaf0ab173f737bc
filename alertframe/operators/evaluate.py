"""Evaluation: comparison of predictions with gold, metrics and run telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import eval_text

# How far numbers may differ.
TOLERANCE = {"redshift": 0.01, "ra": 0.01, "dec": 0.01, "mag": 0.05, "limit": 0.2, "offset": 0.5}


def outcome(gold: Column, pred: Column, equal: Column) -> Column:
    """TN, FP, FN, TP, or MM where both are there and differ."""
    return (
        F.when(gold.isNull() & pred.isNull(), "TN").when(gold.isNull(), "FP").when(pred.isNull(), "FN").when(equal, "TP").otherwise("MM")
    )


def text_outcome(gold: Column, pred: Column) -> Column:
    return outcome(gold, pred, eval_text(gold) == eval_text(pred))


def number_outcome(gold: Column, pred: Column, tolerance: float) -> Column:
    return outcome(gold, pred, F.abs(gold - pred) <= tolerance)


def names_outcome(gold: Column, pred: Column) -> Column:
    """Lists of event names agree if they share one."""
    none = lambda x: F.when(F.size(x) > 0, x)
    return outcome(none(gold), none(pred), F.arrays_overlap(gold, pred))


def join_gold(pred: DataFrame, gold: DataFrame, key: str = "circular_id", order: str = "ord") -> DataFrame:
    """Predictions with their gold (the last of several); predictions without gold go, gold without prediction too."""
    last = gold.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n", order)
    return pred.join(last, key)


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def _greedy(gold: Column, pred: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """tp, fp, fn of two arrays: each gold row takes the first free prediction that fits it."""

    def step(a: Column, g: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(pred) - 1), lambda i: ~F.array_contains(a["used"], i) & fits(g, F.get(pred, i)))
        hit = F.get(free, F.lit(0))
        return F.struct(F.when(hit.isNotNull(), F.array_append(a["used"], hit)).otherwise(a["used"]).alias("used"), (a["tp"] + F.when(hit.isNotNull(), 1).otherwise(0)).alias("tp"))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"))
    tp = F.when((F.size(gold) > 0) & (F.size(pred) > 0), F.aggregate(gold, start, step, lambda a: a["tp"])).otherwise(0)
    return F.struct(tp.alias("tp"), (F.size(pred) - tp).alias("fp"), (F.size(gold) - tp).alias("fn"))


def greedy_matches(gold: Column, pred: Column) -> Column:
    """Measurements (filter, mag, lim): the same filter, and magnitudes or limits that are near."""
    near = lambda g, p, c, t: _near(g[c], p[c], TOLERANCE[t])
    return _greedy(gold, pred, lambda g, p: g["filter"].eqNullSafe(p["filter"]) & (near(g, p, "mag", "mag") | near(g, p, "lim", "limit")))


def greedy_offsets(gold: Column, pred: Column) -> Column:
    """Time offsets (value, unit): the same unit, and values that are near."""
    return _greedy(gold, pred, lambda g, p: (g["unit"] == p["unit"]) & _near(g["value"], p["value"], TOLERANCE["offset"]))


def binary_f1(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: precision, recall and f1 of labels (null: abstains); 0 without a denominator. A wrong label is a false
    positive and a false negative."""
    g, p = F.col(gold), F.col(pred)
    n = lambda c: F.count(F.when(c, 1))
    counts = rows.agg(n(g == p).alias("tp"), n(p.isNotNull() & ~g.eqNullSafe(p)).alias("fp"), n(g.isNotNull() & ~g.eqNullSafe(p)).alias("fn"))
    part = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    both = counts.select("tp", "fp", "fn", part("tp", "fp").alias("precision"), part("tp", "fn").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def usage(runs: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens in and out, and cost per group of a run's telemetry; nulls count as nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), total("tokens_in"), total("tokens_out"), total("cost_usd"))


def ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; null where they have no denominator, F1 also where both are 0."""
    p, r = F.when(tp + fp != 0, tp / (tp + fp)), F.when(tp + fn != 0, tp / (tp + fn))
    return {"precision": p, "recall": r, "f1": F.when(p + r != 0, 2 * p * r / (p + r)), "support": tp + fn}


def metrics(comparisons: DataFrame, *by: str) -> DataFrame:
    """Counts and ratios per field; MM is a false positive and a false negative."""
    n = lambda *kinds: F.sum(F.when(F.col("outcome").isin(*kinds), 1).otherwise(0)).cast("long")
    counts = comparisons.groupBy(*by).agg(n("TP").alias("tp"), n("FP", "MM").alias("fp"), n("FN", "MM").alias("fn"), n("TN").alias("tn"))
    return counts.withColumns(ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def first_failures(comparisons: DataFrame, field: str, order: str, k: int = 5) -> DataFrame:
    """The first k failures of each field in arrival order."""
    w = Window.partitionBy(field).orderBy(order)
    return comparisons.filter(F.col("outcome").isin("FP", "FN", "MM")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """p50 and p95 as the element at n div 2 and at min(n - 1, int(0.95 n)) of the sorted values.

    From one row per distinct value and a running count, so that repeats cost nothing and no group is one row's array.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    upto = counts.withColumns({"_to": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    at = lambda i: F.min(F.when(F.col("_to") > i, F.col(value)))
    return upto.groupBy(group).agg(at(F.floor(F.col("_n") / 2)).alias("p50"), at(F.least(F.col("_n") - 1, F.floor(F.col("_n") * 95 / 100))).alias("p95"))


def within_budget(df: DataFrame, group: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Items taken while what was spent strictly before them is under the budget."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("spent_before", before).filter(F.col("spent_before") < budget)
