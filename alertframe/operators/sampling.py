"""Strata, stratified samples, strides, splits and chat examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _within(reach: int, *parts: str) -> str:
    """Parts in this order, each at most so far behind the one before."""
    return rf".{{0,{reach}}}".join(f"(?:{p})" for p in parts)


_BANDS = "|".join((*"rgiRIVBUJHK", "clear"))
# The strata in the order in which they are tried, and in which they are listed.
STRATA = {
    "multi_row_mag_table": "(?isU)" + _within(40, "date|mjd|epoch", "filter|band", "mag"),
    "gw_neutrino_counterpart": r"(?iU)(?<!\w)(?:(?:gw\s?|s)\d{6}|icecube[-\s]?\d|" + r"counterpart\s+to\s+(?:the\s+)?(?:gw|the\s+neutrino|neutrino))",
    "spec_z_classification": "(?isU)" + _within(200, r"(?<!\w)spectro(?:scop|metr|graph)", r"z\s*[=~≈]\s*\d|redshift\s+of\s+\d"),
    "photometric_upper_limit": r"(?iU)(?<!\w)\d+(?:\.\d+)?\s*[-–]?\s*sigma\s+upper\s+limit|(?<=\w)>\s*\d{1,2}\.\d|(?<!\w)m\s*>\s*\d",
    "single_row_mag": rf"(?U)(?<!\w)(?:{_BANDS})\s*[=~]\s*\d{{1,2}}\.\d",
}
LISTED = ("single_row_mag", "multi_row_mag_table", "spec_z_classification", "photometric_upper_limit", "gw_neutrino_counterpart")


def stratum(body: Column) -> Column:
    return F.coalesce(*(F.when(body.rlike(form), F.lit(name)) for name, form in STRATA.items()))


def stratified_sample(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """Up to n rows per group by the order of a seeded hash: the same rows on any cluster."""
    w = Window.partitionBy(group).orderBy(F.sha1(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.filter(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def listed(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, stratum) in the order of the strata's list, then of the key."""
    place = F.array_position(F.array(*map(F.lit, LISTED)), F.col("stratum"))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(LISTED) + 1), key)


def stride(rows: DataFrame, group: str, order: str, step: int) -> DataFrame:
    """Every step-th row of each group from the first on."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).filter(F.col("_n") % step == 0).drop("_n")


def split(rows: DataFrame, group: str, order: str, val_every: int) -> DataFrame:
    """split: val for every val_every-th row of each group, else train."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("split", F.when(n % val_every == 0, "val").otherwise("train"))


def has_signal(found: DataFrame) -> DataFrame:
    """Extractions that have anything to learn from."""
    some = [F.col(c).isNotNull() for c in ("redshift", "classification", "localization")] + [F.size(c) > 0 for c in ("photometry", "time_offsets")]
    out = some[0]
    for s in some[1:]:
        out = out | s
    return found.filter(out)


def chat_examples(circulars: DataFrame, found: DataFrame, instruction: str) -> DataFrame:
    """circular_id, prompt and target JSON without bookkeeping."""
    target = F.to_json(F.struct(*(c for c in found.columns if c not in ("circular_id", "provenance", "extraction_meta"))), {"ignoreNullFields": "true"})
    prompt = F.concat(F.lit(instruction + "\n\n"), F.coalesce("body", F.lit("")))
    return circulars.select("circular_id", prompt.alias("prompt")).join(found.select("circular_id", target.alias("target")), "circular_id")
