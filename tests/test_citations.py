"""Bulletins of numbers beyond seven digits are cited like any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertframe.functions import scalars as S
from alertframe.text import names


def test_long_numbers(spark):
    text = "See GCN 35999999, GCN Circular 216000001 and gcn 12."
    assert [x["id"] for x in names.find_xrefs(text)] == [35999999, 216000001, 12]
    assert spark.range(1).select(S.xrefs(F.lit(text)).alias("x")).first().x == [35999999, 216000001, 12]
