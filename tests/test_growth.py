"""Plans whose cost must not grow faster than their input: dealing, and joins of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from __spark_entry__ import queries
from alertframe import dealing
from alertframe.operators import extract, tools
from alertframe.plans.coverage import _context
from alertframe.synth import circulars, tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_joined_texts_are_dealt(spark):
    """A join's estimated size is no reason to parse all its texts in one task."""
    texts = spark.createDataFrame([(k, "", "z = 1.5") for k in range(8)], "circular_id long, subject string, body string")
    joined = texts.join(texts.select("circular_id"), "circular_id")
    assert not dealing.dealt(joined) and "Repartition" in _plan(extract.extract(joined, fields=("redshift",)))


def test_rows_are_dealt_before_texts_are_written(spark):
    for texts in (circulars(spark, SF), tables(spark, SF, "pipe")):
        assert dealing.dealt(texts) and _plan(extract.extract(texts)).count("Repartition") == 1


def test_records_are_not_broadcast(spark):
    plan = queries()["chat_examples"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_tools_parse_in_full_what_they_are_asked_for(spark):
    ctx, name = _context(spark, SF)
    rows = tools.find_counterparts(ctx, name)
    assert ctx.store is None and ctx.names.columns == ["circular_id", "primary_event", "ra", "dec"]
    assert "LeftSemi" in _plan(rows) and rows.filter(F.col("follow_up").isNull()).isEmpty()
    assert tools.extract_properties(ctx, 3).count() == 1 and tools.find_counterparts(ctx, name).count() == rows.count()
