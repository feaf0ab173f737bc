"""Synthetic bulletins from the driver's order tables, as one SQL text for Spark and for DuckDB.

Only integer arithmetic reaches the texts, so that both engines write the same bytes and what a bulletin states is
known from its columns without reading it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dealing import deal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """The driver's tables as temporary views."""
    for n in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def register_dealt(spark: SparkSession, sf_dir: str, name: str, *key: str) -> None:
    """A driver's table as a view whose narrow rows are dealt out before any text is written from them."""
    deal(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *key).createOrReplaceTempView(name)


def facts_sql(duck: bool) -> str:
    """What each bulletin states: one row per order, all columns integers or short strings."""
    day = "strftime(o_orderdate, '%y%m%d')" if duck else "date_format(o_orderdate, 'yyMMdd')"
    iso = "strftime(o_orderdate, '%Y-%m-%d')" if duck else "date_format(o_orderdate, 'yyyy-MM-dd')"
    letter = "chr(cast(65 + o_custkey % 6 as integer))" if duck else "char(65 + o_custkey % 6)"
    return f"""
select cast(o_orderkey as bigint) as circular_id, cast(o_custkey as bigint) as cust,
  concat('GRB ', {day}, {letter}) as event, {iso} as day,
  cast(o_orderkey % 3 as int) as where_named,
  cast(1 + (o_orderkey * 7) % 5000 as int) as z_milli, cast(o_orderkey % 4 as int) as z_kind,
  cast((o_orderkey * 37) % 360000 as int) as ra_milli, cast((o_orderkey * 53) % 170000 as int) - 85000 as dec_milli,
  cast(1200 + (o_orderkey * 11) % 1100 as int) as mag_centi, cast(1 + o_orderkey % 40 as int) as err_centi,
  cast(1 + o_orderkey % 4 as int) as band, cast(1 + o_orderkey % 90 as int) as t_off, cast(o_orderkey % 4 as int) as t_unit,
  cast(greatest(1, o_orderkey - 1 - o_custkey % 5) as bigint) as cites, cast(o_orderkey % 11 as int) as odd,
  cast(o_orderkey % 24 as int) as hh, cast((o_orderkey * 3) % 60 as int) as mi, cast((o_orderkey * 7) % 60 as int) as ss,
  cast(10 + (o_orderkey * 13) % 900 as int) as flux, cast(o_orderkey % 3 as int) as ghz_k
from orders"""


def _pad(x: str, n: int, duck: bool) -> str:
    return f"lpad(cast({x} as {'varchar' if duck else 'string'}), {n}, '0')"


def _fixed(x: str, places: int, duck: bool) -> str:
    """An integer of 10^-places as a decimal text."""
    whole = f"{x} // {10**places}" if duck else f"{x} div {10**places}"
    t = "varchar" if duck else "string"
    return f"concat(cast({whole} as {t}), '.', {_pad(f'{x} % {10**places}', places, duck)})"


def circulars_sql(duck: bool) -> str:
    """Bulletins: circular_id, subject, event_id, created_on, trigger_day, body."""
    f, t = (lambda x, n: _fixed(x, n, duck)), ("varchar" if duck else "string")
    nl = "chr(10)" if duck else "char(10)"
    sign = "case when dec_milli < 0 then '-' else '+' end"
    band = "case band when 1 then 'r' when 2 then 'g' when 3 then 'R' else 'i' end"
    unit = "case t_unit when 0 then ' seconds' when 1 then ' minutes' when 2 then ' hours' else ' days' end"
    kind = "case z_kind when 0 then 'Spectroscopic data give ' when 1 then 'The photometric fit gives ' when 2 then 'From absorption lines we find ' else 'We find ' end"
    return f"""
select circular_id,
  case when odd = 0 then concat('Retraction of ', event) when where_named = 1 then concat(event, ': observations') else 'Optical observations' end as subject,
  case when where_named = 0 then event end as event_id,
  cast(1700000000000 + circular_id * 60000 as bigint) as created_on,
  concat(
    case when where_named = 2 then concat('We observed ', event, ' with our telescope.') else 'We observed the field with the Nordic Optical Telescope.' end, {nl},
    'The position is RA = ', {f('ra_milli', 3)}, ', Dec = ', {sign}, {f('abs(dec_milli)', 3)}, ' (J2000).', {nl},
    case when odd = 1 then concat('No source is seen, ', {band}, ' > ', {f('mag_centi', 2)}, ' (3 sigma).') else concat('We measure ', {band}, ' = ', {f('mag_centi', 2)}, ' +/- ', {f('err_centi', 2)}, ', ', cast(t_off as {t}), {unit}, ' after the trigger.') end, {nl},
    {kind}, case when odd = 2 then concat('z < ', {f('z_milli', 3)}) else concat('z = ', {f('z_milli', 3)}) end, '.', {nl},
    case when odd = 3 then concat('The radio flux density is ', cast(flux as {t}), ' +/- 5 uJy at ', case ghz_k when 0 then '6' when 1 then '10' else '22' end, ' GHz.', {nl}) else '' end,
    'See GCN Circular ', cast(cites as {t}), ' for details.'
  ) as body
from ({facts_sql(duck)}) facts"""


def circulars(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The bulletins, with more of the columns that they are written from."""
    register_dealt(spark, sf_dir, "orders")
    made = circulars_sql(False)
    return spark.sql(made.replace("\nselect circular_id,", "\nselect " + ", ".join(["circular_id", *more]) + ",", 1))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bulletin states, dealt out for texts to be written from it."""
    register_dealt(spark, sf_dir, "orders")
    return spark.sql(facts_sql(False))


def tables(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Bulletins with a table of their lines, an order's lines in one task from the start."""
    register_dealt(spark, sf_dir, "lineitem", "l_orderkey")
    return spark.sql(tables_sql(False, form))


def lines_sql(duck: bool) -> str:
    """Measurements per order from its lines: order, line number, magnitude, error, filter and hours."""
    return """
select cast(l_orderkey as bigint) as circular_id, cast(line as int) as line,
  cast(1300 + (l_partkey * 7) % 900 as int) as mag_centi, cast(1 + l_suppkey % 30 as int) as err_centi,
  cast(1 + l_partkey % 4 as int) as band, cast(1 + line * 3 + l_suppkey % 3 as int) as hours
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as line from lineitem) numbered"""


def tables_sql(duck: bool, form: str) -> str:
    """Bulletins whose body is a table of their lines: form pipe, spaced or fixed."""
    f, t, nl = (lambda x, n: _fixed(x, n, duck)), ("varchar" if duck else "string"), ("chr(10)" if duck else "char(10)")
    band = "case band when 1 then 'r' when 2 then 'g' when 3 then 'R' else 'i' end"
    cells = {
        "pipe": f"concat('| ', cast(hours as {t}), ' | ', {band}, ' | ', {f('mag_centi', 2)}, ' +/- ', {f('err_centi', 2)}, ' |')",
        "spaced": f"concat('2024-01-', lpad(cast(1 + line as {t}), 2, '0'), '  ', {band}, '  ', {f('mag_centi', 2)}, '  ', {f('err_centi', 2)})",
        "fixed": f"concat('2024-01-', lpad(cast(1 + line as {t}), 2, '0'), ' 03:04:05  0.', lpad(cast(hours as {t}), 3, '0'), '  3*60  ', {band}, '  ', {f('mag_centi', 2)}, '  ', {f('err_centi', 2)})",
    }[form]
    head = {"pipe": "| Tmid-T0 (h) | Filter | Mag (AB) |", "spaced": "Date  Filter  Mag  Err", "fixed": "Date  UTstart  t-T0  Exp  Filter  mag  err"}[form]
    joined = f"string_agg(cell, {nl} order by line)" if duck else f"array_join(transform(array_sort(collect_list(struct(line, cell))), x -> x.cell), {nl})"
    return f"""
select circular_id, 'Photometry' as subject, cast(null as {t}) as event_id, cast(0 as bigint) as created_on, concat('{head}', {nl}, {joined}) as body
from (select circular_id, line, {cells} as cell from ({lines_sql(duck)}) l) c group by circular_id"""
