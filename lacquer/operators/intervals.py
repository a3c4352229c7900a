"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Method. A mergeable aggregate: its state is a sorted list of disjoint half-open
intervals, two states combine by a linear merge, and states are combined in a reduction
tree (year of the start, decade, entity). Before anything is shuffled, intervals of one
entity with equal start are reduced to the longest, which loses nothing and bounds what
one entity can hold by the number of distinct days; so an entity with a third of all
rows is combined on the map side and never gathered row by row. Periods are the final
lists; gaps are their complement between the first start and the last end.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The end of an interval without one (fixed value).
OPEN_END = "9999-12-31"
_DATE = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_day(c: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` as the first day it covers; null for anything else."""
    t = _trim(c)
    return F.when(t.rlike(_DATE), F.when(F.length(t) == 4, F.concat(t, F.lit("-01-01"))).when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(t))


def merged(lists) -> list[tuple]:
    """The disjoint union of sorted lists of (from, to) by one linear merge; touching intervals join."""
    out: list[tuple] = []
    for f, t in heapq.merge(*lists):
        if out and f <= out[-1][1]:
            if t > out[-1][1]:
                out[-1] = (out[-1][0], t)
        else:
            out.append((f, t))
    return out


def merge_lists(lists: Column, kind: str) -> Column:
    """Array of sorted interval lists (structs f, t) as their one disjoint list.

    Built-in array functions would copy the finished list at every step.
    """

    @F.arrow_udf(f"array<struct<f:{kind},t:{kind}>>")
    def run(column: pa.Array) -> pa.Array:
        out = [[{"f": f, "t": t} for f, t in merged([[(x["f"], x["t"]) for x in one] for one in ls])] for ls in column.to_pylist()]
        return pa.array(out, type=column.type.value_type)

    return run(lists)


def interval_union(df: DataFrame, entity: list[str], start: str, end: str, levels: list[Column]) -> DataFrame:
    """``entity`` and ``periods``, the sorted disjoint union of its half-open intervals.

    ``levels`` are the nested buckets of the reduction tree, finest first, as columns of
    ``_f`` (the start). Rows with a null bound or start >= end cover nothing; entities
    without any interval give no row; a null entity is one entity of its own.
    """
    kind = dict(df.select(F.col(start).alias("x")).dtypes)["x"]
    names = [f"_e{i}" for i in range(len(entity))]
    rows = df.select(*[F.col(e).alias(n) for e, n in zip(entity, names, strict=True)], F.col(start).alias("_f"), F.col(end).alias("_t"))
    longest = rows.where(F.col("_f") < F.col("_t")).groupBy(*names, "_f").agg(F.max("_t").alias("_t"))
    keys = [f"_l{i}" for i in range(len(levels))]
    state = longest.select(*names, *[c.alias(k) for c, k in zip(levels, keys, strict=True)], F.array(F.struct(F.col("_f").alias("f"), F.col("_t").alias("t"))).alias("s"))
    for depth in range(len(levels) + 1):
        by = names + keys[depth:]
        joined = state.groupBy(*by).agg(F.collect_list("s").alias("s"))
        state = joined.select(*by, merge_lists(F.col("s"), kind).alias("s"))
    return state.select(*[F.col(n).alias(e) for n, e in zip(names, entity, strict=True)], F.col("s").alias("periods"))


def periods_and_gaps(unions: DataFrame, entity: list[str], start: str = "from_date", end: str = "to_date") -> DataFrame:
    """The lists of :func:`interval_union` as rows: kind ``period`` or ``gap``."""
    p = F.col("periods")
    gaps = F.transform(
        F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
        lambda x, i: F.struct(F.lit("gap").alias("kind"), F.element_at(p, (i + 1).cast("int"))["t"].alias("f"), x["f"].alias("t")),
    )
    periods = F.transform(p, lambda x: F.struct(F.lit("period").alias("kind"), x["f"].alias("f"), x["t"].alias("t")))
    rows = unions.select(*entity, F.explode(F.concat(periods, gaps)).alias("_x"))
    return rows.select(*entity, F.col("_x.kind").alias("kind"), F.col("_x.f").alias(start), F.col("_x.t").alias(end))


def dated_periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Periods and gaps of intervals whose bounds are partial ISO dates.

    Partial dates mean their first day. A null or blank end is open (``9999-12-31``). A
    null, blank or malformed start, a malformed end and a start not before the end cover
    nothing. Touching intervals are continuous; repeated rows change nothing.
    """
    to = F.when(F.coalesce(_trim(F.col(end)), F.lit("")) == "", F.lit(OPEN_END)).otherwise(first_day(F.col(end)))
    rows = df.select(F.col(entity), first_day(F.col(start)).alias("_from"), to.alias("_to"))
    tree = [F.substring("_f", 1, 4), F.substring("_f", 1, 3)]
    return periods_and_gaps(interval_union(rows, [entity], "_from", "_to", tree), [entity])


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of every band in lineups."""
    lineups = spark.read.parquet(f"{sf_dir}/lineups.parquet").select("band_id", "from_date", "to_date")
    return dated_periods(lineups, "band_id", "from_date", "to_date")


P6_SQL = """
WITH iv AS (
  SELECT band_id,
    CASE length(trim(from_date)) WHEN 4 THEN trim(from_date) || '-01-01' WHEN 7 THEN trim(from_date) || '-01' WHEN 10 THEN trim(from_date) END AS f,
    CASE WHEN coalesce(trim(to_date), '') = '' THEN '9999-12-31'
         WHEN length(trim(to_date)) = 4 THEN trim(to_date) || '-01-01' WHEN length(trim(to_date)) = 7 THEN trim(to_date) || '-01' WHEN length(trim(to_date)) = 10 THEN trim(to_date) END AS t
  FROM lineups),
ok AS (SELECT DISTINCT * FROM iv WHERE f < t),
m AS (SELECT *, max(t) OVER (PARTITION BY band_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ok),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR f > seen THEN 1 ELSE 0 END) OVER (PARTITION BY band_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT band_id, grp, min(f) AS f, max(t) AS t FROM g GROUP BY band_id, grp),
gaps AS (SELECT band_id, lag(t) OVER (PARTITION BY band_id ORDER BY f) AS f, f AS t FROM p)
SELECT band_id, 'period' AS kind, f AS from_date, t AS to_date FROM p
UNION ALL
SELECT band_id, 'gap' AS kind, f AS from_date, t AS to_date FROM gaps WHERE f IS NOT NULL
"""
