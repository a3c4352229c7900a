"""Ordered analytics: segments, spans, blocks, names, top-k, sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacquer.session import cut


def segments(df: DataFrame, by: list[str], order: list[str], label: str, number: str) -> DataFrame:
    """``segment``, counted from 1 in each group: a new one starts where the label changes or the number doesn't rise.

    Numbers are carried over rows without one until the label changes. A hot group is
    split over tasks as in :func:`spread_number`; a part is given the label before it, the
    number carried so far and the segments counted so far.
    """
    w = Window.partitionBy("_part", *by).orderBy(*order)
    at = F.struct(*order)
    d = carry(spread(df, by, order), by, F.max_by(F.struct(label), at), F.last, "_left")
    d = d.withColumn("_prev", F.coalesce(F.lag(F.struct(label)).over(w), F.col("_left")))
    first = F.col("_prev").isNull()
    hard = ~first & ~F.col(label).eqNullSafe(F.col("_prev")[label])
    # what sets the carried number: a number, or a change of label that has none and clears it
    d = d.withColumn("_first", first).withColumn("_hard", hard).withColumn("_set", F.when(F.col(number).isNotNull() | hard, F.struct(F.col(number).alias("no"))))
    d = carry(d, by, F.max_by("_set", F.when(F.col("_set").isNotNull(), at)), lambda v: F.last(v, ignorenulls=True), "_held")
    carried = F.coalesce(F.last("_set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_held"))["no"]
    new = F.when(F.col("_hard") | F.coalesce(F.col(number) <= carried, F.lit(False)) | F.col("_first"), 1).otherwise(0)
    d = carry(d.withColumn("_new", new), by, F.sum("_new"), F.sum, "_off")
    here = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.select(*df.columns, (here + F.coalesce("_off", F.lit(0))).cast("int").alias("segment"))


def leftmost_spans(spans: Column) -> Column:
    """Of array<struct(start, end, ...)> those that overlap no earlier kept one, in order of start, longer first on ties."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    first = F.slice(ordered, 1, 1)
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), first, lambda acc, x: F.when(x["start"] < F.element_at(acc, -1)["end"], acc).otherwise(F.concat(acc, F.array(x))))


def blocks(text: Column, marker: str, least: int = 60) -> Column:
    """The pieces of a text from one marker to the next, each with its marker; those shorter than ``least`` are dropped."""
    return F.filter(F.split(text, rf"(?m)(?={marker})"), lambda b: (F.length(b) >= least) & b.rlike(rf"^(?:{marker})"))


def state_groups(lines: DataFrame, by: str, pos: str, opens: Column) -> DataFrame:
    """``group``: how many opening lines came so far, so that lines belong to the latest one; lines before the first are left out."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("group", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where(F.col("group") > 0)


def spread(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` range-partitioned by group and order, with ``_part``; rows of equal order are in one part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *[F.col(c) for c in [*by, *order]]).withColumn("_part", F.spark_partition_id()))


def carry(d: DataFrame, by: list[str], value: Column, over, out: str) -> DataFrame:
    """``out``: ``over`` the value of each earlier part of the row's group; null in its first part.

    Only a group that goes on into another part has any, so there are fewer than parts.
    """
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    had = d.groupBy("_part", *by).agg(value.alias("_v")).withColumn(out, over(F.col("_v")).over(w)).where(F.col(out).isNotNull())
    had = had.select(F.col("_part").alias("_q"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], out)
    same = F.col("_part") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return d.join(F.broadcast(had), same, "left").drop("_q", *[f"_b{i}" for i in range(len(by))])


def spread_number(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``row_number() over (partition by by order by order)`` that splits a hot group over tasks.

    Rows are range-partitioned by group and order; a row's number is its place in its
    partition plus the group's rows in earlier partitions, of which there is one count
    per group and partition.
    """
    d = carry(spread(df, by, order), by, F.count("*"), F.sum, "_off")
    here = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return d.select(*df.columns, (here + F.coalesce("_off", F.lit(0))).alias(out))


def spread_dense_rank(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``dense_rank() over (partition by by order by order)``, split as in :func:`spread_number`."""
    here = F.dense_rank().over(Window.partitionBy("_part", *by).orderBy(*order))
    d = carry(spread(df, by, order).withColumn("_i", here), by, F.max("_i").cast("bigint"), F.sum, "_off")
    return d.select(*df.columns, (F.col("_i") + F.coalesce("_off", F.lit(0))).alias(out))


def distinct_names(df: DataFrame, facet: str, name: str, extra: str, pos: str, out: str = "unique_name") -> DataFrame:
    """Names that are unique in a facet whatever their case, given out in the order of ``pos`` (unique).

    A row takes the first free one of "name", "name (extra)", "name #2", "name #3" and so
    on. All rows ask at once and a name goes to the earliest that asks for it; those turned
    away ask for their next one, until none is. As the order is the same for all names,
    that ends in what giving them out row by row would give.

    Along the rows of one name the numbers rise, so each asks for the lowest number that
    the rows before it and its own refusals leave, all at once: there are as many rounds
    as names collide in turn, whatever the size of a group.
    """
    by = [facet, "_l"]
    d = df.withColumn("_l", F.lower(name)).withColumn("_stage", F.lit(0)).withColumn("_low", F.lit(2).cast("bigint"))
    tried = F.coalesce(F.trim(F.col(extra)), F.lit("")) != ""
    w = Window.partitionBy("_part", *by).orderBy(pos)
    so_far = lambda c: c.over(w.rowsBetween(Window.unboundedPreceding, 0))
    while True:
        n = carry(spread(d.where("_stage = 2"), by, [pos]), by, F.count("*"), F.sum, "_off")
        n = n.withColumn("_r", F.row_number().over(w) + F.coalesce("_off", F.lit(0))).withColumn("_gap", F.col("_low") - F.col("_r"))
        n = carry(n, by, F.max("_gap"), F.max, "_up").withColumn("_no", F.col("_r") + F.greatest(so_far(F.max("_gap")), F.col("_up")))
        numbered = n.drop("_part", "_off", "_r", "_gap", "_up")
        ask = (
            F.when(F.col("_stage") == 0, F.col(name))
            .when(F.col("_stage") == 1, F.concat(F.col(name), F.lit(" ("), F.col(extra), F.lit(")")))
            .otherwise(F.concat(F.col(name), F.lit(" #"), F.col("_no").cast("string")))
        )
        asked = cut(d.where("_stage < 2").withColumn("_no", F.lit(None).cast("bigint")).unionByName(numbered).withColumn(out, ask).withColumn("_k", F.lower(out)))
        asked = asked.join(asked.groupBy(facet, "_k").agg(F.min(pos).alias("_first")), [facet, "_k"])
        won = F.col(pos) == F.col("_first")
        if asked.where(~won).isEmpty():
            return asked.select(*df.columns, out)
        stage = F.when(won, F.col("_stage")).when((F.col("_stage") == 0) & tried, 1).otherwise(2)
        low = F.when(F.col("_stage") == 2, F.when(won, F.col("_no")).otherwise(F.col("_no") + 1)).otherwise(F.col("_low"))
        d = cut(asked.select(*df.columns, "_l", stage.alias("_stage"), low.alias("_low")))


def year_headers(df: DataFrame, date: str, order: list[str]) -> DataFrame:
    """``header``: the year of ``date`` on each row of an ordered table whose year differs from the row before, else null."""
    d = spread(df.withColumn("_y", F.substring(F.coalesce(F.col(date), F.lit("")), 1, 4)), [], order)
    d = carry(d, [], F.max_by("_y", F.struct(*order)), F.last, "_left")
    before = F.coalesce(F.lag("_y").over(Window.partitionBy("_part").orderBy(*order)), F.col("_left"))
    return d.select(*df.columns, F.when(~F.col("_y").eqNullSafe(before), F.col("_y")).alias("header"))


def top_with_rest(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with ``rank`` and ``more``, how many the group has besides.

    The ranking is limited before its shuffle, so of a hot group only ``k`` rows a task move.
    """
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    total = df.groupBy(*by).agg(F.count("*").alias("_t"))
    return first.join(total, by).withColumn("more", F.greatest(F.col("_t") - k, F.lit(0))).drop("_t")


def natural_key(c: Column) -> Column:
    """A text key that sorts digit runs by value and the rest without case.

    A run is written without leading zeros behind its length, itself written as one
    character, so runs of any length compare by value (up to 50,000 digits).
    """
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    coded = lambda p: F.concat(F.lit("0"), F.lpad(F.length(digits(p)).cast("string"), 5, "0"), digits(p))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), coded(p)).otherwise(p)), "")


def chronological(date: Column, album: Column, number: Column, path: Column) -> list[Column]:
    """Sort columns: date (none last), album, track number, path."""
    return [F.coalesce(F.when(date != "", date), F.lit("9999")), F.coalesce(album, F.lit("")), F.coalesce(number, F.lit(0)), path]


def catalogue_order(system: Column, number: Column) -> list[Column]:
    """Sort columns: system, the number's leading digits by value, the number as text."""
    return [F.coalesce(system, F.lit("")), F.coalesce(F.regexp_extract(number, r"^(\d+)", 1).try_cast("int"), F.lit(0)), F.coalesce(number, F.lit(""))]


def dictionary_codes(df: DataFrame, value: str, pos: str) -> DataFrame:
    """value, code: dense codes of the distinct non-blank values by first appearance.

    The distinct values are ranked by a range-partitioned sort and per-partition offsets,
    not by one window over everything.
    """
    first = df.where(F.trim(F.col(value)) != "").groupBy(F.col(value).alias("value")).agg(F.min(pos).alias("_p"))
    parts = first.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = cut(first.repartitionByRange(int(parts), "_p", "value").sortWithinPartitions("_p", "value").withColumn("_part", F.spark_partition_id()))
    local = ordered.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy("_p", "value")))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("_part", "_off"), "_part").select("value", (F.col("_off") + F.col("_i") - 1).cast("bigint").alias("code"))


def encode_column(df: DataFrame, value: str, codes: DataFrame, out: str) -> DataFrame:
    """``df`` with the code of ``value``, -1 for null and blank."""
    j = df.join(codes.select(F.col("value").alias(value), F.col("code").alias(out)), value, "left")
    return j.withColumn(out, F.coalesce(out, F.lit(-1).cast("bigint")))
