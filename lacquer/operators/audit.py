"""Data-quality checks, each a (severity, check, n, examples) row; all checks of a table share one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, label: Column, rules: list[tuple[str, str, Column]], examples: int = 5) -> DataFrame:
    """Counts and the smallest few examples of rows that break each rule, in a single pass.

    Examples are kept by a bounded aggregate, never gathered.
    """
    arms = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("check"))) for s, n, c in rules])
    hits = df.select(F.explode(F.filter(arms, lambda x: x.isNotNull())).alias("x"), label.alias("l")).select("x.*", "l")
    return counted(hits, [(s, n) for s, n, _ in rules], examples)


def counted(hits: DataFrame, names: list[tuple[str, str]], examples: int = 5) -> DataFrame:
    """Rows (severity, check, l) as counts with examples; checks without a hit have 0."""
    from pyspark.sql import Window

    spark = hits.sparkSession
    per = hits.groupBy("severity", "check", "l").agg(F.count("*").alias("k"))
    total = per.groupBy("severity", "check").agg(F.sum("k").alias("n"))
    few = per.withColumn("r", F.row_number().over(Window.partitionBy("severity", "check").orderBy("l"))).where(F.col("r") <= examples)
    shown = few.groupBy("severity", "check").agg(F.array_join(F.array_sort(F.collect_list("l")), "; ").alias("examples"))
    every = spark.createDataFrame(names, "severity string, check string")
    out = every.join(total, ["severity", "check"], "left").join(shown, ["severity", "check"], "left")
    return out.select("severity", "check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def exit_code(report: DataFrame) -> DataFrame:
    """Totals by severity and the process's exit code, the serious ones up to 250."""
    t = report.groupBy("severity").agg(F.sum("n").alias("n"))
    return t.withColumn("exit_code", F.when(F.col("severity") == "HIGH", F.least("n", F.lit(250))).otherwise(F.lit(0)))


JUNK_TITLE = r"(?i)^(?:track|untitled|audio|unknown|cd\d)"


def junk_title(title: Column) -> Column:
    t = F.trim(title)
    return (t == "") | t.rlike(r"^[\d\W_]+$") | t.rlike(JUNK_TITLE) | (F.length(t) <= 2)
