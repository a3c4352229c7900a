"""Reconciling with outside sources: prefilters, coverage scores, states, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacquer.operators.ordered import spread_number


def plausible_count(ours: Column, theirs: Column) -> Column:
    """Whether an outside track count can belong to ours; an unknown one can."""
    return theirs.isNull() | ((theirs >= 0.7 * ours) & (theirs <= F.greatest(4 * ours, ours + 30)))


def coverage_ratio(hits: Column, size: Column) -> Column:
    return hits / F.greatest(size, F.lit(1))


def best_result(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """The result of the highest score, the first on ties; a result without a score is never chosen."""
    cols = [c for c in df.columns if c != key]
    best = df.where(F.col(score).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(score), -F.col(pos))).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in cols])


def facts(df: DataFrame, key: str, fact: str) -> DataFrame:
    """A source's facts by key as rows: key, fact, n and place, commonest first and then smallest."""
    n = df.where(F.trim(F.col(fact)) != "").groupBy(key, F.col(fact).alias("fact")).agg(F.count("*").alias("n"))
    return spread_number(n.withColumn("_o", -F.col("n")), [key], ["_o", "fact"], "place").drop("_o")


def score_stage(proposals: DataFrame, current: DataFrame, key: str, value: str, overwrite: bool = False, threshold: float = 0.95) -> DataFrame:
    """Proposals with their ``stage``: same, would overwrite, apply or review."""
    j = proposals.join(current.select(key, F.col(value).alias("_now")), key, "left")
    now = F.trim(F.coalesce("_now", F.lit(""))) != ""
    fine = (F.col("state") == "corroborated") | (F.col("strength") >= threshold)
    stage = (
        F.when(F.col("best") == F.col("_now"), "same")
        .when(F.col("state") == "contested", "contested")
        .when(now & F.lit(not overwrite), "would overwrite")
        .when(fine, "apply")
        .otherwise("review")
    )
    return j.withColumn("stage", stage).drop("_now")


#: Order of the stages on a decision sheet.
STAGES = ["contested", "review", "would overwrite", "apply", "same"]


def decision_sheet(scored: DataFrame) -> DataFrame:
    """Scored proposals in the order in which a human looks at them; private columns are left out."""
    rank = F.array_position(F.lit(STAGES), F.col("stage"))
    return scored.drop(*[c for c in scored.columns if c.startswith("_")]).orderBy(F.when(rank > 0, rank).otherwise(99))


def source_state(found: Column, source_date: Column, folder_date: Column, precision: Column) -> Column:
    """How an outside session list stands to our date."""
    return (
        F.when(~found, "no match")
        .when(source_date == folder_date, "confirmed")
        .when(folder_date.isNotNull() & (precision == "day"), "folder date kept")
        .when(folder_date.isNotNull(), "corrected")
        .otherwise("supplied")
    )


def undecided(proposals: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Proposals nobody has decided on yet."""
    return proposals.join(decisions.select(key), key, "left_anti")


def changes(proposals: DataFrame, proposed: str, current: str) -> DataFrame:
    """Proposals whose value differs from the current one; a missing current value differs."""
    return proposals.where(F.col(proposed).isNotNull() & ~F.col(proposed).eqNullSafe(F.col(current)))


def eligible(releases: DataFrame, done: DataFrame, key: str, count: str, text: str | None = None, most: int | None = None) -> DataFrame:
    """Releases that may be asked for: two tracks or more, not asked yet, holding ``text`` in their path.

    ``most`` is the size of a batch of lookups, taken in the order of the key; the rest
    stays eligible and comes with the next batch.
    """
    r = releases.where(F.col(count) >= 2).join(done.select(key), key, "left_anti")
    if text:
        r = r.where(F.lower("path").contains(text.lower()))
    return r.orderBy(key).limit(most) if most else r


def date_agreement(ours: Column, theirs: Column) -> Column:
    """How an outside recording date stands to ours, compared to the day: no local date, agree or DIFFER; null without an outside one."""
    a, b = F.substring(ours, 1, 10), F.substring(theirs, 1, 10)
    n = F.least(F.length(a), F.length(b))
    return F.when(theirs.isNotNull(), F.when(F.coalesce(a, F.lit("")) == "", "no local date").when(F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n), "agree").otherwise("DIFFER"))


def search_winner(asked: DataFrame, key: str, order: str, ratio: str, enough: float = 0.90, evaluated: int = 5) -> DataFrame:
    """The accepted answer of each search: queries in their ``order``, stopping at the first whose best ratio is ``enough``.

    Of every query the ``evaluated`` best answers by ``rank`` count. The winner has the
    highest ratio of those asked until then, the first on ties. All answers are rows
    already, so the early stop only decides which of them may win.
    """
    seen = asked.where(F.col("rank") <= evaluated)
    stop = seen.where(F.col(ratio) >= enough).groupBy(key).agg(F.min(order).alias("_stop"))
    cols = [c for c in asked.columns if c != key]
    open_ = seen.join(stop, key, "left").where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
    best = open_.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(ratio), -F.col(order), -F.col("rank"))).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in cols])


def report_join(manifest: DataFrame, answers: DataFrame, path: str, title: str, date: str, order: str) -> DataFrame:
    """Manifest rows with the first answer by path, else the first by title (whatever its case)."""
    by_path = answers.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("_p")).agg(F.min_by(F.struct(date), order)[date].alias("_d1"))
    by_title = answers.where(F.trim(F.col(title)) != "").groupBy(F.lower(title).alias("_t")).agg(F.min_by(F.struct(date), order)[date].alias("_d2"))
    j = manifest.join(by_path, manifest[path] == F.col("_p"), "left").join(by_title, F.lower(manifest[title]) == F.col("_t"), "left")
    return j.withColumn("outside_date", F.coalesce("_d1", "_d2")).drop("_p", "_d1", "_t", "_d2")
