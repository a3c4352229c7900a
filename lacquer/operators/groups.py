"""Grouping: majority votes, roll-ups, merges, duplicates, facets, claims.

"First" always means the smallest value of an explicit position column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacquer.operators.ordered import spread_number


def majority(df: DataFrame, by: list[str], value: str, pos: str, out: str = "value") -> DataFrame:
    """The commonest non-blank value of each group, ties to the one seen first.

    Two map-side combined aggregates, so a hot group is counted where its rows are.
    """
    n = df.where(F.trim(F.col(value).cast("string")) != "").groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(pos).alias("_p"))
    return n.groupBy(*by).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_p"))).alias(out))


def majorities(df: DataFrame, by: str, values: list[str], pos: str) -> DataFrame:
    """Several majority votes at once: one row per group, one column per value."""
    long = df.select(by, pos, F.explode(F.array(*[F.struct(F.lit(v).alias("f"), F.col(v).cast("string").alias("v")) for v in values])).alias("x")).select(by, pos, "x.f", "x.v")
    won = majority(long, [by, "f"], "v", pos, "v")
    return won.groupBy(by).pivot("f", values).agg(F.first("v"))


def first_row(df: DataFrame, by: list[str], pos: str, cols: list[str]) -> DataFrame:
    """The scalars of each group's first row."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*cols), F.col(pos)).alias("_f")).select(*by, *[F.col(f"_f.{c}").alias(c) for c in cols])


def sorted_set(c: str | Column) -> Column:
    return F.array_sort(F.collect_set(c))


def merge_works(works: DataFrame, bucket: list[str], work: str, mark: str, size: str) -> DataFrame:
    """Works of one bucket become one unless they bear two different catalogue marks.

    Returns work, survivor: the marked work, else the largest, the first id on ties.
    Works whose last bucket column is blank stay alone.
    """
    facts = works.groupBy(*bucket).agg(F.count_distinct(mark).alias("_marks"), F.min_by(work, F.struct(F.col(mark).isNull(), -F.col(size), F.col(work))).alias("_s"))
    joined = works.join(facts, bucket, "left")
    together = (F.col("_marks") <= 1) & (F.col(bucket[-1]) != "")
    return joined.select(work, F.when(together, F.col("_s")).otherwise(F.col(work)).alias("survivor"))


def member_print(member: Column) -> list[Column]:
    """Aggregates that are equal for equal multisets of members: how many, and the sum and the exclusive or of two hashes.

    They are combined on the map side, so no group is ever gathered.
    """
    return [
        F.count("*").alias("n"),
        F.sum(F.xxhash64(F.lit("a"), member).cast("decimal(38,0)")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("b"), member)).alias("h2"),
    ]


def clusters(df: DataFrame, rules: list[tuple[str, str, Column]], member: str, size: str) -> DataFrame:
    """Clusters of members with an equal key under one of several rules, the earlier rule winning.

    ``rules`` are (kind, confidence, key column); a null or blank key is none. Two rules
    that give the same members give one cluster. Columns: kind, confidence, key, n,
    first_member, last_member, reclaimable (all sizes but the largest). The members of a
    cluster are the rows with its key: see :func:`cluster_members`.
    """
    keyed = cluster_members(df, rules, member, size)
    g = keyed.groupBy("prio", "kind", "confidence", "key").agg(
        *member_print(F.col("member")), F.min("member").alias("first_member"), F.max("member").alias("last_member"), (F.sum(F.coalesce("size", F.lit(0))) - F.max(F.coalesce("size", F.lit(0)))).alias("reclaimable")
    )
    cols = ["kind", "confidence", "key", "first_member", "last_member", "reclaimable"]
    best = g.where("n > 1").groupBy("n", "h1", "h2").agg(F.min_by(F.struct(*cols), F.struct("prio", "key")).alias("b"))
    return best.select("n", "b.*")


def cluster_members(df: DataFrame, rules: list[tuple[str, str, Column]], member: str, size: str) -> DataFrame:
    """One row per member and rule that gives it a key: prio, kind, confidence, key, member, size."""
    arms = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(k).alias("kind"), F.lit(c).alias("confidence"), key.cast("string").alias("key")) for i, (k, c, key) in enumerate(rules)])
    rows = df.select(F.col(member).alias("member"), F.col(size).cast("bigint").alias("size"), F.explode(arms).alias("x"))
    return rows.select("x.*", "member", "size").where("key is not null and key <> ''")


def multiset_key(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """n, h1, h2 of each group: groups with the same rows, copies included, have the same."""
    return df.groupBy(by).agg(*member_print(F.struct(*cols)))


def decades(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def _named(facet: str):
    def pair(v: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), F.coalesce(v.cast("string"), F.lit("Unknown")).alias("value"))

    return pair


def facet_counts(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """facet, value, n: rows by each facet's value; array facets count every value, nulls are ``Unknown``.

    One pass: every row spreads into its facet values and is counted on the map side.
    """
    types = dict(df.select(*[c.alias(k) for k, c in facets.items()]).dtypes)
    arms = []
    for k, c in facets.items():
        vals = F.array_distinct(c) if types[k].startswith("array") else F.array(c.cast("string"))
        vals = F.when(F.size(vals) > 0, vals).otherwise(F.array(F.lit(None).cast("string"))) if types[k].startswith("array") else vals
        arms.append(F.transform(vals, _named(k)))
    return df.select(F.explode(F.concat(*arms)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def passes(col: Column, chosen: list[str], many: bool) -> Column:
    """Whether a facet lets a row through: nothing chosen, or any chosen value present."""
    if not chosen:
        return F.lit(True)
    hit = F.arrays_overlap(col, F.lit(chosen)) if many else col.isin(*chosen)
    return F.coalesce(hit, F.lit(False))


def crossfilter(df: DataFrame, facets: dict[str, Column], chosen: dict[str, list[str]]) -> DataFrame:
    """Counts of every facet under the filters of all other facets, in one pass.

    A row that fails two facets counts nowhere; one that fails a single facet counts for
    that facet only; nulls are skipped.
    """
    types = dict(df.select(*[c.alias(k) for k, c in facets.items()]).dtypes)
    many = {k: t.startswith("array") for k, t in types.items()}
    base = df.select(*[c.alias(k) for k, c in facets.items()], *[passes(c, chosen.get(k, []), many[k]).alias(f"_ok_{k}") for k, c in facets.items()])
    failed = sum((F.when(F.col(f"_ok_{k}"), 0).otherwise(1) for k in facets), F.lit(0))
    base = base.withColumn("_failed", failed).where("_failed <= 1")
    arms = []
    for k in facets:
        vals = F.array_distinct(F.col(k)) if many[k] else F.array(F.col(k))
        open_ = (F.col("_failed") == 0) | ~F.col(f"_ok_{k}")
        arms.append(F.transform(F.when(open_, F.filter(vals, lambda v: v.isNotNull())).otherwise(F.expr("array()").cast("array<string>")), _named(k)))
    return base.select(F.explode(F.concat(*arms)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def timeline(df: DataFrame, date: str, pos: str, first: list[str], title: str, most: int = 7) -> DataFrame:
    """One row per date (``undated`` for none): rows, the first row's scalars, the first distinct titles.

    Titles are reduced to their first position before they are gathered.
    """
    d = df.withColumn("_d", F.coalesce(F.when(F.trim(F.col(date)) != "", F.col(date)), F.lit("undated")))
    head = d.groupBy("_d").agg(F.count("*").alias("n"), F.min_by(F.struct(*first), F.col(pos)).alias("_f"))
    t = d.where(F.col(title).isNotNull()).groupBy("_d", title).agg(F.min(pos).alias("_p"))
    ranked = t.withColumn("_r", F.row_number().over(Window.partitionBy("_d").orderBy("_p"))).where(F.col("_r") <= most)
    titles = ranked.groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("_r", F.col(title).alias("t")))).alias("_t"))
    j = head.join(titles, "_d", "left")
    return j.select(F.col("_d").alias("date"), "n", *[F.col(f"_f.{c}").alias(c) for c in first], F.array_join(F.transform("_t", lambda x: x["t"]), "; ").alias("titles"))


def grouped_table(df: DataFrame, label: str, date: str, special: Column) -> DataFrame:
    """Rows by label whatever its case: longest label (the smallest on ties), versions, special ones, first and last date."""
    return (
        df.where(F.trim(F.col(label)) != "")
        .groupBy(F.lower(label).alias("key"))
        .agg(
            F.max_by(label, F.struct(F.length(label), F.lower(label), F.col(label))).alias("label"),
            F.count("*").alias("versions"),
            F.count_if(special).alias("special"),
            F.min(date).alias("first_date"),
            F.max(date).alias("last_date"),
        )
    )


def claims(df: DataFrame, entity: str, field: str, value: str, source: str, strength: str) -> DataFrame:
    """The best claim about each field of an entity: most sources, then strength, then value; with its verdict."""
    from lacquer.functions.rules import verdict

    v = df.where(F.trim(F.col(value)) != "").groupBy(entity, field, value).agg(F.count_distinct(source).alias("sources"), F.max(strength).alias("strength"))
    first = F.struct((-F.col("sources")).alias("o1"), (-F.col("strength")).alias("o2"), F.col(value).alias("o3"))
    best = v.groupBy(entity, field).agg(F.count("*").alias("values"), F.min_by(F.struct(F.col(value).alias("best"), "sources", "strength"), first).alias("_b"))
    best = best.select(entity, field, "_b.best", "values", "_b.sources", "_b.strength")
    return best.withColumn("state", verdict(F.col("values"), F.col("sources"), F.col("strength")))


def coverage(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, hits, rows, percent (rounded down) for each condition, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("hits")) for k in checks])
    return one.select(F.explode(pairs).alias("x"), "_n").select("x.check", "x.hits", F.col("_n").alias("rows"), F.floor(F.col("x.hits") * 100 / F.greatest(F.col("_n"), F.lit(1))).cast("bigint").alias("percent"))


def mine(df: DataFrame, name: str, pos: str, example: str, least: int) -> DataFrame:
    """Names seen ``least`` times or more, with their first example."""
    return df.where(F.trim(F.col(name)) != "").groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.min_by(example, pos).alias("example")).where(F.col("n") >= least)


def longest_by(df: DataFrame, key: Column, value: str, pos: str) -> DataFrame:
    """The longest value of each key, the first on ties."""
    return df.where(F.col(value).isNotNull()).groupBy(key.alias("key")).agg(F.max_by(value, F.struct(F.length(value), -F.col(pos))).alias("value"), F.count("*").alias("n"))


def copies(members: DataFrame, cluster: str, member: str, tier_rank: str, size: str, identical: str, confidence: str) -> DataFrame:
    """The copies of each cluster as rows: cluster, member, size, copy (0 is to be kept), safe.

    The best copy has the best quality, then the largest size, then the smallest name;
    removing others is safe only in clusters of high confidence and identical content. A
    cluster is never gathered, so it may hold any number of copies.
    """
    best = F.struct(F.col(tier_rank).alias("r"), (-F.coalesce(F.col(size), F.lit(0))).alias("o"), F.col(member).alias("m"))
    g = members.groupBy(cluster).agg(F.bool_and(identical).alias("_i"), F.bool_and(F.col(confidence) == "high").alias("_c"))
    rows = members.select(cluster, F.col(member).alias("member"), F.col(size).alias("size"), best["r"].alias("_r"), best["o"].alias("_o"))
    ranked = spread_number(rows, [cluster], ["_r", "_o", "member"], "_n")
    return ranked.join(g, cluster).select(cluster, "member", "size", (F.col("_n") - 1).alias("copy"), F.coalesce(F.col("_i") & F.col("_c"), F.lit(False)).alias("safe"))


def ranked_proposals(proposals: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """Each candidate with its place among those of its key: highest score first, smallest candidate on ties."""
    p = proposals.select(key, F.col(candidate).alias("candidate"), F.col(score).alias("certainty"), (-F.col(score)).alias("_o"))
    return spread_number(p, [key], ["_o", "candidate"], "place").drop("_o")


def attach_proposals(rows: DataFrame, proposals: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """Rows with how many candidates they have, the best one and its score; null for rows without any.

    All candidates in their order are the rows of :func:`ranked_proposals`.
    """
    best = F.struct((-F.col(score)).alias("o"), F.col(candidate).alias("c"))
    p = proposals.groupBy(key).agg(F.count("*").alias("candidates"), F.min(best).alias("_b"))
    return rows.join(p.select(key, "candidates", F.col("_b.c").alias("best"), (-F.col("_b.o")).alias("certainty")), key, "left")
