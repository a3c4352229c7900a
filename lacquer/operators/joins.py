"""Joins beyond plain equality, each as an equi-join wherever its semantics allow.

A folder's ancestors, a text's word runs and a set's rare members are exploded on one
side so that the join is hashed on them; nothing here is a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacquer.functions.dates import mid_period
from lacquer.functions.text import flat, leaf
from lacquer.operators.ordered import carry, spread, spread_number
from lacquer.session import cut

#: Rows up to which a literal list or vocabulary counts as small.
SMALL = 10_000
#: Rows up to which an ordered list of intervals is compared one by one.
FEW = 200
#: Items of a set up to which pairs of them are made.
MANY = 64


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most SMALL rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def ancestors(folder: Column) -> Column:
    """A folder and all folders above it, without the root."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def prefix_join(files: DataFrame, folder: str, releases: DataFrame, key: str) -> DataFrame:
    """Files joined to every release whose folder is theirs or lies above it."""
    spread = files.withColumn(key, F.explode(ancestors(F.col(folder))))
    return spread.join(releases, key)


def asof_join(left: DataFrame, at: str, right: DataFrame, start: str, by: list[str] | None = None) -> DataFrame:
    """Each left row with the last right row whose ``start`` is not after ``at``, compared as text.

    Both sides are merged into one stream that is range-partitioned by ``by`` and time;
    within a part the last right row is carried forward, and from part to part one row per
    group that goes on, so there is no range join and a hot group is split over tasks.
    Without ``by`` a right side of at most ``FEW`` rows meets the left one by one instead.
    Of right rows with equal start the largest wins; a null ``at`` meets none.
    """
    by = by or []
    names = [c for c in right.columns if c not in by]
    if not by and right.limit(FEW + 1).count() <= FEW:
        last = right.groupBy(F.col(start).alias("_from")).agg(F.max(F.struct(*names)).alias("_r"))
        spans = last.withColumn("_until", F.lead("_from").over(Window.orderBy("_from")))
        cond = (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
        return left.join(F.broadcast(spans), cond, "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in names])
    r = right.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(*names).alias("_r")).where("_at is not null")
    lcols = [c for c in left.columns if c not in by]
    l_ = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    both = spread(l_.unionByName(r, allowMissingColumns=True), by, ["_at", "_side"])
    both = carry(both, by, F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_at", "_r"))), lambda v: F.last(v, ignorenulls=True), "_before")
    order = Window.partitionBy("_part", *by).orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("_r", F.coalesce(F.last("_r", ignorenulls=True).over(order), F.col("_before"))).where("_side = 1")
    return done.select(*by, "_l.*", *[F.when(F.col("_at").isNotNull(), F.col(f"_r.{c}")).alias(c) for c in names])


def interval_join(left: DataFrame, at: str, right: DataFrame, start: str, end: str, order: str, by: list[str]) -> DataFrame:
    """Each left row with the first right row (by ``order``) of its ``by`` with start <= date < end.

    Partial dates are completed to mid-period. Before the two sides meet, the left is
    reduced to its distinct days and the right to the first row of each span, so a hot
    group is no larger than its days; they meet by year.
    """
    d = mid_period(F.col(at))
    names = [c for c in right.columns if c not in by]
    year = lambda c: F.substring(c, 1, 4).try_cast("int")
    days = left.select(*by, d.alias("_d")).where("_d is not null").distinct().withColumn("_y", year(F.col("_d")))
    ends = days.agg(F.min("_y").alias("lo"), F.max("_y").alias("hi")).first()
    lo, hi = (ends["lo"] or 0), (ends["hi"] or 0)
    spans = right.groupBy(*by, start, end).agg(F.min_by(F.struct(*names), order).alias("_hit")).where(F.col(start) < F.col(end))
    first, last = F.greatest(year(F.col(start)), F.lit(lo)), F.least(year(F.col(end)), F.lit(hi))
    spans = spans.withColumn("_y", F.explode(F.when(first <= last, F.sequence(first, last))))
    hit = days.join(spans, [*by, "_y"]).where((F.col("_d") >= F.col(start)) & (F.col("_d") < F.col(end)))
    best = hit.groupBy(*by, "_d").agg(F.min_by("_hit", f"_hit.{order}").alias("_hit"))
    return left.withColumn("_d", d).join(best, [*by, "_d"], "left").select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in names])


def text_words(text: Column) -> Column:
    """The folded words of a text in order."""
    return F.filter(F.split(F.regexp_replace(flat(text), r"[^\p{L}\p{N}']+", " "), " "), lambda w: w != "")


def dictionary_hits(texts: DataFrame, key: str, text: str, vocab: DataFrame, term: str) -> DataFrame:
    """Every whole-word occurrence of a vocabulary term: key, pos (from 1), and the vocabulary's columns.

    A text's words are made once and spread; each meets the terms that begin with it and
    the following words decide, as many as the longest term has.
    """
    v = vocab.withColumn("_term", F.array_join(text_words(F.col(term)), " ")).where("_term <> ''").withColumn("_first", F.substring_index("_term", " ", 1))
    longest = v.agg(F.max(F.size(F.split("_term", " ")))).first()[0] or 1
    words = texts.select(F.col(key), text_words(F.col(text)).alias("_w")).select(key, "_w", F.posexplode("_w").alias("_p", "_first"))
    words = words.select(key, (F.col("_p") + 1).alias("pos"), "_first", F.concat(F.array_join(F.slice("_w", F.col("_p") + 1, F.lit(longest)), " "), F.lit(" ")).alias("_run"))
    met = words.join(small(v), "_first").where(F.col("_run").startswith(F.concat("_term", F.lit(" "))))
    return met.drop("_first", "_run", "_term")


def dictionary_best(texts: DataFrame, key: str, path: str, vocab: DataFrame, term: str, order: str) -> DataFrame:
    """For each path the best term: in the last component before elsewhere, earliest, longest, first of the list."""
    base = texts.select(key, F.col(path).alias("_p"))
    inside = dictionary_hits(base.select(key, leaf(F.col("_p")).alias("_t")), key, "_t", vocab, term).withColumn("tier", F.lit(0))
    whole = dictionary_hits(base.select(key, F.col("_p").alias("_t")), key, "_t", vocab, term).withColumn("tier", F.lit(1))
    hits = inside.unionByName(whole)
    rank = F.struct("tier", "pos", -F.length(F.col(term)), F.col(order))
    names = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*names), rank).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in names])


def dictionary_all(texts: DataFrame, key: str, text: str, vocab: DataFrame, term: str, name: str) -> DataFrame:
    """The distinct canonical names in a text in the order of their appearance; longer terms cover shorter ones."""
    hits = dictionary_hits(texts, key, text, vocab, term).select(key, "pos", F.col(name).alias("_n"), F.size(F.split(F.col(term), r"\s+")).alias("_k"))
    longest = hits.groupBy(key, "pos").agg(F.max_by("_n", F.struct("_k", "_n")).alias("_n"), F.max("_k").alias("_k"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    free = longest.withColumn("_end", F.max(F.col("pos") + F.col("_k")).over(before)).where("_end is null or _end <= pos")
    return free.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_n"))), lambda x: x["_n"])).alias("names"))


def drop_contained(names: Column) -> Column:
    """Names in order, without those whose letters contain or are contained in an earlier one's."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    none = F.expr("cast(array() as array<string>)")
    return F.aggregate(
        names,
        none,
        lambda acc, x: F.when(F.exists(acc, lambda y: letters(y).contains(letters(x)) | letters(x).contains(letters(y))) | (letters(x) == ""), acc).otherwise(F.concat(acc, F.array(x))),
    )


def unique_prefix(fragments: DataFrame, fragment: str, keys: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Fragments of ``least`` letters or more with the one key that starts with them; others are left out.

    The keys' prefixes are exploded, so this is an equi-join.
    """
    f = fragments.select(F.col(fragment).alias("fragment")).where(F.length("fragment") >= least).distinct()
    p = keys.select(F.col(key).alias("key")).distinct().select("key", F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length("key"), F.lit(least))), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("fragment"))
    return f.join(p.distinct(), "fragment").groupBy("fragment").agg(F.count("*").alias("_n"), F.min("key").alias("key")).where("_n = 1").drop("_n")


def set_overlap(left: DataFrame, lkey: str, right: DataFrame, rkey: str, item: str, least: int, share: float) -> DataFrame:
    """Pairs whose sets share ``least`` items or more and ``share`` of the left set.

    Exact prefix filter: a pair that shares ``need`` items has two of the left set's rarest
    size - need + 2 in common, and only pairs of those meet the other side's pairs, so that
    a common item alone makes no candidate. Sets of more than ``MANY`` such items have too
    many pairs; they meet by one of their rarest size - need + 1. Of those that meet, 256
    bits of either set tell most that cannot share ``need`` items before anything moves.
    Columns: lkey, rkey, shared, left_size, right_size, of_left, of_right.
    """
    a = left.select(F.col(lkey), F.col(item).alias("_i")).where("_i is not null").distinct()
    b = right.select(F.col(rkey), F.col(item).alias("_i")).where("_i is not null").distinct()
    marks = lambda name: [F.bit_or(F.expr(f"if(pmod(xxhash64(_i), 4) = {k}, shiftleft(1L, cast(pmod(shiftright(xxhash64(_i), 2), 64) as int)), 0L)")).alias(f"{name}{k}") for k in range(4)]
    freq = b.groupBy("_i").agg(F.count("*").alias("_df"))
    na = a.groupBy(lkey).agg(F.count("*").alias("left_size"), *marks("_lm"))
    nb = b.groupBy(rkey).agg(F.count("*").alias("right_size"), *marks("_rm"))
    need = F.greatest(F.ceil(F.col("left_size") * share), F.lit(max(least, 1)))
    # items of the left set that the other side lacks are its rarest; they need no index
    have = a.join(freq, "_i")
    enough = have.groupBy(lkey).agg(F.count("*").alias("_have")).join(na, lkey).withColumn("_need", need).where("_have >= _need")
    ranked = spread_number(have.join(enough, lkey), [lkey], ["_df", "_i"], "_r").withColumn("_n", F.col("_have") - F.col("_need") + 1)
    ahead = cut(ranked.where("_r <= _n + 1").select(lkey, "_i", "_r", "_n", "_need", "left_size", *[f"_lm{k}" for k in range(4)]))
    sets = b.join(ahead.select("_i").distinct(), "_i", "left_semi").join(nb.where(F.col("right_size") >= least), rkey)
    alone, alone2 = (F.col("_n") > MANY) | (F.col("_need") < 2), F.col("right_size") > MANY
    pairs = lambda df, key: df.join(df.select(key, F.col("_i").alias("_j")), key).where("_i < _j").withColumn("_k", F.xxhash64("_i", "_j")).drop("_i", "_j")
    lost = sum((F.bit_count(F.col(f"_lm{k}").bitwiseAND(F.bitwise_not(f"_rm{k}"))) for k in range(4)), F.lit(0))
    can = (F.col("right_size") >= F.col("_need")) & (F.col("left_size") - lost >= F.col("_need"))
    one = ahead.where("_r <= _n")
    met = [pairs(ahead.where(~alone), lkey).join(pairs(sets.where(~alone2), rkey), "_k"), one.where(alone).join(sets, "_i"), one.where(~alone).join(sets.where(alone2), "_i")]
    met = [m.where(can).select(lkey, rkey) for m in met]
    cand = cut(met[0].unionByName(met[1]).unionByName(met[2]).distinct())
    # the right sets are spread first: a hot left set is met item by item and never copied
    full = cand.join(b, rkey).join(a, [lkey, "_i"]).groupBy(lkey, rkey).agg(F.count("*").alias("shared"))
    out = full.join(na.select(lkey, "left_size"), lkey).join(nb.select(rkey, "right_size"), rkey).where((F.col("shared") >= least) & (F.col("shared") >= F.col("left_size") * share))
    return out.withColumn("of_left", F.col("shared") / F.col("left_size")).withColumn("of_right", F.col("shared") / F.col("right_size"))


def equal_sets(sets: DataFrame, key: str, item: str, facts: DataFrame) -> DataFrame:
    """Each row of ``facts`` (the key and others) whose key has items, with ``rep``, the largest key of equal items and equal others.

    What only depends on those needs the reps alone, so copies don't multiply. Sets of more
    than ``MANY`` items are not gathered; they stand for themselves.
    """
    others = [c for c in facts.columns if c != key]
    d = sets.select(F.col(key), F.col(item).alias("_i")).where("_i is not null").distinct()
    size = d.groupBy(key).agg(F.count("*").alias("_n"))
    few = d.join(size.where(F.col("_n") <= MANY), key).groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_s")).join(facts, key)
    first = few.groupBy("_s", *others).agg(F.max(key).alias("rep")).select(F.col("_s").alias("_s2"), *[F.col(c).alias(f"_o_{c}") for c in others], "rep")
    same = F.col("_s") == F.col("_s2")
    for c in others:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    many = size.where(F.col("_n") > MANY).join(facts, key).select(*facts.columns, F.col(key).alias("rep"))
    return cut(few.join(first, same).select(*facts.columns, "rep").unionByName(many))


def best_overlap(overlaps: DataFrame, lkey: str, rkey: str, bonus: Column, order: str) -> DataFrame:
    """For each left key the counterpart of the highest share plus bonus, the first in ``order`` on ties."""
    rank = F.struct((F.col("of_left") + bonus).alias("s"), (-F.col(order)).alias("o"))
    names = [c for c in overlaps.columns if c != lkey]
    return overlaps.groupBy(lkey).agg(F.max_by(F.struct(*names), rank).alias("_b")).select(lkey, *[F.col(f"_b.{c}").alias(c) for c in names])


def zip_equal(left: DataFrame, right: DataFrame, by: str, pos: str) -> DataFrame:
    """Rows of both sides at equal positions, only where both sides have as many rows.

    ``pos`` counts from 1 in each ``by``.
    """
    size = lambda df: df.groupBy(by).agg(F.max(pos).alias("_n"))
    same = size(left).join(size(right), [by, "_n"]).select(by)
    return left.join(right, [by, pos]).join(same, by, "left_semi")


def candidate_state(rows: DataFrame, key: str, by: str, own: str, sessions: DataFrame, candidate: str, date: str) -> DataFrame:
    """How certain a row's candidate is: unique, corroborated by exactly one equal date, or ambiguous.

    A row meets the facts of its ``by`` and of its ``by`` and date, never the sessions
    themselves, so a hot ``by`` costs two rows. Rows without a session are left out.
    """
    s = sessions.select(F.col(by).alias("_k"), F.col(candidate).alias("_c"), F.col(date).alias("_d")).where("_c is not null")
    every = s.groupBy("_k").agg(F.count_distinct("_c").alias("candidates"), F.min("_c").alias("_one"))
    dated = s.groupBy("_k", "_d").agg(F.count_distinct("_c").alias("same_date"), F.min("_c").alias("_dated"))
    r = rows.select(key, F.col(by).alias("_k"), F.col(own).alias("_d"))
    j = r.join(every, "_k").join(dated, ["_k", "_d"], "left")
    sure, day = F.col("candidates") == 1, F.col("same_date") == 1
    state = F.when(sure, "unique").when(day, "corroborated").otherwise("ambiguous")
    return j.select(key, "candidates", state.alias("state"), F.when(sure, F.col("_one")).when(day, F.col("_dated")).alias("chosen"))


def override(base: DataFrame, overrides: DataFrame, key: str, fields: list[str], action: str = "action") -> DataFrame:
    """Accepted overrides take the place of derived values, field by field."""
    o = overrides.where(F.col(action) == "accept").select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    j = base.join(o, key, "left")
    return j.select(*[F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def greedy_match(ours: Column, theirs: Column, tolerance: float) -> Column:
    """How many of ``ours`` find a counterpart in ``theirs`` within ``tolerance``, one to one.

    Ours are taken in ascending order, each taking the nearest remaining counterpart,
    the first on ties. Order decides, so this folds over the arrays of one pair.
    """
    start = F.struct(F.lit(0).alias("n"), theirs.alias("left"))

    def step(acc: Column, x: Column) -> Column:
        near = F.array_min(F.transform(acc["left"], lambda y: F.abs(y - x)))
        at = F.array_position(F.transform(acc["left"], lambda y: F.abs(y - x)), near).cast("int")
        rest = F.concat(F.slice(acc["left"], F.lit(1), at - 1), F.slice(acc["left"], at + 1, F.greatest(F.size(acc["left"]) - at, F.lit(0))))
        return F.when(near <= tolerance, F.struct((acc["n"] + 1).alias("n"), rest.alias("left"))).otherwise(acc)

    return F.aggregate(F.array_sort(ours), start, step, lambda acc: acc["n"])


def near_values(left: DataFrame, lkey: str, lvalue: str, pairs: DataFrame, right: DataFrame, rkey: str, rvalue: str, tolerance: float) -> DataFrame:
    """The values of each pair's left side that :func:`greedy_match` can use: lkey, rkey, ``_v`` as an array.

    A right value is taken after at most as many near left values as the right side has
    values at all, so only the smallest that many left values near a right one matter.
    This bounds what is gathered by the right side, whatever the left one holds; both
    meet in buckets of the tolerance.
    """
    bucket = lambda c: F.floor(c / tolerance)
    r = right.select(F.col(rkey), F.col(rvalue).alias("_y")).where("_y is not null")
    size = r.groupBy(rkey).agg(F.count("*").alias("_m"))
    asked = pairs.select(lkey, rkey).distinct().join(r.distinct(), rkey).join(size, rkey)
    asked = asked.withColumn("_b", F.explode(F.array(*[bucket(F.col("_y")) + k for k in (-1, 0, 1)])))
    values = left.select(lkey, F.col(lvalue).alias("_x")).where("_x is not null").groupBy(lkey, "_x").agg(F.count("*").alias("_n"))
    met = asked.join(values.withColumn("_b", bucket(F.col("_x"))), [lkey, "_b"]).where(F.abs(F.col("_x") - F.col("_y")) <= tolerance)
    w = Window.partitionBy(lkey, rkey, "_y").orderBy("_x")
    few = met.withColumn("_r", F.row_number().over(w)).where("_r <= _m").groupBy(lkey, rkey, "_x").agg(F.min("_n").alias("_n"), F.max("_m").alias("_m"))
    copies = F.flatten(F.collect_list(F.array_repeat("_x", F.least("_n", "_m").cast("int"))))
    return few.groupBy(lkey, rkey).agg(F.array_sort(copies).alias("_v"))


def first_places(texts: DataFrame, key: str, text: str, venues: DataFrame, cities: DataFrame) -> DataFrame:
    """venue and city of texts: the first venue of the list that is named, with its own city, and the first city only where that is missing.

    ``venues`` has term, ord and home_city, ``cities`` term and ord; texts that name
    neither have no row.
    """
    v = dictionary_hits(texts, key, text, venues, "term").groupBy(key).agg(F.min_by(F.struct("term", "home_city"), "ord").alias("_v"))
    c = dictionary_hits(texts, key, text, cities, "term").groupBy(key).agg(F.min_by("term", "ord").alias("_c"))
    return v.join(c, key, "full_outer").select(key, F.col("_v.term").alias("venue"), F.coalesce("_v.home_city", "_c").alias("city"))
