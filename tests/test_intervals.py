import random

from lacquer.operators.intervals import dated_periods, interval_union, periods_and_gaps
from pyspark.sql import functions as F


def brute(intervals):
    out = []
    for f, t in sorted(i for i in intervals if i[0] < i[1]):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([f, t])
    rows = [("period", f, t) for f, t in out]
    return sorted(rows + [("gap", a[1], b[0]) for a, b in zip(out, out[1:])])


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(200), rnd.randrange(200)) for _ in range(600)]
    df = spark.createDataFrame(rows, "e bigint, f int, t int")
    got = periods_and_gaps(interval_union(df, ["e"], "f", "t", [F.floor(F.col("_f") / 10), F.floor(F.col("_f") / 50)]), ["e"], "f", "t")
    by = {}
    for r in got.collect():
        by.setdefault(r.e, []).append((r.kind, r.f, r.t))
    for e in (1, 2, 3):
        assert sorted(by.get(e, [])) == brute([(f, t) for x, f, t in rows if x == e])


def test_dates_and_edge_cases(spark):
    rows = [
        (1, "1950", "1951", "k"), (1, "1951-01", "1951-02-10", "k"), (1, "1951-01", "1951-02-10", "k"), (1, "1960-05-01", "", "k"),
        (2, None, "1960", "k"), (2, " ", "1960", "k"), (2, "1960", "1950", "k"), (2, "around 1960", "1970", "k"), (None, "1900", "1901", "k"), (3, "1984", "1984", "k"),
    ]
    df = spark.createDataFrame(rows, "band bigint, a string, b string, kind string")
    got = {tuple(r) for r in dated_periods(df, "band", "a", "b").collect()}
    assert got == {
        (1, "period", "1950-01-01", "1951-02-10"),
        (1, "gap", "1951-02-10", "1960-05-01"),
        (1, "period", "1960-05-01", "9999-12-31"),
        (None, "period", "1900-01-01", "1901-01-01"),
    }
    assert dated_periods(df.limit(0), "band", "a", "b").count() == 0
