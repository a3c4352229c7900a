import random

from pyspark.sql import functions as F

from lacquer.sinks import tables
from lacquer.operators import audit, groups, joins, ordered, reconcile


def test_majority_prefers_the_first_seen(spark):
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate("baab")] + [("g", None, 9), ("h", " ", 1)], "k string, v string, p int")
    assert [tuple(r) for r in groups.majority(df, ["k"], "v", "p").collect()] == [("g", "b")]
    wide = groups.majorities(df, "k", ["v"], "p").collect()
    assert wide[0]["v"] == "b"


def sequential_segments(rows):
    out, seg, prev_label, prev_no, first = [], 0, None, None, True
    for label, no in rows:
        new = first or label != prev_label or (no is not None and prev_no is not None and no <= prev_no)
        if not first and label != prev_label:
            new = True
        seg += new
        out.append(seg)
        hard = not first and label != prev_label
        prev_label = label
        if no is not None:
            prev_no = no
        elif hard:
            prev_no = None
        first = False
    return out


def test_segments_against_a_sequential_walk(spark):
    rnd = random.Random(1)
    rows = [(g, i, rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None])) for g in range(40) for i in range(25)]
    df = spark.createDataFrame(rows, "g int, i int, label string, no int")
    got = {(r.g, r.i): r.segment for r in ordered.segments(df, ["g"], ["i"], "label", "no").collect()}
    for g in range(40):
        mine = [(x[2], x[3]) for x in rows if x[0] == g]
        assert [got[g, i] for i in range(25)] == sequential_segments(mine)


def test_greedy_match(spark):
    def brute(ours, theirs, tol):
        pool, n = list(theirs), 0
        for x in sorted(ours):
            if pool and min(abs(x - y) for y in pool) <= tol:
                pool.pop(min(range(len(pool)), key=lambda i: abs(x - pool[i])))
                n += 1
        return n

    rnd = random.Random(2)
    rows = [([rnd.uniform(0, 50) for _ in range(rnd.randrange(8))], [rnd.uniform(0, 50) for _ in range(rnd.randrange(8))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r.n for r in df.select(joins.greedy_match(F.col("a"), F.col("b"), 5.0).alias("n")).collect()]
    assert got == [brute(a, b, 5.0) for a, b in rows]


def test_set_overlap_loses_no_pair(spark):
    rnd = random.Random(4)
    left = [(f"l{i}", f"x{rnd.randrange(40)}") for i in range(30) for _ in range(rnd.randrange(1, 9))]
    right = [(f"r{i}", f"x{rnd.randrange(40)}") for i in range(30) for _ in range(rnd.randrange(1, 12))]
    got = {(r.l, r.r, r.shared) for r in joins.set_overlap(spark.createDataFrame(left, "l string, i string"), "l", spark.createDataFrame(right, "r string, i string"), "r", "i", 2, 0.5).collect()}
    a, b = {}, {}
    for k, v in left:
        a.setdefault(k, set()).add(v)
    for k, v in right:
        b.setdefault(k, set()).add(v)
    assert got == {(x, y, len(a[x] & b[y])) for x in a for y in b if len(a[x] & b[y]) >= 2 and len(a[x] & b[y]) >= 0.5 * len(a[x])}


def test_set_overlap_of_common_items_makes_few_candidates(spark, monkeypatch):
    rnd = random.Random(9)
    # everyone has one of three standards and otherwise items of their own; some sets are copies, large ones among them
    sets = {f"l{i}": {f"s{rnd.randrange(3)}"} | {f"x{i}_{j}" for j in range(rnd.randrange(2, 6))} for i in range(60)}
    sets |= {f"big{i}": {f"y{i}_{j}" for j in range(90)} | {"s0"} for i in range(2)} | {"tiny": {"s0"}}
    other = {f"r{k}": {x for x in v if rnd.random() < 0.8} | {f"s{rnd.randrange(3)}"} for k, v in sets.items() if rnd.random() < 0.4 or k[0] != "l"}
    rows = lambda d, n: spark.createDataFrame([(k, x) for k, v in d.items() for x in v], f"{n} string, i string")
    sizes, cut = [], joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: sizes.append((df.columns, (out := cut(df)).count())) or out)
    for least, share in ((2, 0.5), (1, 0.5), (3, 0.1)):
        got = {(r.l, r.r, r.shared) for r in joins.set_overlap(rows(sets, "l"), "l", rows(other, "r"), "r", "i", least, share).collect()}
        assert got == {(x, y, n) for x, v in sets.items() for y, w in other.items() if (n := len(v & w)) >= least and n >= share * len(v)}
        if least > 1:
            assert len(got) <= sizes[-1][1] < 3 * len(got) and sizes[-1][0] == ["l", "r"]


def test_dictionary_joins(spark):
    texts = spark.createDataFrame([(1, "A/The Cats (Cy Three)"), (2, "Complete Copenhagen"), (3, "Om live")], "id int, p string")
    vocab = spark.createDataFrame([("The Cats", 1), ("Cy Three", 2), ("Om", 3), ("Copenhagen", 4), ("A", 5)], "term string, ord int")
    got = {r.id: r.term for r in joins.dictionary_best(texts, "id", "p", vocab, "term", "ord").collect()}
    assert got == {1: "The Cats", 2: "Copenhagen", 3: "Om"}
    names = spark.createDataFrame([("phil j jones", "P"), ("jones", "J"), ("elvin", "E")], "alias string, name string")
    t = spark.createDataFrame([(1, "Elvin, Phil J Jones and Elvin")], "id int, t string")
    assert joins.dictionary_all(t, "id", "t", names, "alias", "name").first()["names"] == ["E", "P"]


def test_asof_and_prefix(spark):
    era = spark.createDataFrame([("1950", "x"), ("1960-05-01", "y")], "s string, era string")
    q = spark.createDataFrame([(1, "1949"), (2, "1960"), (3, "1961"), (4, None)], "id int, at string")
    assert {r.id: r.era for r in joins.asof_join(q, "at", era, "s").collect()} == {1: None, 2: "x", 3: "y", 4: None}
    files = spark.createDataFrame([("a/b/c",), ("a",)], "d string")
    rel = spark.createDataFrame([("a/b",), ("a",), ("a/bc",)], "f string")
    assert sorted((r.d, r.f) for r in joins.prefix_join(files, "d", rel, "f").collect()) == [("a", "a"), ("a/b/c", "a"), ("a/b/c", "a/b")]


def test_clusters_and_names(spark):
    df = spark.createDataFrame([("r1", "k", "t", 5), ("r2", "k", "t", 7), ("r3", "", "t", 1)], "m string, a string, b string, s bigint")
    by_rule = [("A", "high", F.col("a")), ("B", "low", F.col("b")), ("C", "low", F.concat("b", F.lit("!")))]
    got = {(r.kind, r.n, r.first_member, r.last_member, r.reclaimable) for r in groups.clusters(df, by_rule, "m", "s").collect()}
    assert got == {("A", 2, "r1", "r2", 5), ("B", 3, "r1", "r3", 6)}
    rows = spark.createDataFrame([("h", i % 7, i) for i in range(300)] + [("c", 1, 1), (None, 2, 2)], "g string, o int, i int")
    n = {(r.g, r.o, r.i): r.n for r in ordered.spread_number(rows, ["g"], ["o", "i"], "n").collect()}
    want = sorted((o, i) for g, o, i in n if g == "h")
    assert all(n["h", o, i] == k for k, (o, i) in enumerate(want, 1)) and n["c", 1, 1] == n[None, 2, 2] == 1
    n = spark.createDataFrame([("f", "X", "1", 1), ("f", "x", "2", 2), ("f", "X", "2", 3)], "f string, n string, e string, p int")
    assert [r.u for r in ordered.distinct_names(n, "f", "n", "e", "p", "u").orderBy("p").collect()] == ["X", "x (2)", "X #2"]


def test_spans_codes_and_audit(spark):
    df = spark.createDataFrame([([(1, 5), (3, 8), (5, 6), (5, 9)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(ordered.leftmost_spans(F.col("s")).alias("k")).first()["k"]] == [(1, 5), (5, 9)]
    c = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4), ("", 5), ("c", 6)], "v string, p int")
    codes = ordered.dictionary_codes(c, "v", "p")
    assert {r.value: r.code for r in codes.collect()} == {"b": 0, "a": 1, "c": 2}
    assert sorted(r.k for r in ordered.encode_column(c, "v", codes, "k").collect()) == [-1, -1, 0, 0, 1, 2]
    rep = audit.checks(c, F.col("p").cast("string"), [("HIGH", "null", F.col("v").isNull()), ("LOW", "never", F.lit(False))])
    assert {(r.severity, r.check, r.n, r.examples) for r in rep.collect()} == {("HIGH", "null", 1, "4"), ("LOW", "never", 0, "")}


def test_natural_order(spark):
    df = spark.createDataFrame([("track 10",), ("Track 9",), ("track 100a",), ("track 9b",)], "v string")
    assert [r.v for r in df.orderBy(ordered.natural_key(F.col("v"))).collect()] == ["Track 9", "track 9b", "track 10", "track 100a"]


def test_crossfilter_matches_plain_counts(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), [rnd.choice("xyz") for _ in range(rnd.randrange(3))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "c string, m array<string>")
    got = {(r.facet, r.value): r.n for r in groups.crossfilter(df, {"c": F.col("c"), "m": F.col("m")}, {"c": ["a"], "m": ["x"]}).collect()}
    for v in "ab":
        assert got.get(("c", v), 0) == sum(1 for c, m in rows if "x" in m and c == v)
    for v in "xyz":
        assert got.get(("m", v), 0) == sum(1 for c, m in rows if c == "a" and v in m)


def test_copies_and_proposals(spark):
    df = spark.createDataFrame([("c", "b", 1, 5, True, "high"), ("c", "a", 1, 9, True, "high"), ("d", "x", 2, 1, True, "low"), ("d", "y", 1, 1, True, "low")], "c string, m string, r int, s bigint, i boolean, k string")
    ranked = groups.copies(df, "c", "m", "r", "s", "i", "k")
    assert sorted((r.c, r.copy, r.member, r.safe) for r in ranked.collect()) == [("c", 0, "a", True), ("c", 1, "b", True), ("d", 0, "y", False), ("d", 1, "x", False)]
    assert [(r.c, r.line) for r in tables.deletion_script(ranked, "c").collect()] == [("c", "rm -i -- 'b'")]
    rows = spark.createDataFrame([("p",), ("q",)], "path string")
    prop = spark.createDataFrame([("p", "s1", 0.4), ("p", "s2", 0.9)], "path string, cand string, score double")
    out = {r.path: (r.candidates, r.best, r.certainty) for r in groups.attach_proposals(rows, prop, "path", "cand", "score").collect()}
    assert out == {"p": (2, "s2", 0.9), "q": (None, None, None)}
    assert sorted((r.path, r.place, r.candidate) for r in groups.ranked_proposals(prop, "path", "cand", "score").collect()) == [("p", 1, "s2"), ("p", 2, "s1")]



def test_credits(spark):
    from lacquer.operators import credits

    vocab = spark.createDataFrame([("Terry", "Andrew Terry", False, False), ("Reiner", "Fritz Reiner", False, False), ("Mahler", "Gustav Mahler", True, False)], "surname string, name string, guarded boolean, ambiguous boolean")
    t = spark.createDataFrame([(1, "Clark Terry Live", []), (2, "CSO Reiner PCM", []), (3, "Mahler 5", []), (4, "Gustav Mahler, Orchestra", []), (5, "a reiner thing", []), (6, "Reiner Quartet", []), (7, "Reiner", ["Reiner, F."])], "id int, t string, b array<string>")
    got = {r.id: r.name for r in credits.leaders(t, "id", "t", vocab, "b").collect()}
    assert got == {2: "Fritz Reiner", 4: "Gustav Mahler"}
    shapes = {"X/Some 5 CSO_Baren PCM": "Baren", "Great Orchestra, Klemp": "Klemp", "Plain Title": None}
    df = spark.createDataFrame([(k,) for k in shapes], "p string").select("p", credits.leader_by_shape(F.col("p"))["name"].alias("n"))
    assert {r.p: r.n for r in df.collect()} == shapes
    assert [r.x for r in spark.createDataFrame([("Egmont Overture",), ("Simone Young",), ("Jaqueline du",)], "n string").select(credits.looks_like_person(F.col("n")).alias("x")).collect()] == [False, True, False]


def test_works(spark):
    from lacquer.operators.works import album_works, resolve_works

    a = spark.createDataFrame([("Someone - Requiem K.626, Adagio & Fugue K.546",), ("Nothing here",)], "a string").select(album_works(F.col("a")).alias("w")).collect()
    assert [(x["title"], x["system"], x["number"]) for x in a[0].w] == [("Requiem", "K", "626"), ("Adagio & Fugue", "K", "546")] and a[1].w == []
    t = [(1, "r", 0, 1, "Sonata - 1. Allegro", None), (2, "r", 0, 2, "Sonata - 2. Largo", "C"), (3, "r", 0, 3, "Suite - 1. Aria", "C")]
    got = resolve_works(spark.createDataFrame(t, "row_id int, release_id string, disc int, number int, title string, composer string"), spark.createDataFrame([("r", "Album")], "release_id string, album string"))
    rows = {r.row_id: (r.segment, r.work, r.composer) for r in got.collect()}
    assert rows == {1: (1, "Sonata", "C"), 2: (1, "Sonata", "C"), 3: (2, "Suite", "C")}


def test_marks_keep_their_places_and_numbers(spark):
    from lacquer.functions.text import match_spans
    from lacquer.operators.works import album_works

    rows = {
        "Symphony Op.10, Sonata Op.1": [("Symphony", "Op", "10"), ("Sonata", "Op", "1")],
        "Sonata Hob.XVI:52; Sonata Hob.XVI:50": [("Sonata", "Hob", "XVI:52"), ("Sonata", "Hob", "XVI:50")],
        "Trio Op.1 No.3, Trio Op.1 No.1": [("Trio", "Op", "1 No.3"), ("Trio", "Op", "1 No.1")],
        "K.1 K.1": [(None, "K", "1"), (None, "K", "1")],
    }
    df = spark.createDataFrame([(k,) for k in rows], "a string")
    got = {r.a: [tuple(w) for w in r.w] for r in df.select("a", album_works(F.col("a")).alias("w")).collect()}
    assert got == rows
    spans = spark.createDataFrame([("No. 1, No. 12, No. 1",), (None,), ("",)], "t string").select(match_spans(F.col("t"), r"No\. (\d+)", 1).alias("s")).collect()
    assert [(x.start, x.end, x.g1) for x in spans[0].s] == [(1, 6, "1"), (8, 14, "12"), (16, 21, "1")] and not spans[1].s and not spans[2].s


def serial_names(rows):
    used, out = set(), []
    for name, extra in rows:
        tries = [name, *([f"{name} ({extra})"] if (extra or "").strip() else [])]
        k = 2
        pick = next((t for t in tries if t.lower() not in used), None)
        while pick is None:
            pick = f"{name} #{k}" if f"{name} #{k}".lower() not in used else None
            k += 1
        used.add(pick.lower())
        out.append(pick)
    return out


def test_names_are_given_out_as_row_by_row(spark):
    cases = [
        [("A", ""), ("A", ""), ("A #2", "")],
        [("A #2", ""), ("A", ""), ("A", ""), ("A", "")],
        [("A", "x"), ("a", "x"), ("A (x)", "x"), ("A", "y"), ("A (X)", None), ("A #2", "")],
        [("B", "1")] * 6 + [("B #3", "1"), ("b (1)", " ")] + [("B", "")] * 3,
        [("A #2 #2", ""), ("A #2", ""), ("A", ""), ("A", ""), ("A #2", ""), ("A", "")],
    ]
    rows = [(f"f{i}", n, e, p) for i, c in enumerate(cases) for p, (n, e) in enumerate(c)]
    df = spark.createDataFrame(rows, "f string, n string, e string, p int")
    got: dict = {}
    for r in ordered.distinct_names(df, "f", "n", "e", "p", "u").orderBy("f", "p").collect():
        got.setdefault(r.f, []).append(r.u)
    assert got == {f"f{i}": serial_names(c) for i, c in enumerate(cases)}


def test_asof_by_merge_equals_brute_force(spark):
    right = [(f"{1900 + i % 60:04d}-{i % 12 + 1:02d}", f"e{i}") for i in range(300)]
    left = [(i, None if i % 9 == 0 else f"{1895 + i % 70:04d}-0{i % 9 + 1}") for i in range(200)]
    q, r = spark.createDataFrame(left, "id int, at string"), spark.createDataFrame(right, "s string, era string")
    want = {i: max(((s, e) for s, e in right if at and s <= at), default=(None, None))[1] for i, at in left}
    assert {x.id: x.era for x in joins.asof_join(q, "at", r, "s").collect()} == want
    few = r.limit(150)
    kept = [(x.s, x.era) for x in few.collect()]
    want = {i: max(((s, e) for s, e in kept if at and s <= at), default=(None, None))[1] for i, at in left}
    assert {x.id: x.era for x in joins.asof_join(q, "at", spark.createDataFrame(kept, "s string, era string"), "s").collect()} == want


def test_long_terms_and_long_numbers(spark):
    v = spark.createDataFrame([("one two three four five six seven",), ("two",)], "term string")
    t = spark.createDataFrame([(1, "x One two three, four five six seven y")], "id int, t string")
    assert sorted((r.pos, r.term) for r in joins.dictionary_hits(t, "id", "t", v, "term").collect()) == [(2, "one two three four five six seven"), (3, "two")]
    names = ["a100000000000000000000", "a20000000000000000000", "a7", "a007", "A7b", "a", "b1"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ordered.natural_key(F.col("n")).alias("k"))
    assert [r.n for r in df.orderBy("k", "n").collect()] == ["a", "a007", "a7", "A7b", "a20000000000000000000", "a100000000000000000000", "b1"]


def test_greedy_needs_only_near_values(spark):
    import random

    rng = random.Random(1)
    ours = [("r", round(rng.uniform(0, 60), 1)) for _ in range(400)] + [("q", 5.0), ("q", 5.0), ("q", 100.0)]
    theirs = [("e", round(rng.uniform(0, 60), 1)) for _ in range(9)] + [("e", 5.0)] + [("f", 5.0)] * 3

    def brute(xs, ys):
        n, ys = 0, list(ys)
        for x in sorted(xs):
            if ys and min(abs(y - x) for y in ys) <= 2.0:
                ys.pop(min(range(len(ys)), key=lambda i: (abs(ys[i] - x), i)))
                n += 1
        return n

    left, right = spark.createDataFrame(ours, "l string, x double"), spark.createDataFrame(theirs, "r string, y double")
    pairs = [(a, b) for a in "rq" for b in "ef"]
    near = joins.near_values(left, "l", "x", spark.createDataFrame(pairs, "l string, r string"), right, "r", "y", 2.0).join(right.groupBy("r").agg(F.array_sort(F.collect_list("y")).alias("w")), "r")
    got = {(r.l, r.r): r.n for r in near.select("l", "r", joins.greedy_match(F.col("_v"), F.col("w"), 2.0).alias("n")).collect()}
    assert got == {(a, b): brute([x for k, x in ours if k == a], sorted(y for k, y in theirs if k == b)) for a, b in pairs}
    assert near.select(F.max(F.size("_v"))).first()[0] <= 200


def test_year_headers_and_stages(spark):
    df = spark.createDataFrame([(1, "1950-01"), (2, "1950"), (3, None), (4, "1951")], "i int, d string")
    assert [r.header for r in ordered.year_headers(df, "d", ["i"]).orderBy("i").collect()] == ["1950", None, "", "1951"]
    asked = spark.createDataFrame([("k", 1, 1, 0.5, "a"), ("k", 2, 1, 0.95, "b"), ("k", 3, 1, 0.99, "c"), ("j", 1, 9, 0.9, "d")], "k string, q int, rank int, ratio double, v string")
    assert [(r.k, r.v) for r in reconcile.search_winner(asked, "k", "q", "ratio").collect()] == [("k", "b")]
