import itertools
import math
import random

from lacquer.llm.names import average_linkage, is_placeholder, link_names, name_cosines, osa, parse_name, similar_names, slips, variant_pairs


def test_osa_against_definition():
    def brute(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in "xy")
        assert osa(a, b, 2) == min(brute(a, b), 3)


def test_parse():
    assert parse_name("Gemedorf, Marius (1749 - 1786)") == ("person", "marius", "gemedorf", "", "", True)
    assert parse_name("E.M. Hoduck")[1:4] == ("", "hoduck", "em")
    assert parse_name('Edward "Ted" Kandïck')[1:5] == ("edward", "kandick", "", "ted")
    assert parse_name("The Volmostein Singers Group")[0] == parse_name("volmostein singers")[0] == "singers"
    assert parse_name("Werölsen 6tet")[0] == parse_name("Werolsen Sextet, The")[0] == "sextet"
    for p in ("", " - ", "n/a", "[unknown]", "Various Artists", "(none)"):
        assert is_placeholder(p)


def test_similar_names_lose_no_pair(spark):
    rnd = random.Random(7)
    words = list({"".join(rnd.choice("abcdeiors") for _ in range(rnd.randrange(5, 10))) for _ in range(120)})
    words += [w[1] + w[0] + w[2:] for w in words[:30]] + [w[:3] + w[4:] for w in words[30:60]]
    words = list(set(words))
    got = {(r.a, r.b) for r in similar_names(spark.createDataFrame([(w,) for w in words] * 2, "word string"), threshold=0.25).collect()}
    grams = {w: {f"^{w}$"[i : i + 3] for i in range(len(w))} for w in words}
    df = {}
    for g in itertools.chain(*grams.values()):
        df[g] = df.get(g, 0) + 1
    weight = {g: math.log1p(len(words) / n) for g, n in df.items()}
    norm = {w: math.sqrt(sum(weight[g] for g in grams[w])) for w in words}
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if osa(a, b, 1) <= 1 and sum(weight[g] for g in grams[a] & grams[b]) / norm[a] / norm[b] >= 0.25}
    assert got == want


def test_linkage_keeps_contradictions_apart():
    keys = [("lotte", "", "", True), ("karin", "", "", True), ("", "l", "", False), ("", "k", "", False), ("lottte", "", "", False)]
    c = average_linkage(keys)
    assert c[0] == c[2] == c[4] != c[1] == c[3]
    # an initial that fits two people belongs to neither
    c = average_linkage([("hugo", "", "", True), ("henry", "", "", True), ("", "h", "", False)])
    assert len(set(c)) == 3


def test_linking_and_edge_cases(spark):
    people = ["Egon Hoduck", "E.M. Hoduck", "Hoduck, Egon", "Hoduck Egon", "EGON HODUCK", "Egon Hodukc", "Greta Hoduck", "Ann Smith", "Egon Brown", "Greta Brown", "Egon Miller", "Greta Miller", "Egon Stone", "Greta Stone"]
    groups = ["The Volmostein Singers", "Volmostein Singers, The", "The Volmostein Trio", "Volmostein Trío"]
    rows = [(x, 1) for x in people + groups + ["n/a", "", None, "Egon Hoduck"]]
    df = spark.createDataFrame(rows, "name string, entity int")
    pairs = {(r.name_a, r.name_b) for r in variant_pairs(link_names(df)).collect()}
    same = {frozenset(p) for p in pairs}
    assert all(a < b for a, b in pairs)
    for x in people[1:6]:
        assert frozenset(("Egon Hoduck", x)) in same
    assert frozenset(groups[:2]) in same and frozenset(groups[2:]) in same
    assert frozenset(("Egon Hoduck", "Greta Hoduck")) not in same and frozenset((groups[0], groups[2])) not in same
    assert link_names(df.limit(0)).count() == 0


def test_a_frequent_slip_of_a_common_given_name_is_no_name(spark):
    # many rows bring the same typing error with many surnames
    last = [f"{a}{b}{c}" for a in ("Hod", "Vel", "Kras", "Mun") for b in ("imer", "ustar", "okal") for c in ("feld", "worth", "nau")]
    rows = [f"Otto {x}" for x in last] + [f"Ida {x}" for x in last[:20]] + [f"Ottto {x}" for x in last[:6]] + [f"Ada {x}" for x in last[10:30]]
    rows += [f"O. {last[0]}", f"I. {last[0]}", "Kit Bramund", "Christopher Bramund", "Patsy Stelgard", "Patricia Stelgard", "Wigolok Sxt.", "Wigolok Sextet"]
    entity = {r.name: r.entity for r in link_names(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}
    assert all(entity[f"Ottto {x}"] == entity[f"Otto {x}"] for x in last[:6]) and entity[f"O. {last[0]}"] == entity[f"Otto {last[0]}"]
    assert all(entity[f"Ada {x}"] != entity[f"Ida {x}"] for x in last[10:20])
    assert len({entity[x] for x in rows[-6:]}) == 3
    counts = [("otto", 400), ("ottto", 90), ("otot", 100), ("oto", 101), ("ada", 40), ("ida", 30), ("tim", 20), ("tom", 99), ("aad", 4), ("aada", 3), ("toot", 50)]
    got = {r.w for r in slips(spark.createDataFrame(counts, "w string, as_given bigint")).collect()}
    assert got == {a for a, n in counts if n >= 4 and a != "tim" and any(m >= 4 * n and osa(a, b, 1) == 1 for b, m in counts)} and got == {"ottto", "otot", "aad"}


def test_linkage_over_sparse_pairs_is_average_linkage():
    rnd = random.Random(11)
    given = ["hugo", "henry", "lotte", "bob", "robert", "rupert", "ruprt", "karin", "l", "robret", "lote"]
    for _ in range(60):
        keys = sorted({(g if len(g) > 1 else "", rnd.choice(["", "", g[0], "k"]) if len(g) > 1 else g[0] + rnd.choice(["", "k"]), "", rnd.random() < 0.5) for g in rnd.choices(given, k=8)})
        cos = name_cosines(keys)
        c = average_linkage(keys, near=0.0)
        # brute force: merge the two clusters of the highest mean, all of whose pairs have a cosine
        groups = [[i] for i in range(len(keys))]
        mean = lambda a, b: (lambda xs: sum(xs) / len(xs) if None not in xs else -1)([cos.get((min(i, j), max(i, j))) for i in a for j in b])
        while len(groups) > 1:
            best = max(((mean(a, b), -min(a), -min(b)), a, b) for a, b in itertools.combinations(sorted(groups, key=min), 2))
            if best[0][0] < 0.65:
                break
            groups = [g for g in groups if g not in best[1:]] + [best[1] + best[2]]
        assert {frozenset(g) for g in groups} == {frozenset(i for i in range(len(keys)) if c[i] == k) for k in set(c)}
    assert all(v > 0.6 for v in cos.values())
