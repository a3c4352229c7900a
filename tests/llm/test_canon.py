import random

from lacquer.llm.canon import INSTRUMENT_WORDS, BKTree, Matcher, levenshtein, map_reference, map_to_reference, matchers

INSTRUMENTS = [(1, "bass guitar", "bg"), (2, "guitar", "g"), (3, "double bass", "b"), (4, "bass clarinet", "bcl"), (5, "electric piano", "ep"), (6, "piano", "p"), (7, "tenor saxophone", "ts"), (8, "trumpet", "tp")]


def test_tree_finds_what_a_scan_finds():
    rnd = random.Random(3)
    forms = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 8))) for _ in range(200)]
    tree = BKTree()
    for i, f in enumerate(forms):
        tree.add(f, i)
    for _ in range(60):
        q = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 8)))
        assert sorted(x[2] for x in tree.within(q, 2)) == sorted(i for i, f in enumerate(forms) if levenshtein(q, f) <= 2)


def test_instruments():
    m = Matcher(INSTRUMENTS, INSTRUMENT_WORDS)
    want = {"guitar (bass)": 1, "Gitarre": 2, "BG.": 1, "clarinet (bass)": 4, "piano (electric)": 5, "sax, tenor": 7, "ten. sax": 7, "trumpet in B flat": 8, "tenor saxphone": 7, "Piano ": 6, "kazoo": -1, "producer": -1, "?": -1, "tuba": -1}
    assert {k: m.find(k) for k in want} == want


def test_people():
    m = Matcher([(1, "Flinökamp, Lotte", None), (2, "Kandïck, Edward", None)], people=True)
    want = {
        "Flinökamp Lotte": 1, "L. Flinökamp": 1, "Lottte Flinökamp": 1, "Flinokamp, Lotte M. (1700 - 1750)": 1, "Karin Flinökamp": -1, "K. Flinökamp": -1,
        'Edward "Ted" Kandïck': 2, "Ted Kandick": 2, "Ｅ． Ｋａｎｄｉｃｋ": 2, "Trad.": -1, "The Kandïck Trio": -1,
    }
    assert {k: m.find(k) for k in want} == want


def test_operator_and_edge_cases(spark):
    ref = spark.createDataFrame([(i, "instrument", c, k) for i, c, k in INSTRUMENTS], "ref_id bigint, kind string, canon string, code string")
    rows = [("instrument", "guitar", 0), ("instrument", "Gitarre", 1), ("instrument", "Gitarre", 1), ("instrument", None, 2), ("instrument", " ", 3), ("instrument", "z" * 50000, 4), ("genre", "Jazz", 5)]
    df = spark.createDataFrame(rows, "kind string, value string, canon int")
    got = sorted((r.canon, r.ref_id) for r in map_to_reference(df, "value", "kind", matchers(ref.collect())).collect())
    assert got == [(1, 2), (1, 2), (4, -1), (5, -1)]
    assert map_to_reference(df.limit(0), "value", "kind", matchers(ref.collect())).count() == 0


def test_shards_and_broadcast_give_the_same(spark):
    rnd = random.Random(5)
    entries = [(i, "instrument", c, k) for i, c, k in INSTRUMENTS]
    people = [(100 + i, "composer", f"{rnd.choice(['Kand', 'Flin', 'Hod'])}{x}{rnd.choice(['ick', 'kamp', 'uck'])}, {g}", None) for i, (x, g) in enumerate((x, g) for x in ("ï", "o", "a") for g in ("Edward", "Lotte", "Edna", "Egon"))]
    genres = [(200 + i, "genre", g, None) for i, g in enumerate(["Jazz", "Rock", "Gospel", "Blues", "Electronic"])]
    ref = spark.createDataFrame(entries + people + genres, "ref_id bigint, kind string, canon string, code string")
    values = [("instrument", v) for v in ("Gitarre", "guitar", "ten. sax", "kazoo", "bas", "guiatr (bass)", " ", "tp / p", "ebass")] + [("genre", v) for v in ("jaz", "gosple", "bluess", "elektronic", "Jazz", "polka", None)]
    for _, _, c, _ in people:
        s, g = c.split(", ")
        values += [("composer", x) for x in (f"{g} {s}", f"{g[0]}. {s}", f"{s[:-1]}, {g}", f"{g[1:]} {s}", f"Edvard {s}", "unknown", c, f"Bob {s}")]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(values)], "i int, kind string, value string")
    one = sorted((r.i, r.ref_id) for r in map_reference(df, "value", "kind", ref).collect())
    many = sorted((r.i, r.ref_id) for r in map_reference(df, "value", "kind", ref, most=5).collect())
    assert one == many and {i for _, i in one} > {-1, 200, 202, 203, 204}
