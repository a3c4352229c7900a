import pytest

from lacquer.operators.packed import delimiter_scores, mask, split_packed, split_values

CASES = [
    ("A One; B Two", ["A One", "B Two"]),
    ("A One\r\nB Two\nC Three", ["A One", "B Two", "C Three"]),
    ("Bela Two, Ann One and Cy Three", ["Bela Two", "Ann One", "Cy Three"]),
    ("Bela Two, Ann One, and Cy Three", ["Bela Two", "Ann One", "Cy Three"]),
    ("Two, Bela", ["Two, Bela"]),
    ("Two, B.", ["Two, B."]),
    ("The Two Players, Ann One", ["The Two Players", "Ann One"]),
    ("Two Players, The", ["Two Players, The"]),
    ("Two, Bela; One, Ann", ["Two, Bela", "One, Ann"]),
    ("Two, Bela / Ann One | Cy Three; D Four", ["Two, Bela", "Ann One", "Cy Three", "D Four"]),
    ('"Ann ""Nan"" One", Bela Two', ['Ann "Nan" One', "Bela Two"]),
    ('Bela Two; "One, Duo & Sons Orchestra"', ["Bela Two", "One, Duo & Sons Orchestra"]),
    ('"North/South One Players" / Bela Two', ["North/South One Players", "Bela Two"]),
    ("Ann One feat. Bela Two & Cy Three", ["Ann One", "Bela Two", "Cy Three"]),
    ("Ann One with Bela Two", ["Ann One", "Bela Two"]),
    ("Ann One (tp, vln),Bela Two (p)", ["Ann One (tp, vln)", "Bela Two (p)"]),
    ("Ann One; ; Bela Two;", ["Ann One", "Bela Two"]),
    ("Ann One + Bela Two", ["Ann One", "Bela Two"]),
    ('Ann "Nan One', ['Ann "Nan One']),
    (None, []),
    ("", []),
    (" ; | ", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_split(text, expected):
    assert split_values(text) == expected


def test_mask_keeps_length():
    for text in ('a "b;c" d', "x (y, z", '"', 'a ""b"" [c]'):
        assert len(mask(text)) == len(text)


def test_rows_and_edge_cases(spark):
    rows = [(1, "A One; B Two", "s", "x"), (1, "A One; B Two", "s", "x"), (2, None, "s", "y"), (3, "  ", None, "z"), (4, "Ann One", "s", "w"), (5, "; ".join(["Ann One"] * 5000), None, "v")]
    df = spark.createDataFrame(rows, "id bigint, names string, src string, pos string")
    got = split_packed(df, ["id"], ["names"], "src").collect()
    assert sorted((r.id, r.pos, r.val) for r in got if r.id == 1) == [(1, 1, "A One")] * 2 + [(1, 2, "B Two")] * 2
    assert {r.id for r in got} == {1, 5}
    assert max(r.pos for r in got) == 5000
    assert split_packed(df.limit(0), ["id"], ["names"], "src").count() == 0


def test_scores_choose_the_delimiters(spark):
    lists = [(i, "a", f"Ann One{i}, Bela Two") for i in range(30)] + [(100 + i, "a", f"One{i}, Ann; Two, Bela") for i in range(30)] + [(200, "a", "One, Ann"), (300, "b", "Two, Cy & One, Di")]
    df = spark.createDataFrame(lists, "id int, src string, v string")
    score = {(r.source, r.format, r.delim): r.score for r in delimiter_scores(df, "v", "src").collect()}
    assert score["a", ",", ","] > 0.8 and score["a", ";,", ","] == 0.0 and score["a", ";,", ";"] == 1.0
    got: dict = {}
    for r in split_packed(df, ["id"], ["v"], "src").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.val)
    assert got[3] == ["Ann One3", "Bela Two"] and got[105] == ["One5, Ann", "Two, Bela"] and 200 not in got
    # without the scores nothing is split
    assert split_packed(df, ["id"], ["v"], "src", least_score=1.1).count() == 0
