import pytest

from lacquer.llm.glyphs import consistent_form, plain_form, repair_text

CASES = [
    ("Ｇｕｉｄｏ　（１７４８）", "Guido (1748)"),
    ("Étude", "Étude"),
    ("a​b­c﻿d", "abcd"),
    ("a b c d\te", "a b c d e"),
    ("oﬃce ﬁne", "office fine"),
    ("½ º – ’ “x”", "½ º – ’ “x”"),
    ("冬のワルツ", "冬のワルツ"),
    ("Æ œ ß ø", "Æ œ ß ø"),
    ("", ""),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_plain_form(text, expected):
    assert plain_form(text) == expected and plain_form(expected) == expected


@pytest.mark.parametrize(
    "text,known,expected",
    [
        ("Lіdia", {"lidia"}, "Lidia"),
        ("Ρraustοmer", set(), "Praustomer"),
        ("пoлeм", set(), "полем"),
        ("Тихий свет", set(), "Тихий свет"),
        ("F-ѕhаrр", set(), "F-sharp"),
        ("Αх", {"ax"}, "Ax"),
        ("жzжz", set(), "жzжz"),
    ],
)
def test_repair(text, known, expected):
    assert repair_text(plain_form(text), known) == expected


def test_operator_and_edge_cases(spark):
    rows = [(1, "Lidia", "Lіdia"), (1, "Lidia", "Lіdia"), (2, None, ""), (3, "​", "x" * 100000), (4, "ｎ／ａ", "Тихий"), (5, "Tromоgren", "Tromogren")]
    df = spark.createDataFrame(rows, "value bigint, a string, b string")
    got = consistent_form(df, ["value"], ["a", "b"]).collect()
    assert len(got) == 11
    fixed = {(r[0], r.field, r.fixed) for r in got}
    assert {(1, "b", "Lidia"), (3, "a", ""), (4, "a", "n/a"), (4, "b", "Тихий"), (5, "a", "Tromogren"), (2, "b", "")} <= fixed
    again = consistent_form(spark.createDataFrame([(r[0], r.fixed) for r in got], "k bigint, a string"), ["k"], ["a"])
    assert again.where("fixed <> value").count() == 0
    assert consistent_form(df.limit(0), ["value"], ["a"]).count() == 0
