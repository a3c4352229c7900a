import pytest
from pyspark.sql import functions as F

from lacquer.functions import dates, rules, text


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True)))
    return df.select(fn(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "label,iso,precision",
    [
        ("1965-07-26 Paris", "1965-07-26", "day"),
        ("1961, November 18, Paris", "1961-11-18", "day"),
        ("1961,  Nov. 18", "1961-11-18", "day"),
        ("November 18, 1961", "1961-11-18", "day"),
        ("1961, November", "1961-11", "month"),
        ("August '57", "1957-08", "month"),
        ("1957 - Blue (1995 Remaster)", "1957", "year"),
        ("'58 Sessions", "1958", "year"),
        ("1961 and later 1965-07-26", "1965-07-26", "day"),
        ("1961-13-40", "1961", "year"),
        ("no date 1995", None, None),
        ("", None, None),
    ],
)
def test_parse_date(spark, label, iso, precision):
    got = one(spark, dates.parse_date, label)
    assert (got and got["iso"], got and got["precision"]) == (iso, precision)


def test_plausible(spark):
    for iso, ok in [("1945", True), ("1967-07", True), ("1967-07-18", False), ("1944-12-31", False), ("1967", True), ("", False)]:
        assert one(spark, lambda c: dates.plausible(c, "1945-01-01", "1967-07-17"), iso) is ok


def test_years_and_times(spark):
    assert one(spark, dates.years_in, "1961, 2001 and 19615") == [1961, 2001]
    assert one(spark, dates.recording_year, "1961, 2001") == 1961
    assert one(spark, dates.recording_year, "2001") is None
    assert one(spark, dates.cue_seconds, "01:02:15") == 62.2
    assert one(spark, dates.session_date, "611118B") == "1961-11-18"
    assert one(spark, dates.session_date, "611318B") is None


@pytest.mark.parametrize(
    "title,tune,take",
    [
        ("03 - My Favourite Things (Take 2)", "My Favourite Things", "2"),
        ("My Favorite Things [alt]", "My Favorite Things", "alt"),
        ("1-06 My Favorite Things", "My Favorite Things", None),
        ("26-2", "26-2", None),
        ("07 Naima", "Naima", None),
        ("Mistake 2", "Mistake 2", None),
        ("Ole (Alternate Take)", "Ole", "alt"),
        ("Ole take 3", "Ole", "3"),
    ],
)
def test_tunes(spark, title, tune, take):
    assert one(spark, text.tune_title, title) == tune
    assert one(spark, text.take_of, title) == take


def test_tune_keys_meet(spark):
    keys = {one(spark, text.tune_key, t) for t in ("My Favorite Things", "03 - My Favourite Things (Take 2)", "My Favorite Things [alt]", "The My Favorite Things")}
    assert keys == {"myfavoritethings"}


def test_titles(spark):
    got = one(spark, text.split_movement, "Symphony in C - 1. Allegro")
    assert (got["work"], got["number"], got["movement"]) == ("Symphony in C", 1, "Allegro")
    got = one(spark, text.split_movement, "Someone: Work No. 6: II. Largo")
    assert (got["number"], got["movement"]) == (2, "Largo")
    assert one(spark, text.split_movement, "Naima")["work"] == "Naima"
    assert one(spark, text.bare_movement, "I. Adagio") is True
    assert one(spark, text.bare_movement, "Piano Sonata") is False
    mark = one(spark, text.catalogue_mark, "Sonata Op. 27 No. 2")
    assert (mark["system"], mark["number"]) == ("Op", "27 No.2")
    assert one(spark, text.title_key, "The Sonata, BWV 12 (live)") == "sonata"


def test_fold_and_names(spark):
    assert one(spark, text.fold, "Étude ÅŁ e\u0301") == "etude aŁ e".lower()
    assert one(spark, text.safe_name, ' a/b: "c"?. ') == "a_b_ _c__"
    assert one(spark, text.safe_name, " . ") == "untitled"
    assert one(spark, text.slug, "Café Été!") == "cafe-ete"
    assert one(spark, text.leading_int, "3/12") == 3
    assert one(spark, text.leading_int, "x3") is None
    assert one(spark, text.clock, "125.4") == "2:05"


@pytest.mark.parametrize("value,expected", [("/home/me/music/a.flac", "a.flac"), ("C:\\music\\b", "b"), ("\\\\nas\\share\\c", "c"), ("AC/DC", "AC/DC"), ("plain", "plain"), ("~/x/y", "y")])
def test_scrub(spark, value, expected):
    assert one(spark, text.scrub, value) == expected


def test_paths(spark):
    p = "A/B/CD 2 - More/01.flac"
    assert one(spark, text.release_folder, p) == "A/B"
    assert one(spark, text.disc_folder_number, p) == 2
    assert one(spark, text.disc_folder_title, p) == "More"
    assert one(spark, text.parent, "x.flac") == ""
    assert one(spark, text.extension, "A/x.FLAC") == ".flac"


def test_rules(spark):
    assert one(spark, rules.is_compilation, "The Very Best of X") is True
    assert one(spark, rules.provenance, "A/Live at the Hall") == "live"
    assert one(spark, rules.provenance, "A/Radio Broadcast Live") == "broadcast"
    assert one(spark, rules.authority, "A/1961, November 18, Paris") == "unofficial"
    assert one(spark, rules.authority, "A/1961 - Great Album Title Of Mine Here") == "official"
    assert one(spark, lambda c, b, r: rules.quality_tier(c, b, r), "flac", 24, 44100) == "Hi-Res"
    assert one(spark, lambda c, a: rules.role(c, "ann one", ["bela two"], a), "X/Ann One - Y", "") == "leader"
    assert one(spark, lambda c, a: rules.role(c, "ann one", ["bela two"], a), "X/Bela Two - Y", "") == "sideman"
    assert one(spark, lambda c, a: rules.role(c, "ann one", ["bela two"], a), "X/Bela Two and Ann One", "") == "co-leader"


def test_tags_and_artists(spark):
    df = spark.createDataFrame([({"TITLE": " a\nb ", "title ": "c", "ARTIST": " "},)], "tags map<string,string>")
    r = df.select(text.tag_get(F.col("tags"), "artist", "title").alias("x")).first()
    assert r.x in ("a b", "c")
    got = one(spark, text.artist_parts, "Chamber Orchestra, Ann One; Bela Two cond. Cy Three")
    assert got["groups"] == ["Chamber Orchestra"] and got["people"] == ["Ann One", "Bela Two"] and got["led_by"] == "Cy Three"
    rows = one(spark, text.personnel_rows, "Ann One, Bela Two (as); Cy Three (p)")
    assert [(r["name"], r["instrument"]) for r in rows] == [("Ann One", "as"), ("Bela Two", "as"), ("Cy Three", "p")]


def test_html(spark):
    assert one(spark, text.html_text, "<p>A &amp; B<br>C</p>") == "A & B\nC"


def test_reconcile_key(spark):
    assert one(spark, text.reconcile_key, "The Étude (live), No. 3") == "etude no 3"
    assert one(spark, lambda c: text.reconcile_key(c, accents=True), "The Étude [x]") == "étude"


@pytest.mark.parametrize("title,expected", [("Agnus Dei", True), ("- Dies irae -", True), ("3.Allegretto", True), ("I. Adagio", True), ("Symphony No. 6", False), ("", False), (None, False)])
def test_bare_movements(spark, title, expected):
    assert one(spark, text.bare_movement, title) is expected


def test_paths_inside_texts(spark):
    assert one(spark, text.scrub, "ripped from C:\\Users\\bob\\Music\\x") == "x"
    assert one(spark, text.scrub, "see /home/bob/ ") == "bob"
    assert one(spark, text.scrub, "AC/DC") == "AC/DC"


def test_references(spark):
    assert one(spark, text.html_text, "a &#8211; b &eacute; &#xe9; &#x1F3B5; &amp;lt; &nope; & &#39;x&rsquo;") == "a \u2013 b \u00e9 \u00e9 \U0001f3b5 &lt; &nope; & 'x'"
    assert one(spark, text.html_text, None) is None


def test_numbers_and_sizes(spark):
    assert one(spark, text.leading_int, "12345678901/2") == 12345678901
    assert one(spark, lambda c: text.byte_units(c.cast("bigint")), "1536") == "1.5 KB"
    assert one(spark, text.album_title, "Requiem (1962) [FLAC] - Live") == "Requiem"
    assert one(spark, lambda c: text.work_title(c, F.lit("K"), F.lit("626")), "Requiem, K.626 in D") == "Requiem"


def test_session_blocks(spark):
    block = """590504 Somewhere
THE BLUE NOTES QUINTET:
Personnel: Ann One, Bo Two (tp); Cy Three (p).
Location: Studio A, Old Town
Date: May 4, 1959  Engineer: D. Four
   a. "Night  River" (A. One) 4:37 First Label 12
   b. "Leaving Home" 10:02

NOTE: the second take
is lost

more"""
    got = one(spark, text.session_block, block)
    assert (got["group"], got["personnel"], got["location"], got["engineer"], got["note"]) == ("THE BLUE NOTES QUINTET", "Ann One, Bo Two (tp); Cy Three (p)", "Studio A, Old Town", "D. Four", "the second take is lost")
    assert [tuple(t) for t in got["tunes"]] == [("a", "Night River", "A. One", "4:37", "First Label 12"), ("b", "Leaving Home", None, "10:02", None)]
    empty = one(spark, text.session_block, "")
    assert empty["group"] is None and empty["tunes"] == []
