"""Ordered rules that derive one value from several columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacquer.functions.dates import parse_date, plausible
from lacquer.functions.text import leaf

# Words that announce a compilation and the kinds of occasions.
COMPILATION = (
    r"(?i)\b(?:best of|greatest|anthology|collection|compilation|retrospective|ken burns|the art of|gentle side|mastery of|essential|very best|gold\b|priceless jazz|jazz hour|"
    r"masters?\b|legacy|portrait of|introducing the|definitive|ultimate|classics\b|sampler|his greatest|their greatest)\b"
)
INTERVIEW = r"(?i)\b(?:interview|announcement|speaks|spoken)\b"
REHEARSAL = r"(?i)\b(?:rehearsal|soundcheck|practice|basement)\b"
BROADCAST = r"(?i)\b(?:tv show|television|broadcast|radio|jazz casual|rai\b|ortf|ndr|wdr|sveriges|danmarks|telecast)\b"
LIVE = r"(?i)\b(?:live|concert|in concert|festival|at the|onstage|on stage|tour\b|theatre|theater|hall\b|club\b|jazzhus|konserthuset|set\b|first set|second set|2nd set)\b"
UNOFFICIAL = r"(?i)\b(?:bootleg|unreleased|audience|soundboard|tape|unofficial|private recording)\b"


def is_compilation(text: Column) -> Column:
    return F.coalesce(text.rlike(COMPILATION), F.lit(False))


def provenance(path: Column, has_venue: Column | None = None) -> Column:
    """interview, rehearsal, broadcast, live or studio, the first that holds."""
    text = F.replace(path, F.lit("/"), F.lit(" "))
    live = text.rlike(LIVE) if has_venue is None else text.rlike(LIVE) | has_venue
    return F.when(text.rlike(INTERVIEW), "interview").when(text.rlike(REHEARSAL), "rehearsal").when(text.rlike(BROADCAST), "broadcast").when(live, "live").otherwise("studio")


def authority(path: Column, has_place: Column | None = None) -> Column:
    """unofficial for tapes and for folders named by day and place only, else official."""
    name = leaf(path)
    rest = F.regexp_replace(F.regexp_replace(name, r"\b19[3-7]\d\b|\d{1,2}", ""), r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\b", "")
    words = F.size(F.filter(F.split(F.regexp_replace(rest, r"[,\-()\[\].\s]+", " "), " "), lambda w: w != ""))
    dated = F.coalesce(parse_date(name)["precision"] == "day", F.lit(False))
    place = words <= 3 if has_place is None else has_place | (words <= 3)
    return F.when(path.rlike(UNOFFICIAL) | (dated & place), "unofficial").otherwise("official")


def role(path: Column, subject: str, others: list[str], album_artist: Column) -> Column:
    """leader, co-leader or sideman, by where the subject and other leaders are named."""
    from lacquer.functions.text import flat

    name, text = flat(leaf(path)), F.concat_ws(" ", flat(path), flat(F.coalesce(album_artist, F.lit(""))))
    named = F.filter(F.lit(others), lambda o: text.contains(o))
    mine = F.instr(name, subject)
    at = F.array_min(F.filter(F.transform(named, lambda o: F.position(o, name)), lambda p: p > 0))
    return (
        F.when(F.size(named) == 0, "leader")
        .when(~text.contains(subject), "sideman")
        .when(at.isNull(), "leader")
        .when(mine == 0, "sideman")
        .when(F.abs(mine - at) < 40, "co-leader")
        .when(mine < at, "leader")
        .otherwise("sideman")
    )


def quality_tier(codec: Column, bits: Column, rate: Column) -> Column:
    b, r = F.coalesce(bits, F.lit(0)), F.coalesce(rate, F.lit(0))
    return (
        F.when(codec.startswith("dsd"), "DSD")
        .when(codec.isin("mp3", "aac", "vorbis", "opus"), "Lossy")
        .when((b > 16) | (r > 48000), "Hi-Res")
        .when((b > 0) & (r > 0), "Redbook")
        .otherwise("Unknown")
    )


#: Quality tiers from the best on.
TIERS = ["DSD", "Hi-Res", "Redbook", "Lossy", "Unknown"]


def tier_rank(tier: Column) -> Column:
    """Position in the order of quality; what isn't in it comes last."""
    at = F.array_position(F.lit(TIERS), tier)
    return F.when(at > 0, at).otherwise(len(TIERS) + 1).cast("int")


def format_tier(ext: Column, bits: Column, rate: Column) -> Column:
    hi = (F.coalesce(bits, F.lit(0)) > 16) | (F.coalesce(rate, F.lit(0)) > 48000)
    return (
        F.when(ext.isin(".dsf", ".dff"), "DSD")
        .when(ext.isin(".mp3", ".m4b", ".ogg", ".opus", ".aac"), "Lossy")
        .when(ext.isin(".flac", ".wav", ".aiff", ".aif", ".ape", ".wv", ".m4a") & hi, "Hi-Res")
        .when(ext.isin(".flac", ".wav", ".aiff", ".aif", ".ape", ".wv", ".m4a"), "CD")
        .otherwise("Other")
    )


def resolve_date(folder: Column, tag_date: Column, listed: Column, first: str, last: str) -> Column:
    """struct(iso, precision, source): a day or month of the folder name, a discography's date, its year, the tag's year.

    ``listed`` is struct(iso, precision) and isn't held to the active window; a
    compilation's years are issue years and don't count.
    """
    named = parse_date(leaf(folder))
    fine = named["precision"].isin("day", "month") & plausible(named["iso"], first, last)
    comp = is_compilation(folder)
    year = F.regexp_extract(tag_date, r"(1[89]\d{2}|20[0-4]\d)", 1)

    def of(iso: Column, precision: Column, source: str) -> Column:
        return F.struct(iso.alias("iso"), precision.alias("precision"), F.lit(source).alias("source"))

    return F.coalesce(
        F.when(fine, of(named["iso"], named["precision"], "folder")),
        F.when(listed["iso"].isNotNull(), of(listed["iso"], listed["precision"], "discography")),
        F.when(~comp & plausible(named["iso"], first, last), of(named["iso"], named["precision"], "folder")),
        F.when(~comp & (year != "") & plausible(year, first, last), of(year, F.lit("year"), "tag")),
    )


def verdict(values: Column, sources: Column, strength: Column) -> Column:
    """State of the claims about one field: contested, corroborated, or by the strength of the one source."""
    return (
        F.when(values > 1, "contested")
        .when((sources > 1) & (strength >= 0.75), "corroborated")
        .when(strength >= 0.95, "high")
        .when(strength >= 0.75, "medium")
        .otherwise("low")
    )


def date_consensus(folder: Column, first: Column, second: Column) -> Column:
    """How two outside sources stand to a folder's date, compared to the day."""
    cut = lambda c: F.substring(c, 1, 10)
    a, b, f = cut(first), cut(second), cut(folder)
    return (
        F.when(a.isNotNull() & b.isNotNull() & (a != b), "contested")
        .when(a.isNotNull() & b.isNotNull(), F.when(a.eqNullSafe(f), "confirmed").otherwise("adopt"))
        .when(a.isNotNull() | b.isNotNull(), F.when(F.coalesce(a, b).eqNullSafe(f), "confirmed").otherwise("single-source"))
        .otherwise("unsourced")
    )


def year_state(ours: Column, theirs: Column) -> Column:
    """How an outside release year stands to ours."""
    return (
        F.when(theirs.isNull(), "no external year")
        .when(ours.isNull(), "no local year")
        .when(ours == theirs, "same year")
        .when(theirs > ours, "external pressing later")
        .otherwise("REVIEW external earlier")
    )
