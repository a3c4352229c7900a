"""Queries over rules, sources, sinks and reconciliation that call the library's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacquer.functions import dates, rules, text
from lacquer.operators import credits, groups, joins, ordered, reconcile
from lacquer.plans.music import _venues, query, table
from lacquer.sinks import tables as sinks
from lacquer.sources import probe

# -------------------------------------------------------------------- dates and rules

@query("""
WITH t AS (SELECT t.row_id, r.path, t.recording_date AS tag, nullif(regexp_extract(r.folder_name, '\\b(19[3-7]\\d)\\b', 1), '') AS fy, e.y FROM tracks t JOIN releases r USING (release_id)
  LEFT JOIN (SELECT lower(title) AS k, min(release_year) AS y FROM ext_releases GROUP BY 1) e ON lower(r.title) = e.k WHERE r.path IS NOT NULL),
c AS (SELECT *, regexp_matches(path, '(?i)\\b(best of|greatest|anthology|collection|compilation|retrospective|ken burns|the art of|gentle side|mastery of|essential|very best|gold\\b|priceless jazz|jazz hour|masters?\\b|legacy|portrait of|introducing the|definitive|ultimate|classics\\b|sampler|his greatest|their greatest)\\b') AS comp,
  nullif(regexp_extract(tag, '(1[89]\\d{2}|20[0-4]\\d)', 1), '') AS ty FROM t)
SELECT row_id, CASE WHEN y IS NOT NULL THEN CAST(y AS VARCHAR) WHEN NOT comp AND fy BETWEEN '1935' AND '1975' THEN fy WHEN NOT comp AND ty BETWEEN '1935' AND '1975' THEN ty END AS iso,
  CASE WHEN y IS NOT NULL THEN 'discography' WHEN NOT comp AND fy BETWEEN '1935' AND '1975' THEN 'folder' WHEN NOT comp AND ty BETWEEN '1935' AND '1975' THEN 'tag' END AS source FROM c
""")
def resolved_dates(spark, d):
    """Date and source of every track by the order of folder, discography (an external release of the title) and tag."""
    e = table(spark, d, "ext_releases").groupBy(F.lower("title").alias("k")).agg(F.min("release_year").alias("y"))
    r = table(spark, d, "releases").where("path is not null").select("release_id", F.col("path").alias("folder"), F.lower("title").alias("k")).join(e, "k", "left")
    t = table(spark, d, "tracks").select("row_id", "release_id", "recording_date").join(r, "release_id")
    listed = F.struct(F.col("y").cast("string").alias("iso"), F.lit("year").alias("precision"))
    got = rules.resolve_date(F.col("folder"), F.col("recording_date"), listed, "1935-01-01", "1975-12-31")
    return t.select("row_id", got["iso"].alias("iso"), got["source"].alias("source"))


@query("""
WITH r AS (SELECT release_id, lower(strip_accents(regexp_extract(path, '[^/]*$'))) AS leaf, lower(strip_accents(path || ' ' || coalesce(album_artist, ''))) AS txt FROM releases WHERE path IS NOT NULL),
p AS (SELECT release_id, list_transform([leaf, txt], lambda x: regexp_replace(regexp_replace(x, '[_·‐-―⁃]+', ' ', 'g'), ' {2,}', ' ', 'g')) AS ps FROM r),
q AS (SELECT release_id, ps[1] AS leaf, ps[2] AS txt, instr(ps[1], 'music') AS mine, list_filter(['sessions', 'plays', 'evening'], lambda o: contains(ps[2], o)) AS named FROM p),
s AS (SELECT *, list_min(list_filter(list_transform(named, lambda o: instr(leaf, o)), lambda x: x > 0)) AS at_ FROM q)
SELECT release_id, CASE WHEN len(named) = 0 THEN 'leader' WHEN NOT contains(txt, 'music') THEN 'sideman' WHEN at_ IS NULL THEN 'leader' WHEN mine = 0 THEN 'sideman' WHEN abs(mine - at_) < 40 THEN 'co-leader' WHEN mine < at_ THEN 'leader' ELSE 'sideman' END AS role FROM s
""")
def roles(spark, d):
    """The part a subject plays, by where it and others are named in folders."""
    r = table(spark, d, "releases").where("path is not null")
    return r.select("release_id", rules.role(F.col("path"), "music", ["sessions", "plays", "evening"], F.col("album_artist")).alias("role"))


@query("""
WITH r AS (SELECT release_id, path, folder_name, codec, genre_primary, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\b19[3-7]\\d\\b|\\d{1,2}', '', 'g'), '(?i)\\b(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\\b', '', 'g'), '[,\\-()\\[\\].\\s]+', ' ', 'g')) AS rest FROM releases WHERE path IS NOT NULL)
SELECT release_id, CASE WHEN regexp_matches(path, '(?i)\\b(bootleg|unreleased|audience|soundboard|tape|unofficial|private recording)\\b')
    OR (regexp_matches(regexp_extract(path, '[^/]*$'), '\\b19[3-7]\\d[-.]\\d{1,2}[-.]\\d{1,2}\\b') AND len(list_filter(string_split(rest, ' '), lambda w: w <> '')) <= 3) THEN 'unofficial' ELSE 'official' END AS authority,
  CASE WHEN starts_with(codec, 'dsd_') THEN 'SACD' WHEN regexp_matches(folder_name, '(?i)\\bSACD\\b|\\bDSD\\d*\\b|\\bDSF\\b|\\bISO\\b') THEN 'SACD' WHEN regexp_matches(folder_name, '(?i)\\bvinyl\\b|\\bLP\\b|\\b45\\s?RPM\\b|\\bMFSL\\b|\\banalogue productions\\b|\\b180g\\b') THEN 'Vinyl'
    WHEN regexp_matches(folder_name, '(?i)\\bblu-?ray\\b|\\bBDA\\b|\\bblu-?spec\\b') THEN 'Blu-ray' WHEN regexp_matches(folder_name, '(?i)\\bHDTracks\\b|\\bQobuz\\b|\\bTidal\\b|\\bWEB\\b|\\bhi-?res\\b') THEN 'Web' WHEN regexp_matches(folder_name, '(?i)\\bCD\\b|\\bEAC\\b|\\bredbook\\b') THEN 'CD' ELSE 'Unknown' END AS medium,
  array_to_string(list_filter(['Archive', 'New'], lambda n: list_contains(list_transform(string_split(path, '/'), lambda s: lower(s)), lower(n))), '; ') AS collections FROM r
""")
def release_rules(spark, d):
    """Authority, medium and collections of releases by their paths."""
    r = table(spark, d, "releases").where("path is not null")
    p = F.col("path")
    return r.select("release_id", rules.authority(p).alias("authority"), text.medium_of(F.col("folder_name"), F.col("codec")).alias("medium"), F.array_join(text.in_collections(p, ["Archive", "New"]), "; ").alias("collections"))


def _genre_sql(c: str, prefix: bool) -> str:
    arms = []
    for g, ks in text.GENRES.items():
        any_of = "|".join(ks)
        arms.append(f"WHEN regexp_matches(lower(strip_accents({c})), '{chr(92) + 'b' if prefix else ''}({any_of})') THEN '{g}'")
    return "CASE " + " ".join(arms) + " END"


@query(f"""
SELECT release_id, coalesce(list_filter(list_transform(string_split(path, '/'), lambda s: {_genre_sql("s", True)}), lambda g: g IS NOT NULL)[1], {_genre_sql("genre_primary", False)}, CASE WHEN trim(genre_primary) <> '' THEN genre_primary END) AS genre,
  {_genre_sql("path", False)} AS fast FROM releases WHERE path IS NOT NULL
""")
def genres(spark, d):
    """Genre by the path's folders, then the tag; and the quick variant by a keyword anywhere in the path."""
    r = table(spark, d, "releases").where("path is not null")
    return r.select("release_id", text.genre_of(F.col("path"), F.col("genre_primary"), F.lit(False)).alias("genre"), text.genre_of_fast(F.col("path")).alias("fast"))


@query("""
SELECT row_id, strftime(CAST(recording_date AS DATE), '%Y-%m-%d') AS session FROM tracks WHERE length(recording_date) = 10 AND recording_date BETWEEN '1900' AND '1999-12-31'
""")
def session_dates(spark, d):
    """Dates out of session numbers (YYMMDD)."""
    t = table(spark, d, "tracks").where("length(recording_date) = 10 and recording_date between '1900' and '1999-12-31'")
    number = F.concat(F.regexp_replace(F.substring("recording_date", 3, 8), "-", ""), F.lit("-1"))
    return t.select("row_id", dates.session_date(number).alias("session"))


@query("SELECT row_id, CAST(round(floor(duration_seconds * 75) / 75, 6) AS DOUBLE) AS seconds FROM tracks WHERE duration_seconds IS NOT NULL")
def cue_times(spark, d):
    """Seconds out of cue times (mm:ss:ff)."""
    t = table(spark, d, "tracks").where("duration_seconds is not null").withColumn("f", F.floor(F.col("duration_seconds") * 75).cast("bigint"))
    stamp = F.format_string("%02d:%02d:%02d", F.floor(F.col("f") / 4500).cast("bigint"), F.floor(F.col("f") / 75).cast("bigint") % 60, F.col("f") % 75)
    return t.select("row_id", F.round(dates.cue_seconds(stamp), 6).alias("seconds"))


@query("""
SELECT row_id, CASE WHEN ext IN ('.dsf', '.dff') THEN 'DSD' WHEN ext IN ('.mp3', '.m4b', '.ogg', '.opus', '.aac') THEN 'Lossy' WHEN ext IN ('.flac', '.wav', '.aiff', '.aif', '.ape', '.wv', '.m4a') THEN CASE WHEN coalesce(bit_depth, 0) > 16 OR coalesce(sample_rate, 0) > 48000 THEN 'Hi-Res' ELSE 'CD' END ELSE 'Other' END AS tier,
  CASE WHEN starts_with(codec, 'dsd') THEN 1 WHEN codec IN ('mp3', 'aac', 'vorbis', 'opus') THEN 4 WHEN coalesce(bit_depth, 0) > 16 OR coalesce(sample_rate, 0) > 48000 THEN 2 WHEN coalesce(bit_depth, 0) > 0 AND coalesce(sample_rate, 0) > 0 THEN 3 ELSE 5 END AS rank
FROM (SELECT *, lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) AS ext FROM tracks WHERE path IS NOT NULL)
""")
def format_tiers(spark, d):
    """Tier by the file's ending, and the rank of the tier by its codec."""
    t = table(spark, d, "tracks").where("path is not null")
    tier = rules.quality_tier(F.col("codec"), F.col("bit_depth"), F.col("sample_rate"))
    return t.select("row_id", rules.format_tier(text.extension(F.col("path")), F.col("bit_depth"), F.col("sample_rate")).alias("tier"), rules.tier_rank(tier).alias("rank"))


# ---------------------------------------------------------------------------- texts


@query("""
SELECT row_id, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) AS words,
  trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[(\\[][^)\\]]*[)\\]]', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', '^(the|a|an) ', '')) AS folded
FROM tracks WHERE title IS NOT NULL
""")
def reconcile_keys(spark, d):
    """Word keys of titles, and their keys for comparison with outside sources."""
    t = table(spark, d, "tracks").where("title is not null")
    return t.select("row_id", text.words_key(F.col("title")).alias("words"), F.trim(F.regexp_replace(F.concat(F.trim(text.reconcile_key(F.col("title"))), F.lit(" ")), "^(?:the|a|an) ", "")).alias("folded"))


@query("""
WITH h AS (SELECT row_id, title, composer FROM tracks WHERE title IS NOT NULL AND composer IS NOT NULL AND NOT regexp_matches(title || composer, '[<>&\\x{2018}\\x{2019}\\x{201c}\\x{201d}\\x{a0}]'))
SELECT row_id, trim(regexp_replace(title || chr(10) || composer || ' & ' || 'é–' || chr(10) || '&lt; x', ' *' || chr(10) || '[' || chr(10) || ' ]*', chr(10), 'g'), ' ' || chr(10)) AS flat FROM (SELECT row_id, regexp_replace(title, '[ \\t\\v\\f\\r]+', ' ', 'g') AS title, regexp_replace(composer, '[ \\t\\v\\f\\r]+', ' ', 'g') AS composer FROM h)
""")
def html_flattened(spark, d):
    """Markup around titles and composers, flattened and decoded."""
    t = table(spark, d, "tracks").where("title is not null and composer is not null").where(~F.concat("title", "composer").rlike("[<>&\u2018\u2019\u201c\u201d\u00a0]"))
    page = F.concat(F.lit("<div class='x'>"), "title", F.lit("<br/>"), "composer", F.lit(" &amp; &eacute;&#8211;</div><p><b>&amp;lt; x</b></p>"))
    return t.select("row_id", text.html_text(page).alias("flat"))


@query("""
WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([A-Z][a-z]+ [A-Z][a-z]+)', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(list_filter(ps, lambda b: length(b) >= 60 AND regexp_matches(b, '^[A-Z][a-z]+ [A-Z][a-z]+'))) AS BIGINT) AS blocks FROM s
""")
def text_blocks(spark, d):
    """Blocks of documents from one capitalised pair of words to the next."""
    marked = F.regexp_replace("text", r"([A-Z][a-z]+ [A-Z][a-z]+)", "\x01$1")
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(ordered.blocks(marked, "\x01[A-Z][a-z]+ [A-Z][a-z]+", 61)).cast("bigint").alias("blocks"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, pos, sum(CASE WHEN length(line) >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM l)
SELECT doc_id, CAST(grp AS BIGINT) AS "group", count(*) AS lines FROM g WHERE grp > 0 GROUP BY 1, 2
""")
def line_groups(spark, d):
    """Lines of documents by the latest long line before them."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return ordered.state_groups(lines, "doc_id", "pos", F.length("line") >= 60).groupBy("doc_id", F.col("group").cast("bigint").alias("group")).agg(F.count("*").alias("lines"))


@query("""
SELECT row_id, CASE WHEN row_id % 2 = 0 THEN regexp_extract(path, '[^/]*$') ELSE title END AS scrubbed, row_id % 2 = 0 AS leaked FROM tracks WHERE path IS NOT NULL AND title IS NOT NULL AND NOT regexp_matches(title, '[A-Za-z]:[\\\\/]|/(Users|home|mnt|media|Volumes)/|^~/')
""")
def path_scrub(spark, d):
    """Local paths inside texts cut to their last part; titles stay."""
    t = table(spark, d, "tracks").where("path is not null and title is not null").where(~text.leaks(F.col("title")))
    s = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("ripped from C:\\Users\\x\\"), F.replace("path", F.lit("/"), F.lit("\\")))).otherwise(F.col("title"))
    return t.select("row_id", text.scrub(s).alias("scrubbed"), text.leaks(s).alias("leaked"))


# --------------------------------------------------------------- sources and their cache


@query("""
WITH p AS (SELECT *, CASE WHEN size % 7 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN size % 5 = 0 THEN '/old' ELSE '/music' END AS root FROM raw_probe),
ok AS (SELECT path, arg_max({'s': size, 'm': mtime}, probe_id) AS r FROM p WHERE version = 2 AND root = '/music' AND kind = 'audio' AND size IS NOT NULL AND mtime IS NOT NULL AND error IS NULL GROUP BY path)
SELECT path, r.s AS size, r.m AS mtime FROM ok WHERE path IS NOT NULL
""")
def reusable_records(spark, d):
    """Earlier probe records that may be reused: of this version and root, readable, the last of a path."""
    p = table(spark, d, "raw_probe").where("path is not null").select("path", "kind", "size", "mtime", "error", F.when(F.col("size") % 7 == 0, 1).otherwise(2).alias("version"), F.when(F.col("size") % 5 == 0, "/old").otherwise("/music").alias("root"), F.col("probe_id").alias("seq"))
    return probe.usable_cache(p, 2, "/music", retry_errors=True).select("path", "size", "mtime")


@query("SELECT path, arg_max(size, coalesce(mtime, -1)) AS size, arg_max(error IS NULL, coalesce(mtime, -1)) AS readable FROM raw_probe GROUP BY path HAVING count(DISTINCT coalesce(mtime, -1)) = count(*)")
def scan_index(spark, d):
    """The latest record of each path, whether it was readable; paths with two records of one time left out."""
    p = table(spark, d, "raw_probe")
    once = p.groupBy("path").agg(F.count_distinct(F.coalesce("mtime", F.lit(-1))).alias("k"), F.count("*").alias("n")).where("k = n").select(F.col("path").alias("_p"))
    return sinks.scan_index(p.join(once, p["path"].eqNullSafe(F.col("_p")), "left_semi")).select("path", "size", "readable")


@query("SELECT track_id, arg_min(row_id, row_id) AS row_id FROM tracks WHERE track_id IS NOT NULL GROUP BY 1")
def first_loads(spark, d):
    """The first row of every file that was loaded."""
    return probe.first_rows(table(spark, d, "tracks").where("track_id is not null").select("track_id", "row_id"), "track_id", "row_id")


@query("SELECT DISTINCT path FROM tracks WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM raw_probe WHERE path IS NOT NULL) ORDER BY path LIMIT 41")
def first_missing(spark, d):
    """The first paths that a fresh walk does not find: the report stops early."""
    return probe.first_missing(table(spark, d, "tracks").where("path is not null"), table(spark, d, "raw_probe").where("path is not null"))


# ------------------------------------------------------------- reconciliation and sinks


@query("""
WITH n AS (SELECT release_id, title AS fact, count(*) AS n FROM tracks WHERE release_id IS NOT NULL AND trim(title) <> '' GROUP BY 1, 2)
SELECT release_id, fact, n, row_number() OVER (PARTITION BY release_id ORDER BY n DESC, fact) AS place FROM n
""")
def release_facts(spark, d):
    """The titles of each release, commonest first."""
    return reconcile.facts(table(spark, d, "tracks").where("release_id is not null"), "release_id", "title")


@query("""
SELECT lower(title) AS k, arg_max(ext_release_id, {'s': track_count, 'p': -release_year}) AS best FROM ext_releases WHERE track_count IS NOT NULL AND release_year IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (track_count, release_year)) = count(*)
""")
def best_results(spark, d):
    """Of the external releases of a title the one with most tracks, the earliest on ties; equal ones left out."""
    e = table(spark, d, "ext_releases").where("track_count is not null and release_year is not null").select(F.lower("title").alias("k"), "ext_release_id", "track_count", "release_year")
    one = e.groupBy("k").agg(F.count_distinct("track_count", "release_year").alias("d"), F.count("*").alias("n")).where("d = n").select("k")
    return reconcile.best_result(e.join(one, "k", "left_semi"), "k", "track_count", "release_year").select("k", F.col("ext_release_id").alias("best"))


_PROPOSED = """
WITH v AS (SELECT release_id, artist_tag AS value, count(*) AS n FROM tracks WHERE release_id IS NOT NULL AND trim(artist_tag) <> '' GROUP BY 1, 2)
"""


def _proposed(spark, d):
    return table(spark, d, "tracks").where("release_id is not null").where(F.trim("artist_tag") != "").groupBy("release_id", F.col("artist_tag").alias("value")).agg(F.count("*").alias("n"))


@query(_PROPOSED + "SELECT r.release_id, count(v.value) AS candidates, arg_min(value, {'o': -n, 'c': value}) AS best, max(n) AS certainty FROM releases r LEFT JOIN v USING (release_id) GROUP BY 1")
def attached_proposals(spark, d):
    """Releases with the number of artists their tracks name, and the commonest."""
    out = groups.attach_proposals(table(spark, d, "releases").select("release_id"), _proposed(spark, d), "release_id", "value", "n")
    return out.select("release_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), "best", "certainty")


@query(_PROPOSED + "SELECT release_id, value AS candidate, n AS certainty, row_number() OVER (PARTITION BY release_id ORDER BY n DESC, value) AS place FROM v")
def ranked_proposals(spark, d):
    """Every artist that a release's tracks name, in order."""
    return groups.ranked_proposals(_proposed(spark, d), "release_id", "value", "n")


@query("""
WITH m AS (SELECT lower(title) AS cluster, release_id AS member, CAST(track_count AS BIGINT) AS size, CASE WHEN codec = 'flac' THEN 1 ELSE 2 END AS tier FROM releases WHERE title IS NOT NULL),
c AS (SELECT cluster FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT cluster, member, size, row_number() OVER (PARTITION BY cluster ORDER BY tier, coalesce(size, 0) DESC, member) - 1 AS copy, bool_and(tier = 1) OVER (PARTITION BY cluster) AS safe FROM m JOIN c USING (cluster)
""")
def copies_ranked(spark, d):
    """The releases of one title as copies, best first."""
    m = table(spark, d, "releases").where("title is not null").select(F.lower("title").alias("cluster"), F.col("release_id").alias("member"), F.col("track_count").cast("bigint").alias("size"), F.when(F.col("codec") == "flac", 1).otherwise(2).alias("tier"))
    m = m.join(m.groupBy("cluster").count().where("count > 1"), "cluster", "left_semi").withColumn("same", F.col("tier") == 1).withColumn("sure", F.lit("high"))
    return groups.copies(m, "cluster", "member", "tier", "size", "same", "sure")


@query(_PROPOSED + """, b AS (SELECT release_id, arg_max(value, {'n': n, 'v': value}) AS best, count(*) AS vals FROM v GROUP BY 1)
SELECT b.release_id, r.album_artist AS current, best AS proposed FROM b LEFT JOIN releases r USING (release_id) WHERE best IS DISTINCT FROM r.album_artist AND b.release_id NOT IN (SELECT release_id FROM releases WHERE codec = 'flac')
""")
def open_changes(spark, d):
    """Proposals that would change something and that nobody has decided on (those of flac releases are)."""
    r = table(spark, d, "releases")
    b = _proposed(spark, d).groupBy("release_id").agg(F.max_by("value", F.struct("n", "value")).alias("proposed")).join(r.select("release_id", F.col("album_artist").alias("current")), "release_id", "left")
    return reconcile.changes(reconcile.undecided(b, r.where("codec = 'flac'"), "release_id"), "proposed", "current")


@query("SELECT release_id, track_count FROM releases r WHERE track_count >= 2 AND contains(lower(path), 'jazz') AND NOT EXISTS (SELECT 1 FROM ext_releases e WHERE e.title = r.title)")
def eligible_releases(spark, d):
    """Releases to ask an outside source about: two tracks or more, on the jazz shelf, title not found yet."""
    r = table(spark, d, "releases").select("release_id", "track_count", "path", "title")
    return reconcile.eligible(r.where("title is not null"), table(spark, d, "ext_releases").select("title"), "title", "track_count", "jazz").select("release_id", "track_count").unionByName(
        reconcile.eligible(r.where("title is null"), table(spark, d, "ext_releases").where("false").select(F.col("ext_release_id").alias("release_id")), "release_id", "track_count", "jazz").select("release_id", "track_count")
    )


@query("""
WITH a AS (SELECT lower(title) AS k, min(release_year) AS y FROM ext_releases GROUP BY 1),
b AS (SELECT release_id, min(recording_date) AS x FROM tracks GROUP BY 1)
SELECT r.release_id, CASE WHEN a.y IS NULL THEN NULL WHEN coalesce(x, '') = '' THEN 'no local date' WHEN substr(x, 1, 4) = CAST(a.y AS VARCHAR) THEN 'agree' ELSE 'DIFFER' END AS state FROM releases r LEFT JOIN a ON lower(r.title) = a.k LEFT JOIN b USING (release_id)
""")
def date_agreement(spark, d):
    """How the year of an external release stands to the earliest date of ours."""
    a = table(spark, d, "ext_releases").groupBy(F.lower("title").alias("k")).agg(F.min("release_year").cast("string").alias("y"))
    b = table(spark, d, "tracks").groupBy("release_id").agg(F.min("recording_date").alias("x"))
    r = table(spark, d, "releases").select("release_id", F.lower("title").alias("k")).join(a, "k", "left").join(b, "release_id", "left")
    return r.select("release_id", reconcile.date_agreement(F.col("x"), F.col("y")).alias("state"))


@query("""
WITH s AS (SELECT r.release_id, e.ext_release_id, CASE WHEN lower(r.title) = lower(e.title) THEN 1 ELSE 2 END AS q, least(r.track_count, e.track_count) * 1.0 / greatest(r.track_count, e.track_count, 1) AS ratio
           FROM releases r JOIN ext_releases e ON r.release_year = e.release_year AND (lower(r.title) = lower(e.title) OR r.album_artist = e.artist_credit) WHERE r.track_count > 0 AND e.track_count > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY release_id, q ORDER BY ratio DESC, ext_release_id) AS rank FROM s),
f AS (SELECT * FROM k WHERE rank <= 5), st AS (SELECT release_id, min(q) AS stop FROM f WHERE ratio >= 0.9 GROUP BY 1)
SELECT f.release_id, arg_max(ext_release_id, {'a': ratio, 'b': -q, 'c': -rank}) AS winner FROM f LEFT JOIN st USING (release_id) WHERE stop IS NULL OR q <= stop GROUP BY 1
""")
def search_winners(spark, d):
    """The answer a search by title, then by artist, of the same year would accept, stopping at a ratio of 0.9."""
    r = table(spark, d, "releases").where("track_count > 0").select("release_id", F.lower("title").alias("t"), F.col("album_artist").alias("a"), "release_year", F.col("track_count").alias("n"))
    e = table(spark, d, "ext_releases").where("track_count > 0").select("ext_release_id", F.lower("title").alias("t"), F.col("artist_credit").alias("a"), "release_year", F.col("track_count").alias("m"))
    by_title = r.join(e.drop("a"), ["release_year", "t"]).withColumn("q", F.lit(1))
    by_artist = r.withColumnRenamed("t", "t1").join(e.withColumnRenamed("t", "t2"), ["release_year", "a"]).where("not (t1 <=> t2 and t1 is not null)").withColumn("q", F.lit(2))
    cols = ["release_id", "ext_release_id", "q", (F.least("n", "m") / F.greatest("n", "m")).alias("ratio")]
    both = by_title.select(*cols).unionByName(by_artist.select(*cols)).withColumn("o", -F.col("ratio"))
    ranked = ordered.spread_number(both, ["release_id", "q"], ["o", "ext_release_id"], "rank").drop("o")
    return reconcile.search_winner(ranked, "release_id", "q", "ratio").select("release_id", F.col("ext_release_id").alias("winner"))


@query("""
WITH a AS (SELECT p.path, max(e.release_year) FILTER (e.release_year IS NOT NULL) AS y FROM (SELECT path, lower(title) AS k FROM releases WHERE codec = 'flac' AND path IS NOT NULL) p JOIN (SELECT lower(title) AS k, min(release_year) AS release_year FROM ext_releases GROUP BY 1) e USING (k) GROUP BY 1),
b AS (SELECT lower(title) AS k, arg_min({'y': release_year}, ext_release_id).y AS y FROM ext_releases WHERE trim(title) <> '' GROUP BY 1)
SELECT r.release_id, coalesce(a.y, b.y) AS outside_date FROM releases r LEFT JOIN a USING (path) LEFT JOIN b ON lower(r.title) = b.k
""")
def report_dates(spark, d):
    """Releases with an outside year by their path (answers for flac releases), else by their title."""
    e, r = table(spark, d, "ext_releases"), table(spark, d, "releases").select("release_id", "path", "title", "codec")
    by_title = e.select(F.lit(None).cast("string").alias("path"), "title", F.col("release_year").alias("date"), F.col("ext_release_id").alias("o"))
    years = e.groupBy(F.lower("title").alias("k")).agg(F.min("release_year").alias("date"))
    by_path = r.where("codec = 'flac' and path is not null").select("path", F.lower("title").alias("k")).join(years, "k").groupBy("path").agg(F.max("date").alias("date")).select("path", F.lit(None).cast("string").alias("title"), "date", F.lit("").alias("o"))
    return reconcile.report_join(r, by_path.unionByName(by_title), "path", "title", "date", "o").select("release_id", "outside_date")


@query("""
WITH v AS (SELECT release_id, artist_tag, count(*) AS n, min(row_id) AS p FROM tracks WHERE release_id IS NOT NULL AND trim(artist_tag) <> '' GROUP BY 1, 2),
m AS (SELECT release_id, arg_max(artist_tag, {'n': n, 'p': -p}) AS tagged FROM v GROUP BY 1),
c AS (SELECT r.release_id, coalesce(m.tagged, nullif(trim(r.album_artist), '')) AS name, CASE WHEN m.tagged IS NOT NULL THEN 'tag' WHEN trim(r.album_artist) <> '' THEN 'folder_path' END AS source, CASE WHEN m.tagged IS NOT NULL THEN 'high' WHEN trim(r.album_artist) <> '' THEN 'medium' END AS conf FROM releases r LEFT JOIN m USING (release_id))
SELECT t.row_id, CASE WHEN trim(coalesce(t.artist_tag, '')) <> '' THEN t.artist_tag ELSE c.name END AS artist, CASE WHEN trim(coalesce(t.artist_tag, '')) <> '' THEN 'tag' ELSE c.source END AS artist_source, CASE WHEN trim(coalesce(t.artist_tag, '')) <> '' THEN 'high' ELSE c.conf END AS artist_confidence
FROM tracks t LEFT JOIN c USING (release_id)
""")
def credits_inherited(spark, d):
    """Artists of tracks: their own, else the release's by its tags' majority, else by its folder."""
    t = table(spark, d, "tracks")
    tagged = groups.majority(t.where("release_id is not null"), ["release_id"], "artist_tag", "row_id", "tagged")
    r = table(spark, d, "releases").join(tagged, "release_id", "left")
    c = credits.release_credit(F.col("tagged"), text.blank_to_null(F.trim("album_artist")), F.lit("medium"))
    r = r.select("release_id", c["name"].alias("artist"), c["source"].alias("artist_source"), c["confidence"].alias("artist_confidence"))
    return credits.inherited(t.select("row_id", "release_id", F.col("artist_tag").alias("artist")), r, "release_id", "artist").drop("release_id")


@query("""
WITH v AS (SELECT venue AS term, min(row_id) AS ord, min(city) AS home FROM tracks WHERE trim(venue) <> '' GROUP BY 1), c AS (SELECT city AS term, min(row_id) AS ord FROM tracks WHERE trim(city) <> '' GROUP BY 1),
f AS (SELECT release_id, ' ' || trim(regexp_replace(lower(strip_accents(folder_name)), '[^a-z0-9'']+', ' ', 'g')) || ' ' AS f FROM releases WHERE folder_name IS NOT NULL),
key(term, kind, ord, home, k) AS (SELECT term, 'v', ord, home, ' ' || trim(regexp_replace(lower(strip_accents(term)), '[^a-z0-9'']+', ' ', 'g')) || ' ' FROM v UNION ALL SELECT term, 'c', ord, NULL, ' ' || trim(regexp_replace(lower(strip_accents(term)), '[^a-z0-9'']+', ' ', 'g')) || ' ' FROM c),
h AS (SELECT release_id, arg_min({'t': term, 'h': home}, ord) FILTER (kind = 'v') AS v, arg_min(term, ord) FILTER (kind = 'c') AS c FROM f JOIN key ON contains(f, k) WHERE trim(k) <> '' GROUP BY 1)
SELECT release_id, v.t AS venue, coalesce(v.h, c) AS city FROM h
""")
def places_in_folders(spark, d):
    """Venue and city named in a folder: the first venue of the list with its city, else the first city."""
    r = table(spark, d, "releases").where("folder_name is not null")
    t = table(spark, d, "tracks").where(F.trim("city") != "")
    cities = t.groupBy(F.col("city").alias("term")).agg(F.min("row_id").alias("ord"))
    return joins.first_places(r, "release_id", "folder_name", _venues(spark, d), cities)


@query("""
WITH s AS (SELECT lineup_id, list_distinct(list_filter(list_transform(members, lambda m: trim(m.name)), lambda n: n <> '')) AS band, lead(list_distinct(list_filter(list_transform(members, lambda m: trim(m.name)), lambda n: n <> ''))) OVER (PARTITION BY band_id ORDER BY ord) AS nxt FROM lineups WHERE members IS NOT NULL)
SELECT lineup_id, array_to_string(list_sort(list_filter(band, lambda n: NOT list_contains(nxt, n))), '; ') AS gone FROM s WHERE nxt IS NOT NULL
""")
def members_gone(spark, d):
    """Members of a lineup that are not in the band's next one: set difference."""
    names = F.array_distinct(F.filter(F.transform("members", lambda m: F.trim(m["name"])), lambda n: n != ""))
    lu = table(spark, d, "lineups").where("members is not null").select("lineup_id", "band_id", "ord", names.alias("band"))
    nxt = ordered.spread_number(lu.select("band_id", "ord", "lineup_id", "band"), ["band_id"], ["ord"], "n")
    after = nxt.select("band_id", (F.col("n") - 1).alias("n"), F.col("band").alias("nxt"))
    return nxt.join(after, ["band_id", "n"]).select("lineup_id", F.array_join(F.array_sort(F.array_except("band", "nxt")), "; ").alias("gone"))


@query("""
WITH t AS (SELECT row_id, substr(recording_date, 1, 4) AS y, row_number() OVER (ORDER BY recording_date, row_id) AS p FROM tracks WHERE recording_date IS NOT NULL)
SELECT row_id, CASE WHEN y IS DISTINCT FROM lag(y) OVER (ORDER BY p) THEN y END AS header FROM t
""")
def year_headers(spark, d):
    """Tracks in order of date with a header where the year changes."""
    t = table(spark, d, "tracks").where("recording_date is not null").select("row_id", "recording_date")
    return ordered.year_headers(t, "recording_date", ["recording_date", "row_id"]).select("row_id", "header")


@query("SELECT row_id FROM tracks WHERE coalesce(recording_date, '') = '1950'")
def on_a_date(spark, d):
    """Tracks of exactly one date."""
    return table(spark, d, "tracks").where(F.coalesce("recording_date", F.lit("")) == "1950").select("row_id")


@query("""
SELECT row_id, row_number() OVER (PARTITION BY release_id ORDER BY coalesce(disc_number, 0), coalesce(track_number, 0), filename, row_id) AS place FROM tracks WHERE release_id IS NOT NULL AND filename IS NOT NULL
""")
def album_places(spark, d):
    """Tracks in the order of the album: disc, number, file name."""
    t = table(spark, d, "tracks").where("release_id is not null and filename is not null").select("row_id", "release_id", F.coalesce("disc_number", F.lit(0)).alias("a"), F.coalesce("track_number", F.lit(0)).alias("b"), "filename")
    return ordered.spread_number(t, ["release_id"], ["a", "b", "filename", "row_id"], "place").select("row_id", "place")


@query("""
WITH b AS (SELECT doc_id, n_chars AS v, kind FROM documents), i AS (SELECT doc_id, min(band) AS kind FROM reading_labels GROUP BY 1)
SELECT doc_id, NULL AS v, kind FROM i UNION ALL SELECT doc_id, v, kind FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = b.doc_id)
""")
def upserted(spark, d):
    """Labels put over documents by key: incoming rows win, others stay."""
    i = table(spark, d, "reading_labels").groupBy("doc_id").agg(F.min("band").alias("kind"))
    return sinks.upsert(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v"), "kind"), i, "doc_id")


@query("""
WITH m AS (SELECT lower(title) AS k, min(label) AS v FROM ext_releases WHERE label IS NOT NULL GROUP BY 1)
SELECT r.release_id, coalesce(m.v, r.label) AS label, CASE WHEN m.v IS NOT NULL THEN 'outside' END AS label_source, CASE WHEN m.v IS NOT NULL THEN 'medium' END AS label_confidence FROM releases r LEFT JOIN m ON lower(r.title) = m.k
""")
def values_applied(spark, d):
    """Labels of an outside catalogue applied to releases, with source and confidence beside them."""
    m = table(spark, d, "ext_releases").where("label is not null").groupBy(F.lower("title").alias("k")).agg(F.min("label").alias("value"))
    r = table(spark, d, "releases").select("release_id", F.lower("title").alias("k"), "label")
    decided = r.join(m, "k").select("release_id", "value", F.lit("outside").alias("source"), F.lit("medium").alias("confidence"))
    return sinks.apply_values(r.drop("k"), decided, "release_id", "label")


@query("SELECT probe_id, len(map_keys(tags)) AS before, true AS restored FROM raw_probe WHERE tags IS NOT NULL AND kind = 'audio'")
def tags_undone(spark, d):
    """A tag plan written with a journal and undone: every file is as it was."""
    p = table(spark, d, "raw_probe").where("tags is not null and kind = 'audio'").select("probe_id", "tags")
    plan = p.select("probe_id", F.create_map(F.lit("title"), F.lit("T"), F.lit("new"), F.lit("x")).alias("changes"))
    log = sinks.journal(p, plan, "probe_id")
    back = sinks.undo(sinks.write_tags(p, plan, "probe_id"), log, "probe_id").select("probe_id", F.col("tags").alias("again"))
    flat = lambda c: F.array_sort(F.map_entries(c))
    return p.join(back, "probe_id").select("probe_id", F.size("tags").cast("bigint").alias("before"), (flat("tags") == flat("again")).alias("restored"))


@query("""
SELECT release_id, 'decade/' || lpad(CAST(release_year % 100 AS VARCHAR), 2, '0') || ' ' || trim(regexp_replace(regexp_replace(codec, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g')) || CASE WHEN track_count > 10 THEN ' (review)' ELSE '' END AS name FROM releases WHERE codec IS NOT NULL AND release_year IS NOT NULL AND track_count IS NOT NULL
""")
def playlist_names(spark, d):
    """Names of playlist files with number, label and a mark for review."""
    r = table(spark, d, "releases").where("codec is not null and release_year is not null and track_count is not null")
    return r.select("release_id", sinks.playlist_name(F.lit("decade"), F.col("codec"), F.col("release_year") % 100, F.col("track_count") > 10).alias("name"))


@query("""
WITH c AS (SELECT lower(venue) AS k, venue FROM tracks WHERE trim(venue) <> '')
SELECT outcome, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT CASE WHEN trim(album_artist) <> '' THEN 'medium' WHEN genre_primary IS NOT NULL THEN 'group only' ELSE 'none' END AS outcome, CASE WHEN trim(album_artist) <> '' THEN album_artist END AS name FROM releases) GROUP BY 1
""")
def credit_coverage(spark, d):
    """How many releases have a credit, a group only, or nothing."""
    r = table(spark, d, "releases").select(text.blank_to_null(F.col("album_artist")).alias("name"), F.lit("medium").alias("confidence"), F.when(F.col("genre_primary").isNotNull(), F.array("genre_primary")).alias("groups"))
    return credits.evaluation(r, "name", "confidence", "groups")


@query("""
SELECT t.row_id, t.track_id, t.release_id, t.path, t.title, t.composer, t.tune, t.take, t.recording_date, t.date_precision, substr(t.recording_date, 1, 4) AS year, coalesce(t.venue, '') AS venue, r.title AS album, r.album_artist, r.genre_primary AS genre, r.label,
  CASE WHEN starts_with(t.codec, 'dsd') THEN 'DSD' WHEN t.codec IN ('mp3', 'aac', 'vorbis', 'opus') THEN 'Lossy' WHEN coalesce(t.bit_depth, 0) > 16 OR coalesce(t.sample_rate, 0) > 48000 THEN 'Hi-Res' WHEN coalesce(t.bit_depth, 0) > 0 AND coalesce(t.sample_rate, 0) > 0 THEN 'Redbook' ELSE 'Unknown' END AS tier
FROM tracks t JOIN releases r USING (release_id)
""")
def track_rows(spark, d):
    """The build's track row: a track's own fields, what its release lends it, and what rules derive."""
    return sinks.track_rows(table(spark, d, "tracks"), table(spark, d, "releases"))


@query("""
SELECT recording_date AS date, coalesce(nullif(trim(venue), ''), nullif(trim(city), ''), '') AS place, count(*) AS tracks, count(DISTINCT release_id) AS releases, count(DISTINCT tune) AS tunes, min(row_id) AS first_row, CAST(sum(size_bytes) AS BIGINT) AS bytes
FROM tracks WHERE recording_date IS NOT NULL GROUP BY 1, 2
""")
def session_rows(spark, d):
    """The session build's rows: what was recorded at one place on one date."""
    return sinks.session_rows(table(spark, d, "tracks"))


@query("""
SELECT row_id, coalesce(nullif(trim(recording_date), ''), 'undated') || ' - ' || coalesce(CASE WHEN trim(tune) <> '' THEN tune END, 'untitled') || CASE WHEN regexp_full_match(take, '\\d+') THEN ' (take ' || take || ')' WHEN take IS NOT NULL THEN ' (' || take || ' take)' ELSE '' END
  || CASE WHEN lower(venue) LIKE '%room%' THEN ' [live]' ELSE '' END AS label FROM tracks
""")
def session_labels(spark, d):
    """Entries of session playlists."""
    kind = F.when(F.lower("venue").contains("room"), "live").otherwise("studio")
    return table(spark, d, "tracks").select("row_id", sinks.session_label(F.col("recording_date"), F.col("tune"), F.col("take"), kind).alias("label"))
