"""Queries over the catalogue tables, each with the SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacquer.functions import dates, rules, text
from lacquer.operators import groups, joins, ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------- scans and projections


@query("""
SELECT CASE WHEN kind = 'audio' AND error IS NULL THEN 'audio'
            WHEN kind = 'audio' AND lower(path) LIKE '%.iso.wv' THEN 'container'
            WHEN kind = 'audio' THEN 'failed'
            WHEN kind = 'container' THEN 'container' ELSE 'sidecar' END AS route,
       count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
FROM raw_probe WHERE NOT starts_with(string_split(path, '/')[-1], '._') GROUP BY 1
""")
def probe_routes(spark, d):
    from lacquer.sources.probe import routed

    return routed(table(spark, d, "raw_probe")).groupBy("route").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""
WITH t AS (SELECT probe_id, list_transform(map_entries(tags), lambda e: {'k': lower(trim(e.key)), 'v': nullif(trim(regexp_replace(e.value, '[\\s\\p{Z}]+', ' ', 'g')), '')}) AS e FROM raw_probe),
g AS (SELECT probe_id, list_filter(e, lambda x: x.k = 'title')[-1].v AS title, list_filter(e, lambda x: x.k = 'album_artist')[-1].v AS aa, list_filter(e, lambda x: x.k = 'artist')[-1].v AS a FROM t)
SELECT probe_id, title, coalesce(aa, a) AS artist FROM g
""")
def tag_lookup(spark, d):
    p = table(spark, d, "raw_probe")
    return p.select("probe_id", text.tag_get(F.col("tags"), "title").alias("title"), text.tag_get(F.col("tags"), "album_artist", "artist").alias("artist"))


@query("SELECT release_id, 'rel_' || substr(sha1(path), 1, 12) AS key FROM releases WHERE path IS NOT NULL")
def surrogate_key(spark, d):
    return table(spark, d, "releases").where("path is not null").select("release_id", text.surrogate_key("rel", F.col("path")).alias("key"))


@query("""
SELECT row_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '[^/]*$') AS leaf, string_split(path, '/')[1] AS top,
       lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) AS ext FROM tracks WHERE path IS NOT NULL
""")
def path_parts(spark, d):
    p = F.col("path")
    return table(spark, d, "tracks").where("path is not null").select("row_id", text.parent(p).alias("folder"), text.leaf(p).alias("leaf"), text.top(p).alias("top"), text.extension(p).alias("ext"))


@query("""
WITH p AS (SELECT probe_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM raw_probe WHERE path IS NOT NULL),
q AS (SELECT probe_id, dir, regexp_extract(dir, '[^/]*$') AS l, regexp_matches(regexp_extract(dir, '[^/]*$'), '(?i)^(cd|disc|disk)\\s*\\.?\\s*\\d+\\b') AND contains(dir, '/') AS disc FROM p)
SELECT CASE WHEN disc THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE dir END AS folder,
       max(CASE WHEN disc THEN CAST(regexp_extract(l, '(?i)^(?:cd|disc|disk)\\s*\\.?\\s*(\\d+)', 1) AS INTEGER) END) AS discs, count(*) AS files
FROM q GROUP BY 1
""")
def disc_rollup(spark, d):
    p = table(spark, d, "raw_probe").where("path is not null")
    return p.groupBy(text.release_folder(F.col("path")).alias("folder")).agg(F.max(text.disc_folder_number(F.col("path"))).alias("discs"), F.count("*").alias("files"))


@query("""
SELECT probe_id, TRY_CAST(nullif(regexp_extract(bits_per_raw_sample, '^[0-9]+$'), '') AS BIGINT) AS bits, TRY_CAST(nullif(regexp_extract(sample_rate, '^[0-9]+$'), '') AS BIGINT) AS rate,
       TRY_CAST(nullif(regexp_extract(list_filter(map_entries(tags), lambda e: lower(trim(e.key)) = 'track')[-1].value, '^\\s*(\\d+)', 1), '') AS BIGINT) AS track
FROM raw_probe WHERE kind = 'audio'
""")
def safe_numbers(spark, d):
    p = table(spark, d, "raw_probe").where("kind = 'audio'")
    return p.select("probe_id", text.digits_only(F.col("bits_per_raw_sample")).alias("bits"), text.digits_only(F.col("sample_rate")).alias("rate"), text.leading_int(text.tag_get(F.col("tags"), "track")).alias("track"))


@query("""
SELECT release_id, count(*) AS tracks, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(bit_depth) AS bit_depth, max(sample_rate) AS sample_rate,
       bool_or(bit_depth > 16 OR sample_rate > 48000) AS any_hi_res, list_aggregate(list_sort(list_distinct(list(codec))), 'string_agg', '; ') AS codecs
FROM tracks WHERE release_id IS NOT NULL GROUP BY release_id
""")
def release_rollup(spark, d):
    t = table(spark, d, "tracks").where("release_id is not null")
    return t.groupBy("release_id").agg(
        F.count("*").alias("tracks"),
        F.sum("size_bytes").alias("bytes"),
        F.max("bit_depth").alias("bit_depth"),
        F.max("sample_rate").alias("sample_rate"),
        F.bool_or((F.col("bit_depth") > 16) | (F.col("sample_rate") > 48000)).alias("any_hi_res"),
        F.nullif(F.array_join(groups.sorted_set("codec"), "; "), F.lit("")).alias("codecs"),
    )


@query("""
WITH c AS (SELECT release_id, artist_tag, count(*) AS n, min(row_id) AS p FROM tracks WHERE release_id IS NOT NULL AND trim(artist_tag) <> '' GROUP BY 1, 2)
SELECT release_id, arg_max(artist_tag, {'n': n, 'p': -p}) AS artist FROM c GROUP BY 1
""")
def majority_artist(spark, d):
    return groups.majority(table(spark, d, "tracks").where("release_id is not null"), ["release_id"], "artist_tag", "row_id", "artist")


@query("""
WITH f AS (SELECT tune AS value, min(row_id) AS p FROM tracks WHERE trim(tune) <> '' GROUP BY 1)
SELECT value, row_number() OVER (ORDER BY p, value) - 1 AS code FROM f
""")
def dictionary_encode(spark, d):
    return ordered.dictionary_codes(table(spark, d, "tracks"), "tune", "row_id")


@query("""
SELECT t.row_id, substr(coalesce(nullif(t.title, ''), t.filename), 1, 120) AS flat_title,
  CASE WHEN r.genre_primary = 'Classical' AND trim(t.composer) <> '' THEN coalesce(nullif(trim(split_part(t.composer, ',', 1)), ''), 'Various') ELSE coalesce(nullif(r.album_artist, ''), 'Unknown Artist') END AS flat_albumartist,
  substr(coalesce(nullif(r.title, ''), r.folder_name) || CASE WHEN r.release_year IS NOT NULL AND NOT contains(coalesce(nullif(r.title, ''), r.folder_name), '(' || r.release_year || ')') THEN ' (' || r.release_year || ')' ELSE '' END, 1, 120) AS flat_album,
  coalesce(nullif(r.genre_primary, ''), 'Unknown') AS flat_genre
FROM tracks t JOIN releases r USING (release_id)
""")
def flat_projection(spark, d):
    from lacquer.sinks.tables import flat_tags

    j = table(spark, d, "tracks").join(table(spark, d, "releases").select("release_id", F.col("title").alias("album"), "folder_name", "album_artist", "genre_primary", "release_year"), "release_id")
    return flat_tags(j).select("row_id", "flat_title", "flat_albumartist", "flat_album", "flat_genre")


@query("""
SELECT release_id, regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 80), '[ .]+$', ''), ''), 'untitled') AS file_name
FROM releases WHERE title IS NOT NULL
""")
def safe_names(spark, d):
    r = table(spark, d, "releases").where("title is not null")
    return r.select("release_id", text.slug(F.col("title")).alias("slug"), text.safe_name(F.col("title")).alias("file_name"))


@query("""
WITH w AS (SELECT release_id, disc_number, track_number, row_id, title FROM tracks)
SELECT row_id, 'trk ' || lpad(CAST(coalesce(track_number, 0) AS VARCHAR), 2, '0') AS label,
  CASE WHEN duration_seconds IS NULL THEN NULL ELSE CAST(CAST(floor(duration_seconds + 0.5) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(duration_seconds + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS clock
FROM tracks
""")
def track_labels(spark, d):
    t = table(spark, d, "tracks")
    return t.select("row_id", F.concat(F.lit("trk "), F.lpad(F.coalesce("track_number", F.lit(0)).cast("string"), 2, "0")).alias("label"), F.when(F.col("duration_seconds").isNotNull(), text.clock(F.col("duration_seconds"))).alias("clock"))


# -------------------------------------------------------------------------- filters


@query("""
WITH x AS (SELECT row_id, recording_date, CASE length(recording_date) WHEN 4 THEN recording_date || '-06-15' WHEN 7 THEN recording_date || '-15' ELSE recording_date END AS d FROM tracks)
SELECT row_id, coalesce(d BETWEEN '1930-01-01' AND '1979-12-31', false) AS plausible FROM x
""")
def lifetime_clamp(spark, d):
    return table(spark, d, "tracks").select("row_id", dates.plausible(F.col("recording_date"), "1930-01-01", "1979-12-31").alias("plausible"))


@query("""
SELECT release_id, coalesce(regexp_matches(title, '(?i)\\b(best of|greatest|anthology|collection|compilation|retrospective|ken burns|the art of|gentle side|mastery of|essential|very best|gold|priceless jazz|jazz hour|masters?|legacy|portrait of|introducing the|definitive|ultimate|classics|sampler)\\b'), false) AS compilation FROM releases
""")
def compilations(spark, d):
    return table(spark, d, "releases").select("release_id", rules.is_compilation(F.col("title")).alias("compilation"))


@query("""
SELECT release_id, count(*) AS n FROM tracks WHERE release_id IS NOT NULL AND codec IN ('flac', 'alac') AND date_precision = 'day'
  AND contains(lower(concat_ws(' ', recording_date, title, venue, path)), 'live') GROUP BY 1
""")
def facet_filter(spark, d):
    t = table(spark, d, "tracks").where("release_id is not null")
    chosen = groups.passes(F.col("codec"), ["flac", "alac"], False) & groups.passes(F.col("date_precision"), ["day"], False)
    found = F.lower(F.concat_ws(" ", "recording_date", "title", "venue", "path")).contains("live")
    return t.where(chosen & found).groupBy("release_id").agg(F.count("*").alias("n"))


@query("""
SELECT composer, count(*) AS tracks, count(DISTINCT release_id) AS recordings FROM tracks WHERE trim(composer) <> '' GROUP BY 1 HAVING count(*) >= 4 AND count(DISTINCT release_id) >= 2
""")
def min_group_filter(spark, d):
    t = table(spark, d, "tracks").where(F.trim("composer") != "")
    return t.groupBy("composer").agg(F.count("*").alias("tracks"), F.count_distinct("release_id").alias("recordings")).where("tracks >= 4 and recordings >= 2")


@query("""
SELECT r.release_id, count(*) AS candidates, min(e.ext_release_id) AS first_candidate FROM releases r JOIN ext_releases e ON lower(r.title) = lower(e.title)
WHERE r.track_count >= 2 AND (e.track_count IS NULL OR (e.track_count >= 0.7 * r.track_count AND e.track_count <= greatest(4 * r.track_count, r.track_count + 30))) GROUP BY 1
""")
def track_window(spark, d):
    """External releases of a release's title with a plausible track count: titles meet by their counts, not copy by copy."""
    from lacquer.operators.reconcile import plausible_count

    r = table(spark, d, "releases").where("track_count >= 2").select("release_id", F.lower("title").alias("t"), F.col("track_count").alias("n"))
    e = table(spark, d, "ext_releases").groupBy(F.lower("title").alias("t"), F.col("track_count").alias("m")).agg(F.count("*").alias("k"), F.min("ext_release_id").alias("e"))
    met = r.select("t", "n").distinct().join(e, "t").where(plausible_count(F.col("n"), F.col("m"))).groupBy("t", "n").agg(F.sum("k").alias("candidates"), F.min("e").alias("first_candidate"))
    return r.join(met, ["t", "n"]).select("release_id", "candidates", "first_candidate")


# ---------------------------------------------------------------------------- joins


@query("""
WITH rel AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM raw_probe WHERE kind = 'audio' AND contains(path, '/')),
side AS (SELECT probe_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM raw_probe WHERE kind = 'sidecar' AND contains(path, '/'))
SELECT folder, count(*) AS sidecars FROM rel JOIN side ON dir = folder OR starts_with(dir, folder || '/') GROUP BY 1
""")
def sidecars_below(spark, d):
    p = table(spark, d, "raw_probe").where(F.col("path").contains("/")).select("kind", text.parent(F.col("path")).alias("dir"))
    rel = p.where("kind = 'audio'").select(F.col("dir").alias("folder")).distinct()
    return joins.prefix_join(p.where("kind = 'sidecar'"), "dir", rel, "folder").groupBy("folder").agg(F.count("*").alias("sidecars"))


_ROLLED = """
WITH p AS (SELECT kind, size, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM raw_probe WHERE path IS NOT NULL),
q AS (SELECT kind, size, CASE WHEN contains(dir, '/') AND regexp_matches(regexp_extract(dir, '[^/]*$'), '(?i)^(cd|disc|disk)\\s*\\.?\\s*\\d+\\b') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE dir END AS folder FROM p)
"""


@query(_ROLLED + """, a AS (SELECT folder, count(*) AS tracks FROM q WHERE kind = 'audio' GROUP BY 1),
c AS (SELECT folder, count(*) AS containers, CAST(sum(size) AS BIGINT) AS container_bytes FROM q WHERE kind = 'container' GROUP BY 1)
SELECT folder, coalesce(tracks, 0) AS tracks, coalesce(containers, 0) AS containers, container_bytes FROM a FULL OUTER JOIN c USING (folder)
""")
def containers_attached(spark, d):
    p = table(spark, d, "raw_probe").where("path is not null").withColumn("folder", text.release_folder(F.col("path")))
    a = p.where("kind = 'audio'").groupBy("folder").agg(F.count("*").alias("tracks"))
    c = p.where("kind = 'container'").groupBy("folder").agg(F.count("*").alias("containers"), F.sum("size").alias("container_bytes"))
    return a.join(c, "folder", "full_outer").select("folder", F.coalesce("tracks", F.lit(0)).alias("tracks"), F.coalesce("containers", F.lit(0)).alias("containers"), "container_bytes")


#: Eras of recording technique: literal rows for the as-of join.
ERAS = (("1900", "acoustic"), ("1925-06-01", "electrical"), ("1948-06-21", "long playing"), ("1958-01-01", "stereo"), ("1979-06-01", "digital"))


@query("""
WITH era(start, era) AS (VALUES ('1900', 'acoustic'), ('1925-06-01', 'electrical'), ('1948-06-21', 'long playing'), ('1958-01-01', 'stereo'), ('1979-06-01', 'digital'))
SELECT t.row_id, e.era FROM tracks t ASOF LEFT JOIN era e ON t.recording_date >= e.start
""")
def era_asof(spark, d):
    eras = spark.createDataFrame(ERAS, "start string, era string")
    return joins.asof_join(table(spark, d, "tracks").select("row_id", "recording_date"), "recording_date", eras, "start").select("row_id", "era")


@query("""
WITH t AS (SELECT row_id, artist_tag AS name, CASE length(recording_date) WHEN 4 THEN recording_date || '-06-15' WHEN 7 THEN recording_date || '-15' ELSE recording_date END AS d FROM tracks WHERE trim(artist_tag) <> ''),
l AS (SELECT *, coalesce(nullif(trim(to_date), ''), '9999-12-31') AS til FROM lineups WHERE trim(from_date) <> '')
SELECT t.row_id, arg_min(l.lineup_id, l.ord) AS lineup_id FROM t LEFT JOIN l ON t.name = l.name AND t.d >= l.from_date AND t.d < l.til GROUP BY 1
""")
def lineup_interval(spark, d):
    t = table(spark, d, "tracks").where(F.trim("artist_tag") != "").select("row_id", F.col("artist_tag").alias("name"), "recording_date")
    til = F.coalesce(text.blank_to_null(F.trim("to_date")), F.lit("9999-12-31"))
    lu = table(spark, d, "lineups").where(F.trim("from_date") != "").select("name", "lineup_id", "ord", "from_date", til.alias("til"))
    return joins.interval_join(t, "recording_date", lu, "from_date", "til", "ord", ["name"]).select("row_id", "lineup_id")


@query("""
WITH e AS (SELECT band_id, lineup_id, from_date, ord FROM lineups WHERE length(from_date) = 10),
q AS (SELECT lineup_id AS asked, band_id, to_date AS at FROM lineups WHERE length(to_date) = 10)
SELECT q.asked, max(e.from_date) AS last_start FROM q LEFT JOIN e ON q.band_id = e.band_id AND e.from_date <= q.at GROUP BY 1
""")
def asof_by_band(spark, d):
    lu = table(spark, d, "lineups")
    e = lu.where("length(from_date) = 10").select("band_id", F.col("from_date").alias("start"), F.col("from_date").alias("last_start"))
    q = lu.where("length(to_date) = 10").select("band_id", F.col("lineup_id").alias("asked"), F.col("to_date").alias("at"))
    return joins.asof_join(q, "at", e, "start", ["band_id"]).select("asked", "last_start")


def _venues(spark, d) -> DataFrame:
    t = table(spark, d, "tracks").where(F.trim("venue") != "")
    return t.groupBy(F.col("venue").alias("term")).agg(F.min("row_id").alias("ord"), F.min("city").alias("home_city"))


@query("""
WITH v AS (SELECT venue AS term, min(row_id) AS ord, lower(strip_accents(venue)) AS k FROM tracks WHERE trim(venue) <> '' GROUP BY 1),
r AS (SELECT release_id, ' ' || trim(regexp_replace(lower(strip_accents(folder_name)), '[^a-z0-9'']+', ' ', 'g')) || ' ' AS f FROM releases WHERE folder_name IS NOT NULL),
h AS (SELECT release_id, term, ord, instr(f, ' ' || trim(regexp_replace(k, '[^a-z0-9'']+', ' ', 'g')) || ' ') AS p FROM r JOIN v ON contains(f, ' ' || trim(regexp_replace(k, '[^a-z0-9'']+', ' ', 'g')) || ' '))
SELECT release_id, arg_min(term, {'p': p, 'l': -length(term), 'o': ord}) AS venue FROM h GROUP BY 1
""")
def venue_in_folder(spark, d):
    best = joins.dictionary_best(table(spark, d, "releases").where("folder_name is not null"), "release_id", "folder_name", _venues(spark, d), "term", "ord")
    return best.select("release_id", F.col("term").alias("venue"))


@query("""
WITH v AS (SELECT DISTINCT canon, trim(regexp_replace(regexp_replace(lower(strip_accents(trim(split_part(canon, ',', 2)) || ' ' || trim(split_part(canon, ',', 1)))), '[_·‐-―⁃]+', ' ', 'g'), '[^\\p{L}\\p{N}'']+', ' ', 'g')) AS k FROM ref_values WHERE kind = 'composer'),
t AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[_·‐-―⁃]+', ' ', 'g'), '[^\\p{L}\\p{N}'']+', ' ', 'g')) || ' ' AS f FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, canon, instr(f, ' ' || k || ' ') AS p FROM t JOIN v ON contains(f, ' ' || k || ' '))
SELECT doc_id, string_agg(canon, '; ' ORDER BY p) AS names FROM h GROUP BY 1
""")
def musicians_in_documents(spark, d):
    """Listed composers named in the texts of all documents, in order of appearance."""
    ref = table(spark, d, "ref_values").where("kind = 'composer'")
    name = F.concat(F.trim(F.substring_index("canon", ",", -1)), F.lit(" "), F.trim(F.substring_index("canon", ",", 1)))
    vocab = ref.select(name.alias("term"), "canon")
    hits = joins.dictionary_all(table(spark, d, "documents").where("text is not null"), "doc_id", "text", vocab, "term", "canon")
    return hits.select("doc_id", F.array_join("names", "; ").alias("names"))


@query("""
WITH k AS (SELECT DISTINCT lower(trim(split_part(canon, ',', 1))) AS key FROM ref_values WHERE kind = 'composer'),
f AS (SELECT DISTINCT lower(substr(trim(split_part(composer, ',', 1)), 1, 6)) AS fragment FROM tracks WHERE contains(composer, ','))
SELECT fragment, min(key) AS key FROM f JOIN k ON starts_with(key, fragment) WHERE length(fragment) >= 5 GROUP BY 1 HAVING count(*) = 1
""")
def unique_prefix(spark, d):
    keys = table(spark, d, "ref_values").where("kind = 'composer'").select(F.lower(F.trim(F.substring_index("canon", ",", 1))).alias("k"))
    frags = table(spark, d, "tracks").where(F.col("composer").contains(",")).select(F.lower(F.substring(F.trim(F.substring_index("composer", ",", 1)), 1, 6)).alias("f"))
    return joins.unique_prefix(frags, "f", keys, "k")


def _tunes(spark, d) -> DataFrame:
    return table(spark, d, "tracks").where("release_id is not null").select("release_id", F.trim("tune").alias("tune")).where("tune <> ''")


def _ext_tunes(spark, d) -> DataFrame:
    return table(spark, d, "ext_tracks").select("ext_release_id", F.trim("title").alias("tune")).where("tune <> ''")


_OVERLAP_SQL = """
WITH a AS (SELECT DISTINCT release_id, trim(tune) AS i FROM tracks WHERE release_id IS NOT NULL AND trim(tune) <> ''),
b AS (SELECT DISTINCT ext_release_id, trim(title) AS i FROM ext_tracks WHERE trim(title) <> '' AND ext_release_id IS NOT NULL),
na AS (SELECT release_id, count(*) AS left_size FROM a GROUP BY 1), nb AS (SELECT ext_release_id, count(*) AS right_size FROM b GROUP BY 1),
s AS (SELECT release_id, ext_release_id, count(*) AS shared FROM a JOIN b USING (i) GROUP BY 1, 2),
o AS (SELECT s.*, left_size, right_size FROM s JOIN na USING (release_id) JOIN nb USING (ext_release_id) WHERE shared >= 3 AND shared >= 0.5 * left_size)
"""


@query(_OVERLAP_SQL + "SELECT release_id, ext_release_id, shared, left_size, right_size, shared < 0.4 * right_size AS is_anthology FROM o")
def overlap_two_way(spark, d):
    o = joins.set_overlap(_tunes(spark, d), "release_id", _ext_tunes(spark, d).where("ext_release_id is not null"), "ext_release_id", "tune", 3, 0.5)
    return o.select("release_id", "ext_release_id", "shared", "left_size", "right_size", (F.col("shared") < 0.4 * F.col("right_size")).alias("is_anthology"))


@query(_OVERLAP_SQL + """, y AS (SELECT o.*, r.release_year IS NOT DISTINCT FROM e.release_year AND r.release_year IS NOT NULL AS same FROM o JOIN releases r USING (release_id) JOIN ext_releases e USING (ext_release_id))
SELECT release_id, arg_max(ext_release_id, {'s': shared * 1.0 / left_size + CASE WHEN same THEN 0.5 ELSE 0.0 END, 'k': ext_release_id}) AS best FROM y GROUP BY 1""")
def overlap_best(spark, d):
    """Releases of the same tunes and year have the same counterpart, so one of each meets one of each."""
    a, b = _tunes(spark, d), _ext_tunes(spark, d).where("ext_release_id is not null")
    ours = joins.equal_sets(a, "release_id", "tune", table(spark, d, "releases").select("release_id", F.col("release_year").alias("y1")))
    theirs = joins.equal_sets(b, "ext_release_id", "tune", table(spark, d, "ext_releases").select("ext_release_id", F.col("release_year").alias("y2")))
    left, right = ours.select(F.col("rep").alias("release_id"), "y1").distinct(), theirs.select(F.col("rep").alias("ext_release_id"), "y2").distinct()
    o = joins.set_overlap(a.join(left, "release_id", "left_semi"), "release_id", b.join(right, "ext_release_id", "left_semi"), "ext_release_id", "tune", 3, 0.5)
    score = F.struct((F.col("of_left") + F.when(F.col("y1") == F.col("y2"), 0.5).otherwise(0.0)).alias("s"), F.col("ext_release_id"))
    best = o.join(left, "release_id").join(right, "ext_release_id").groupBy(F.col("release_id").alias("rep"), F.col("y1").alias("_y")).agg(F.max(score).alias("_b"))
    every = ours.join(best, (ours["rep"] == best["rep"]) & ours["y1"].eqNullSafe(best["_y"]))
    return every.groupBy("release_id").agg(F.max("_b").alias("_b")).select("release_id", F.col("_b.ext_release_id").alias("best"))


@query("""
WITH a AS (SELECT release_id, row_number() OVER (PARTITION BY release_id ORDER BY disc_number, track_number, row_id) AS pos, title, count(*) OVER (PARTITION BY release_id) AS n FROM tracks WHERE release_id IS NOT NULL),
m AS (SELECT release_id, min(ext_release_id) AS ext_release_id FROM releases r JOIN ext_releases e ON lower(r.title) = lower(e.title) GROUP BY 1),
b AS (SELECT m.release_id, row_number() OVER (PARTITION BY m.release_id ORDER BY disc_number, track_number, title, length_ms) AS pos, x.title AS ext_title, count(*) OVER (PARTITION BY m.release_id) AS n FROM m JOIN ext_tracks x USING (ext_release_id))
SELECT release_id, pos, title, ext_title FROM a JOIN b USING (release_id, pos, n)
""")
def zip_equal_length(spark, d):
    t = table(spark, d, "tracks").where("release_id is not null")
    t = t.select("release_id", F.isnull("disc_number").alias("no_disc"), "disc_number", F.isnull("track_number").alias("no_track"), "track_number", "row_id", "title")
    a = ordered.spread_number(t, ["release_id"], ["no_disc", "disc_number", "no_track", "track_number", "row_id"], "pos").select("release_id", "pos", "title")
    r = table(spark, d, "releases").select("release_id", F.lower("title").alias("k"))
    e = table(spark, d, "ext_releases").select("ext_release_id", F.lower("title").alias("k"))
    m = r.join(e, "k").groupBy("release_id").agg(F.min("ext_release_id").alias("ext_release_id"))
    by = [F.col(c).asc_nulls_last() for c in ("disc_number", "track_number", "title", "length_ms")]
    b = m.join(table(spark, d, "ext_tracks"), "ext_release_id").select("release_id", F.row_number().over(Window.partitionBy("release_id").orderBy(*by)).alias("pos"), F.col("title").alias("ext_title"))
    return joins.zip_equal(a, b, "release_id", "pos").select("release_id", F.col("pos").cast("bigint").alias("pos"), "title", "ext_title")


@query("""
WITH s AS (SELECT DISTINCT lower(tune) AS k, venue, recording_date AS date FROM tracks WHERE trim(tune) <> '' AND trim(venue) <> ''),
q AS (SELECT row_id, lower(tune) AS k, recording_date AS own FROM tracks WHERE trim(tune) <> '' AND venue IS NULL),
p AS (SELECT DISTINCT q.row_id, s.venue, s.date, q.own FROM q JOIN s USING (k))
SELECT row_id, count(DISTINCT venue) AS candidates,
  CASE WHEN count(DISTINCT venue) = 1 THEN 'unique' WHEN count(*) FILTER (date = own) = 1 THEN 'corroborated' ELSE 'ambiguous' END AS state FROM p GROUP BY 1
""")
def inverted_candidates(spark, d):
    t = table(spark, d, "tracks").where(F.trim("tune") != "").withColumn("k", F.lower("tune"))
    s = t.where(F.trim("venue") != "")
    return joins.candidate_state(t.where("venue is null"), "row_id", "k", "recording_date", s, "venue", "recording_date").select("row_id", "candidates", "state")


@query("""
SELECT 'releases without tracks' AS what, count(*) AS n FROM releases r WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.release_id = r.release_id)
UNION ALL SELECT 'releases with tracks', count(*) FROM releases r WHERE EXISTS (SELECT 1 FROM tracks t WHERE t.release_id = r.release_id)
UNION ALL SELECT 'orphan tracks', count(*) FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM releases r WHERE r.release_id = t.release_id)
""")
def anti_semi(spark, d):
    r, t = table(spark, d, "releases").select("release_id"), table(spark, d, "tracks").select("release_id")
    arms = [("releases without tracks", r.join(t, "release_id", "left_anti")), ("releases with tracks", r.join(t, "release_id", "left_semi")), ("orphan tracks", t.join(r, "release_id", "left_anti"))]
    out = None
    for what, df in arms:
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT d.doc_id, coalesce(l.band, CASE WHEN d.n_chars < 400 THEN 'easy' WHEN d.n_chars < 1000 THEN 'middle' ELSE 'hard' END) AS band
FROM documents d LEFT JOIN (SELECT doc_id, min(band) AS band FROM reading_labels GROUP BY 1) l USING (doc_id)
""")
def override_merge(spark, d):
    n = F.col("n_chars")
    base = table(spark, d, "documents").select("doc_id", F.when(n < 400, "easy").when(n < 1000, "middle").otherwise("hard").alias("band"))
    over = table(spark, d, "reading_labels").groupBy("doc_id").agg(F.min("band").alias("band")).withColumn("action", F.lit("accept"))
    return joins.override(base, over, "doc_id", ["band"])


@query("""
WITH RECURSIVE m AS (SELECT r.release_id, min(e.ext_release_id) AS ext_release_id FROM releases r JOIN ext_releases e ON lower(r.title) = lower(e.title) GROUP BY 1),
p AS (SELECT m.release_id, m.ext_release_id, (SELECT list(duration_seconds ORDER BY duration_seconds) FROM tracks t WHERE t.release_id = m.release_id AND duration_seconds IS NOT NULL) AS ours,
             (SELECT list(length_ms / 1000.0 ORDER BY length_ms) FROM ext_tracks x WHERE x.ext_release_id = m.ext_release_id AND length_ms IS NOT NULL) AS theirs FROM m),
s AS (SELECT release_id, ext_release_id, ours, theirs AS rest, len(ours) AS size, len(theirs) AS other, 1 AS i, 0 AS n FROM p WHERE ours IS NOT NULL AND theirs IS NOT NULL
      UNION ALL
      SELECT release_id, ext_release_id, ours, CASE WHEN near <= 5.0 THEN rest[:spot - 1] || rest[spot + 1:] ELSE rest END, size, other, i + 1, n + CASE WHEN near <= 5.0 THEN 1 ELSE 0 END
      FROM (SELECT *, list_min(list_transform(rest, lambda y: abs(y - ours[i]))) AS near, list_position(list_transform(rest, lambda y: abs(y - ours[i])), list_min(list_transform(rest, lambda y: abs(y - ours[i])))) AS spot FROM s WHERE i <= size))
SELECT release_id, ext_release_id, CAST(n AS INTEGER) AS matched, CAST(size AS BIGINT) AS ours, CAST(other AS BIGINT) AS theirs FROM s WHERE i = size + 1
""")
def greedy_match(spark, d):
    """Track lengths of each release matched one to one with those of the first external release of its title."""
    r = table(spark, d, "releases").select("release_id", F.lower("title").alias("k"))
    e = table(spark, d, "ext_releases").groupBy(F.lower("title").alias("k")).agg(F.min("ext_release_id").alias("ext_release_id"))
    pairs = r.join(e, "k").groupBy("release_id").agg(F.min("ext_release_id").alias("ext_release_id"))
    ours = table(spark, d, "tracks").where("duration_seconds is not null").select("release_id", "duration_seconds")
    theirs = table(spark, d, "ext_tracks").where("length_ms is not null").select("ext_release_id", (F.col("length_ms") / 1000).alias("length"))
    near = joins.near_values(ours, "release_id", "duration_seconds", pairs, theirs, "ext_release_id", "length", 5.0)
    n, m = ours.groupBy("release_id").agg(F.count("*").alias("ours")), theirs.groupBy("ext_release_id").agg(F.count("*").alias("theirs"), F.array_sort(F.collect_list("length")).alias("_w"))
    both = pairs.join(n, "release_id").join(m, "ext_release_id").join(near, ["release_id", "ext_release_id"], "left")
    matched = joins.greedy_match(F.coalesce("_v", F.expr("cast(array() as array<double>)")), F.col("_w"), 5.0)
    return both.select("release_id", "ext_release_id", matched.alias("matched"), "ours", "theirs")
