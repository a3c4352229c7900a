"""More queries over the catalogue tables: groups, ordered analytics, reconciliation, audit, sinks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacquer.functions import dates, rules, text
from lacquer.operators import audit, groups, joins, ordered
from lacquer.plans.music import query, table
from lacquer.sinks import tables as sinks

# --------------------------------------------------------------------- aggregations


@query("""
SELECT recording_date AS date, coalesce(venue, city, '') AS place, arg_min({'v': venue, 'c': city, 'a': artist_tag}, row_id).a AS artist, count(*) AS tracks, count(DISTINCT release_id) AS releases
FROM tracks WHERE date_precision IN ('day', 'month') GROUP BY 1, 2
""")
def session_groups(spark, d):
    t = table(spark, d, "tracks").where(F.col("date_precision").isin("day", "month"))
    return t.groupBy(F.col("recording_date").alias("date"), F.coalesce("venue", "city", F.lit("")).alias("place")).agg(
        F.min_by(F.struct("artist_tag"), "row_id")["artist_tag"].alias("artist"), F.count("*").alias("tracks"), F.count_distinct("release_id").alias("releases")
    )


@query("""
WITH t AS (SELECT regexp_replace(lower(strip_accents(tune)), '[^\\p{L}\\p{N}]+', '', 'g') AS key, tune, row_id, recording_date, venue FROM tracks WHERE trim(tune) <> ''),
c AS (SELECT key, tune, count(*) AS n, min(row_id) AS p FROM t GROUP BY 1, 2),
m AS (SELECT key, arg_max(tune, {'n': n, 'p': -p}) AS title FROM c GROUP BY 1)
SELECT key, title, count(*) AS performances, count(*) FILTER (venue IS NOT NULL) AS at_venues, min(recording_date) AS first_recorded, max(recording_date) AS last_recorded
FROM t JOIN m USING (key) GROUP BY 1, 2
""")
def tune_groups(spark, d):
    t = table(spark, d, "tracks").where(F.trim("tune") != "").withColumn("key", F.regexp_replace(text.fold(F.col("tune")), r"[^\p{L}\p{N}]+", ""))
    title = groups.majority(t, ["key"], "tune", "row_id", "title")
    g = t.groupBy("key").agg(F.count("*").alias("performances"), F.count_if(F.col("venue").isNotNull()).alias("at_venues"), F.min("recording_date").alias("first_recorded"), F.max("recording_date").alias("last_recorded"))
    return g.join(title, "key")


@query("""
SELECT lower(venue) AS key, arg_max(venue, {'l': length(venue), 'k': lower(venue), 'v': venue}) AS label, count(*) AS versions, count(*) FILTER (coalesce(title, '') ILIKE '%live%') AS special,
  min(recording_date) AS first_date, max(recording_date) AS last_date FROM tracks WHERE trim(venue) <> '' GROUP BY 1
""")
def grouped_venues(spark, d):
    return groups.grouped_table(table(spark, d, "tracks"), "venue", "recording_date", F.lower(F.coalesce("title", F.lit(""))).contains("live"))


@query("""
WITH w AS (SELECT coalesce(composer, '?') AS composer, regexp_replace(lower(coalesce(tune, '')), '[^a-z0-9]+', '', 'g') AS key, coalesce(title, '') AS title,
             nullif(regexp_extract(coalesce(title, ''), 'No\\. ?(\\d+)', 1), '') AS mark, row_id FROM tracks),
works AS (SELECT composer, key, title, mark, min(row_id) AS work, count(*) AS n FROM w GROUP BY 1, 2, 3, 4),
b AS (SELECT composer, key, count(DISTINCT mark) AS marks, arg_min(work, {'a': mark IS NULL, 'n': -n, 'w': work}) AS s FROM works GROUP BY 1, 2)
SELECT work, CASE WHEN marks <= 1 AND key <> '' THEN s ELSE work END AS survivor FROM works JOIN b USING (composer, key)
""")
def work_merge(spark, d):
    t = table(spark, d, "tracks")
    title = F.coalesce("title", F.lit(""))
    mark = F.regexp_extract(title, r"No\. ?(\d+)", 1)
    key = F.regexp_replace(F.lower(F.coalesce("tune", F.lit(""))), "[^a-z0-9]+", "")
    works = t.groupBy(F.coalesce("composer", F.lit("?")).alias("composer"), key.alias("key"), title.alias("title"), F.when(mark != "", mark).alias("mark")).agg(F.min("row_id").alias("work"), F.count("*").alias("n"))
    return groups.merge_works(works, ["composer", "key"], "work", "mark", "n")


@query("""
WITH d AS (SELECT DISTINCT release_id, track_id, lower(tune) AS t FROM tracks WHERE release_id IS NOT NULL),
c AS (SELECT release_id, t, count(*) AS n FROM d GROUP BY 1, 2),
k AS (SELECT release_id, md5(string_agg(coalesce(t, '~') || '|' || n, ',' ORDER BY t, n)) AS h FROM c GROUP BY 1)
SELECT count(*) AS n, min(release_id) AS first_release, max(release_id) AS last_release FROM k GROUP BY h HAVING count(*) > 1
""")
def duplicate_contents(spark, d):
    """Releases with the same tunes, as often each; a file that was loaded twice counts once."""
    k = groups.multiset_key(_loaded_tunes(spark, d), "release_id", ["t"])
    g = k.groupBy(F.col("n").alias("rows"), "h1", "h2").agg(F.count("*").alias("n"), F.min("release_id").alias("first_release"), F.max("release_id").alias("last_release"))
    return g.where("n > 1").select("n", "first_release", "last_release")


@query("""
WITH b AS (SELECT release_id, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM tracks GROUP BY 1),
r AS (SELECT r.release_id, folder_name, title, b.bytes FROM releases r JOIN b USING (release_id)),
k AS (
  SELECT 0 AS prio, 'folder and size' AS kind, 'high' AS confidence, nullif(regexp_replace(lower(strip_accents(folder_name)), '[^a-z0-9]+', '', 'g'), '') || '|' || bytes AS key, release_id, bytes FROM r
  UNION ALL SELECT 1, 'title', 'low', nullif(substr(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '', 'g'), 1, 40), ''), release_id, bytes FROM r WHERE lower(title) NOT IN ('loose files', 'untitled session')),
g AS (SELECT prio, kind, confidence, key, list_sort(list(release_id)) AS members, CAST(sum(bytes) AS BIGINT) AS s, max(bytes) AS m FROM k WHERE key IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
d AS (SELECT arg_min({'kind': kind, 'confidence': confidence, 's': s, 'm': m}, prio) AS b, members FROM g GROUP BY members)
SELECT b.kind AS kind, b.confidence AS confidence, CAST(len(members) AS BIGINT) AS n, members[1] AS first_member, members[-1] AS last_member, b.s - b.m AS reclaimable FROM d
""")
def duplicate_clusters(spark, d):
    c = groups.clusters(*_duplicates(spark, d), "release_id", "bytes")
    return c.select("kind", "confidence", "n", "first_member", "last_member", "reclaimable")


def _loaded_tunes(spark, d):
    return table(spark, d, "tracks").where("release_id is not null").select("release_id", "track_id", F.lower("tune").alias("t")).distinct()


def _duplicates(spark, d):
    """Releases with their bytes, and the rules by which they are duplicates."""
    b = table(spark, d, "tracks").groupBy("release_id").agg(F.sum("size_bytes").alias("bytes"))
    r = table(spark, d, "releases").select("release_id", "folder_name", "title").join(b, "release_id")
    folder, title = text.letters_key(F.col("folder_name")), F.substring(text.letters_key(F.col("title")), 1, 40)
    by_rule = [
        ("folder and size", "high", F.when(folder != "", F.concat(folder, F.lit("|"), F.col("bytes").cast("string")))),
        ("title", "low", F.when(~F.lower("title").isin("loose files", "untitled session"), title)),
    ]
    return r, by_rule


@query()
def duplicate_cluster_members(spark, d):
    """One row per member of each of the duplicate clusters, with its size; kind and key name the cluster."""
    r, by_rule = _duplicates(spark, d)
    c = groups.clusters(r, by_rule, "release_id", "bytes").select("kind", "key", "n", "first_member", "last_member")
    return groups.cluster_members(r, by_rule, "release_id", "bytes").join(c, ["kind", "key"]).select("kind", "confidence", "key", "n", "first_member", "last_member", F.col("member").alias("release_id"), F.col("size").alias("bytes"))


@query()
def duplicate_content_members(spark, d):
    """One row per release whose contents another has too; its group is named by n and the first release."""
    k = groups.multiset_key(_loaded_tunes(spark, d), "release_id", ["t"]).withColumnRenamed("n", "rows")
    by = ["rows", "h1", "h2"]
    g = k.groupBy(*by).agg(F.count("*").alias("n"), F.min("release_id").alias("first_release"), F.max("release_id").alias("last_release")).where("n > 1")
    return k.join(g, by).select("n", "first_release", "last_release", "release_id")


@query("""
WITH f AS (
  SELECT 'codec' AS facet, coalesce(codec, 'Unknown') AS value FROM tracks UNION ALL SELECT 'precision', coalesce(date_precision, 'Unknown') FROM tracks
  UNION ALL SELECT 'decade', coalesce(CAST(TRY_CAST(substr(recording_date, 1, 4) AS INTEGER) // 10 * 10 AS VARCHAR) || 's', 'Unknown') FROM tracks UNION ALL SELECT 'city', coalesce(city, 'Unknown') FROM tracks)
SELECT facet, value, count(*) AS n FROM f GROUP BY 1, 2
""")
def facet_groups(spark, d):
    year = F.substring("recording_date", 1, 4).try_cast("int")
    return groups.facet_counts(table(spark, d, "tracks"), {"codec": F.col("codec"), "precision": F.col("date_precision"), "decade": groups.decades(year), "city": F.col("city")})


@query("""
SELECT substr(recording_date, 1, 4) AS year, recording_date AS date, count(*) AS n, grouping(substr(recording_date, 1, 4), recording_date) AS level
FROM tracks WHERE recording_date IS NOT NULL GROUP BY GROUPING SETS ((substr(recording_date, 1, 4), recording_date), (substr(recording_date, 1, 4)), ())
""")
def facet_rollup(spark, d):
    t = table(spark, d, "tracks").where("recording_date is not null").select(F.substring("recording_date", 1, 4).alias("year"), F.col("recording_date").alias("date"))
    return t.rollup("year", "date").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""
WITH b AS (SELECT codec, date_precision AS p, city, codec IN ('flac') AS oc, coalesce(date_precision IN ('day'), false) AS op FROM tracks)
SELECT 'codec' AS facet, codec AS value, count(*) AS n FROM b WHERE op AND codec IS NOT NULL GROUP BY codec
UNION ALL SELECT 'precision', p, count(*) FROM b WHERE coalesce(oc, false) AND p IS NOT NULL GROUP BY p
UNION ALL SELECT 'city', city, count(*) FROM b WHERE coalesce(oc, false) AND op AND city IS NOT NULL GROUP BY city
""")
def crossfilter_counts(spark, d):
    return groups.crossfilter(table(spark, d, "tracks"), {"codec": F.col("codec"), "precision": F.col("date_precision"), "city": F.col("city")}, {"codec": ["flac"], "precision": ["day"]})


@query("""
WITH t AS (SELECT coalesce(nullif(trim(recording_date), ''), 'undated') AS date, row_id, venue, artist_tag, tune FROM tracks),
h AS (SELECT date, count(*) AS n, arg_min({'v': venue, 'a': artist_tag}, row_id) AS f FROM t GROUP BY 1),
u AS (SELECT date, tune, min(row_id) AS p FROM t WHERE tune IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p) AS r FROM u)
SELECT h.date, any_value(n) AS n, any_value(f).v AS venue, any_value(f).a AS artist_tag, string_agg(tune, '; ' ORDER BY r) FILTER (r <= 7) AS titles FROM h LEFT JOIN k USING (date) GROUP BY h.date
""")
def timeline(spark, d):
    return groups.timeline(table(spark, d, "tracks"), "recording_date", "row_id", ["venue", "artist_tag"], "tune")


@query("SELECT count(*) AS tracks, count(DISTINCT nullif(trim(recording_date), '')) AS dates, count(DISTINCT release_id) AS albums FROM tracks")
def header_summary(spark, d):
    t = table(spark, d, "tracks")
    return t.agg(F.count("*").alias("tracks"), F.count_distinct(text.blank_to_null(F.col("recording_date"))).alias("dates"), F.count_distinct("release_id").alias("albums"))


@query("""
SELECT 'dated' AS "check", count(*) FILTER (recording_date IS NOT NULL) AS hits, count(*) AS rows, CAST(floor(100 * count(*) FILTER (recording_date IS NOT NULL) / greatest(count(*), 1)) AS BIGINT) AS percent FROM tracks
UNION ALL SELECT 'composer', count(*) FILTER (trim(composer) <> ''), count(*), CAST(floor(100 * count(*) FILTER (trim(composer) <> '') / greatest(count(*), 1)) AS BIGINT) FROM tracks
UNION ALL SELECT 'venue', count(*) FILTER (trim(venue) <> ''), count(*), CAST(floor(100 * count(*) FILTER (trim(venue) <> '') / greatest(count(*), 1)) AS BIGINT) FROM tracks
""")
def coverage(spark, d):
    return groups.coverage(table(spark, d, "tracks"), {"dated": F.col("recording_date").isNotNull(), "composer": F.trim("composer") != "", "venue": F.trim("venue") != ""})


@query("""
WITH e AS (SELECT lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) AS ext, count(*) AS n FROM raw_probe WHERE path IS NOT NULL GROUP BY 1)
SELECT ext, n, CAST(ceil(n / 750.0) AS BIGINT) AS minutes FROM e ORDER BY n DESC, ext LIMIT 5
""")
def extension_histogram(spark, d):
    e = table(spark, d, "raw_probe").where("path is not null").groupBy(text.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))
    return e.withColumn("minutes", F.ceil(F.col("n") / 750.0).cast("bigint")).orderBy(F.desc("n"), "ext").limit(5)


@query("SELECT error AS reason, count(*) AS n FROM raw_probe WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def failure_reasons(spark, d):
    return table(spark, d, "raw_probe").where("error is not null").groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)


@query("SELECT artist_tag AS name, count(*) AS n, arg_min(path, row_id) AS example FROM tracks WHERE trim(artist_tag) <> '' GROUP BY 1 HAVING count(*) >= 5")
def mined_names(spark, d):
    return groups.mine(table(spark, d, "tracks"), "artist_tag", "row_id", "path", 5)


@query("""
WITH s AS (SELECT lower(strip_accents(trim(split_part(composer, ',', 1)))) AS key, composer, row_id FROM tracks WHERE contains(composer, ','))
SELECT key, arg_max(composer, {'l': length(composer), 'p': -row_id}) AS value, count(*) AS n FROM s GROUP BY 1
""")
def longest_by_surname(spark, d):
    t = table(spark, d, "tracks").where(F.col("composer").contains(","))
    return groups.longest_by(t, text.fold(F.trim(F.substring_index("composer", ",", 1))), "composer", "row_id")


@query("SELECT tune, count(DISTINCT release_id) AS releases FROM tracks WHERE trim(tune) <> '' GROUP BY 1 HAVING count(DISTINCT release_id) > 1")
def works_on_several_releases(spark, d):
    return table(spark, d, "tracks").where(F.trim("tune") != "").groupBy("tune").agg(F.count_distinct("release_id").alias("releases")).where("releases > 1")


# ----------------------------------------------------------------- ordered analytics


@query("""
WITH t AS (SELECT row_id, release_id, coalesce(disc_number, 0) AS disc, composer AS label, track_number AS no FROM tracks WHERE release_id IS NOT NULL),
a AS (SELECT *, row_number() OVER w = 1 AS fst, label IS DISTINCT FROM lag(label) OVER w AS chg FROM t WINDOW w AS (PARTITION BY release_id, disc ORDER BY no NULLS FIRST, row_id)),
b AS (SELECT *, sum(CASE WHEN chg AND NOT fst AND no IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY release_id, disc ORDER BY no NULLS FIRST, row_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, last_value(no IGNORE NULLS) OVER (PARTITION BY release_id, disc, run ORDER BY no NULLS FIRST, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM b)
SELECT row_id, CAST(sum(CASE WHEN fst OR chg OR coalesce(no <= carried, false) THEN 1 ELSE 0 END) OVER (PARTITION BY release_id, disc ORDER BY no NULLS FIRST, row_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment FROM c
""")
def work_segments(spark, d):
    t = table(spark, d, "tracks").where("release_id is not null").select("row_id", "release_id", F.coalesce("disc_number", F.lit(0)).alias("disc"), "composer", "track_number")
    return ordered.segments(t, ["release_id", "disc"], ["track_number", "row_id"], "composer", "track_number").select("row_id", "segment")


def _every(rx: str) -> str:
    """SQL: list of {start, end, hit} of all matches in ``title``, each at its own place."""
    hits, gaps = f"regexp_extract_all(title, '{rx}')", f"string_split_regex(title, '{rx}')"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'s': 1 + list_sum(list_transform(({gaps})[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(({hits})[:i - 1], lambda h: length(h))), 0), 'h': ({hits})[i]}})"


_SPANS = (r"No\. \d+", r"Vol\. \d+", r"[A-Z][a-z]+ [A-Z][a-z]+", r"\d{4}")


@query(f"""
WITH RECURSIVE h AS (SELECT release_id, list_sort(list_transform({" || ".join(_every(rx) for rx in _SPANS)}, lambda x: {{'s': CAST(x.s AS BIGINT), 'l': -length(x.h), 'h': x.h}})) AS hs FROM releases WHERE title IS NOT NULL),
w AS (SELECT release_id, hs, 1 AS i, CAST(0 AS BIGINT) AS till, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS hit FROM h
      UNION ALL
      SELECT release_id, hs, i + 1, CASE WHEN hs[i].s < till THEN till ELSE hs[i].s - hs[i].l END, CASE WHEN hs[i].s < till THEN pos ELSE pos + 1 END, CASE WHEN hs[i].s < till THEN NULL ELSE hs[i].s END, hs[i].h FROM w WHERE i <= len(hs))
SELECT release_id, CAST(pos AS INTEGER) AS pos, CAST(start AS INTEGER) AS start, hit FROM w WHERE start IS NOT NULL
""")
def leftmost_spans(spark, d):
    """Non-overlapping leftmost numbers and capitalised phrases of release titles."""
    r = table(spark, d, "releases").where("title is not null").select("release_id", "title")
    hits = F.flatten(F.array(*[text.match_spans(F.col("title"), x) for x in _SPANS]))
    kept = r.select("release_id", F.posexplode(ordered.leftmost_spans(hits)).alias("pos", "s"))
    return kept.select("release_id", "pos", "s.start", "s.hit")


@query("""
WITH RECURSIVE n AS (SELECT release_id, coalesce(codec, '?') AS facet, title AS name, coalesce(CAST(release_year AS VARCHAR), '') AS extra, row_number() OVER (PARTITION BY coalesce(codec, '?') ORDER BY release_id) AS i FROM releases WHERE title IS NOT NULL),
w AS (SELECT facet, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS release_id, CAST(NULL AS VARCHAR) AS unique_name FROM (SELECT DISTINCT facet FROM n)
      UNION ALL
      SELECT facet, i, used || [lower(pick)], release_id, pick FROM (
        SELECT w.facet, n.i, w.used, n.release_id,
          list_filter([n.name] || CASE WHEN n.extra <> '' THEN [n.name || ' (' || n.extra || ')'] ELSE [] END || list_transform(range(2, len(w.used) + 3), lambda k: n.name || ' #' || k), lambda c: NOT list_contains(w.used, lower(c)))[1] AS pick
        FROM w JOIN n ON n.facet = w.facet AND n.i = w.i + 1))
SELECT release_id, unique_name FROM w WHERE release_id IS NOT NULL
""")
def collision_names(spark, d):
    r = table(spark, d, "releases").where("title is not null").select("release_id", F.coalesce("codec", F.lit("?")).alias("facet"), F.col("title").alias("name"), F.coalesce(F.col("release_year").cast("string"), F.lit("")).alias("extra"))
    return ordered.distinct_names(r, "facet", "name", "extra", "release_id").select("release_id", "unique_name")


@query("""
WITH c AS (SELECT label, title, count(*) AS n FROM releases WHERE label IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2),
r AS (SELECT label, title, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, title) AS rank, greatest(count(*) OVER (PARTITION BY label) - 5, 0) AS more FROM c)
SELECT label, title, n, rank, more FROM r WHERE rank <= 5
""")
def topk_examples(spark, d):
    c = table(spark, d, "releases").where("label is not null and title is not null").groupBy("label", "title").agg(F.count("*").alias("n"))
    return ordered.top_with_rest(c, ["label"], [F.desc("n"), F.col("title")], 5).select("label", "title", "n", F.col("rank").cast("bigint").alias("rank"), "more")


@query("""
WITH x AS (SELECT row_id, release_id, regexp_replace(regexp_replace(lower(filename), '(\\d+)', '000000000000\\1', 'g'), '0+(\\d{12})', '\\1', 'g') AS k FROM tracks WHERE release_id IS NOT NULL AND filename IS NOT NULL)
SELECT row_id, dense_rank() OVER (PARTITION BY release_id ORDER BY k) AS place FROM x
""")
def natural_rank(spark, d):
    t = table(spark, d, "tracks").where("release_id is not null and filename is not null").select("row_id", "release_id", ordered.natural_key(F.col("filename")).alias("k"))
    return ordered.spread_dense_rank(t, ["release_id"], ["k"], "place").select("row_id", F.col("place").cast("bigint").alias("place"))


@query("""
SELECT row_id, row_number() OVER (PARTITION BY release_id ORDER BY coalesce(nullif(recording_date, ''), '9999'), coalesce(tune, ''), coalesce(track_number, 0), path, row_id) AS place FROM tracks WHERE release_id IS NOT NULL
""")
def chronological_place(spark, d):
    keys = ordered.chronological(F.col("recording_date"), F.col("tune"), F.col("track_number"), F.col("path"))
    t = table(spark, d, "tracks").where("release_id is not null").select("row_id", "release_id", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return ordered.spread_number(t, ["release_id"], [*[f"k{i}" for i in range(len(keys))], "row_id"], "place").select("row_id", F.col("place").cast("bigint").alias("place"))


@query("""
WITH x AS (SELECT DISTINCT nullif(regexp_extract(tune, '^([A-Za-z]+) No\\. \\d+', 1), '') AS system, nullif(regexp_extract(tune, ' No\\. (\\d+)', 1), '') AS number FROM tracks)
SELECT system, number, row_number() OVER (PARTITION BY system ORDER BY CAST(number AS INTEGER), number) AS place FROM x WHERE system IS NOT NULL AND number IS NOT NULL
""")
def catalogue_rank(spark, d):
    g = lambda rx: F.nullif(F.regexp_extract("tune", rx, 1), F.lit(""))
    x = table(spark, d, "tracks").select(g(r"^([A-Za-z]+) No\. \d+").alias("system"), g(r" No\. (\d+)").alias("number")).distinct().where("system is not null and number is not null")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("system").orderBy(*ordered.catalogue_order(F.col("system"), F.col("number"))[1:])).cast("bigint"))


# ------------------------------------------------------------------ text and rules


@query("SELECT row_id, lower(strip_accents(title)) AS folded, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '', 'g') AS key FROM tracks WHERE title IS NOT NULL")
def accent_fold(spark, d):
    t = table(spark, d, "tracks").where("title is not null")
    return t.select("row_id", text.fold(F.col("title")).alias("folded"), text.letters_key(F.col("title")).alias("key"))


@query("""
WITH t AS (SELECT row_id, title, trim(regexp_replace(title, '(?i)^\\s*(?:\\d{1,2}-\\d{1,3}\\s+|(?:cd\\s*\\d+\\s*[-._)]?\\s*)?\\d{1,3}\\s*[-._)\\s]\\s*)([^\\d\\s].*)$', '\\1'), ' ') AS s FROM tracks WHERE title IS NOT NULL),
u AS (SELECT row_id, title, regexp_replace(regexp_replace(s, '(?i)\\((?:alternate\\s+)?take\\s*(\\d+)\\)|\\btake\\s*(\\d+)\\b|\\balt(?:ernate)?\\s*take\\b|\\(alternate\\)|\\[alt\\]', '', 'g'),
   '(?i)\\[[^\\]]*\\]|\\((?:live|mono|stereo|remaster(?:ed)?|alternate|incomplete|part\\s*\\d+|edit)[^)]*\\)', '', 'g') AS s FROM t),
v AS (SELECT row_id, title, regexp_replace(regexp_replace(regexp_replace(s, '[(\\[]\\s*[)\\]]', ' ', 'g'), '\\s{2,}', ' ', 'g'), '^[ \\-_.]+|[ \\-_.]+$', '', 'g') AS s FROM u)
SELECT row_id, nullif(s, '') AS tune_title,
  nullif(regexp_replace(replace(regexp_replace(lower(strip_accents(regexp_replace(s, '[_·‐-―⁃]+', ' ', 'g'))), '\\b(?:the|a|an)\\b', '', 'g'), 'favourite', 'favorite'), '[^a-z0-9]', '', 'g'), '') AS tune_key,
  CASE WHEN regexp_extract(title, '(?i)\\((?:alternate\\s+)?take\\s*(\\d+)\\)', 1) <> '' THEN regexp_extract(title, '(?i)\\((?:alternate\\s+)?take\\s*(\\d+)\\)', 1)
       WHEN regexp_extract(title, '(?i)\\btake\\s*(\\d+)\\b', 1) <> '' THEN regexp_extract(title, '(?i)\\btake\\s*(\\d+)\\b', 1)
       WHEN regexp_matches(title, '(?i)\\balt(?:ernate)?\\s*take\\b|\\(alternate\\)|\\[alt\\]') THEN 'alt' END AS take FROM v
""")
def tune_keys(spark, d):
    t = table(spark, d, "tracks").where("title is not null")
    return t.select("row_id", text.tune_title(F.col("title")).alias("tune_title"), text.tune_key(F.col("title")).alias("tune_key"), text.take_of(F.col("title")).alias("take"))


@query("""
WITH y AS (SELECT release_id, list_transform(regexp_extract_all(folder_name, '(?:^|[^0-9])((?:1[89][0-9]{2}|20[0-4][0-9]))(?:$|[^0-9])', 1), lambda x: CAST(x AS INTEGER)) AS ys FROM releases WHERE folder_name IS NOT NULL)
SELECT release_id, ys[1] AS first_year, CASE WHEN len(ys) >= 2 THEN list_min(ys) END AS recording_year, CAST(ys[1] // 10 * 10 AS VARCHAR) || 's' AS decade FROM y
""")
def folder_years(spark, d):
    f = F.col("folder_name")
    r = table(spark, d, "releases").where("folder_name is not null")
    return r.select("release_id", dates.first_year(f).alias("first_year"), dates.recording_year(f).alias("recording_year"), dates.decade(dates.first_year(f)).alias("decade"))


@query("""
WITH f AS (SELECT row_id, CASE date_precision WHEN 'day' THEN 'Tape, ' || recording_date || ' (mono)' WHEN 'month' THEN substr(recording_date, 1, 4) || ', ' || list_extract(['January','February','March','April','May','June','July','August','September','October','November','December'], CAST(substr(recording_date, 6, 2) AS INTEGER)) || ' tape' ELSE recording_date || ' - tape' END AS label, recording_date, date_precision FROM tracks WHERE recording_date IS NOT NULL)
SELECT row_id, CASE WHEN substr(recording_date, 1, 4) BETWEEN '1930' AND '1979' THEN recording_date END AS iso, CASE WHEN substr(recording_date, 1, 4) BETWEEN '1930' AND '1979' THEN date_precision END AS precision FROM f
""")
def date_parse(spark, d):
    months = F.lit(["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"])
    r = F.col("recording_date")
    month = F.concat(F.substring(r, 1, 4), F.lit(", "), F.try_element_at(months, F.substring(r, 6, 2).try_cast("int")), F.lit(" tape"))
    label = F.when(F.col("date_precision") == "day", F.concat(F.lit("Tape, "), r, F.lit(" (mono)"))).when(F.col("date_precision") == "month", month).otherwise(F.concat(r, F.lit(" - tape")))
    got = dates.parse_date(label)
    return table(spark, d, "tracks").where("recording_date is not null").select("row_id", got["iso"].alias("iso"), got["precision"].alias("precision"))


@query("""
SELECT row_id, CASE WHEN starts_with(codec, 'dsd') THEN 'DSD' WHEN codec IN ('mp3', 'aac', 'vorbis', 'opus') THEN 'Lossy' WHEN coalesce(bit_depth, 0) > 16 OR coalesce(sample_rate, 0) > 48000 THEN 'Hi-Res'
  WHEN coalesce(bit_depth, 0) > 0 AND coalesce(sample_rate, 0) > 0 THEN 'Redbook' ELSE 'Unknown' END AS tier FROM tracks
""")
def quality_tiers(spark, d):
    return table(spark, d, "tracks").select("row_id", rules.quality_tier(F.col("codec"), F.col("bit_depth"), F.col("sample_rate")).alias("tier"))


@query("""
WITH x AS (SELECT release_id, replace(path, '/', ' ') AS p FROM releases WHERE path IS NOT NULL)
SELECT release_id, CASE WHEN regexp_matches(p, '(?i)\\b(interview|announcement|speaks|spoken)\\b') THEN 'interview' WHEN regexp_matches(p, '(?i)\\b(rehearsal|soundcheck|practice|basement)\\b') THEN 'rehearsal'
  WHEN regexp_matches(p, '(?i)\\b(tv show|television|broadcast|radio|jazz casual|rai|ortf|ndr|wdr|sveriges|danmarks|telecast)\\b') THEN 'broadcast'
  WHEN regexp_matches(p, '(?i)\\b(live|concert|in concert|festival|at the|onstage|on stage|tour|theatre|theater|hall|club|jazzhus|konserthuset|set|first set|second set|2nd set)\\b') THEN 'live' ELSE 'studio' END AS provenance FROM x
""")
def provenance(spark, d):
    return table(spark, d, "releases").where("path is not null").select("release_id", rules.provenance(F.col("path")).alias("provenance"))


def _quoted(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


def _title_sql() -> str:
    counted, tempo, marks = _quoted(text.COUNTED), _quoted(rf"(?i)\b(?:{text.TEMPO})"), "title"
    mark_arms, key = [], "lower(strip_accents(title))"
    for system, rx in text.CATALOGUES:
        one, two = (f"regexp_extract({marks}, {_quoted(rx)}, {g})" for g in (1, 2))
        number = f"upper({one}) || ':' || {two}" if system == "Hob" else f"CASE WHEN {two} <> '' THEN {one} || ' No.' || {two} ELSE {one} END"
        mark_arms.append(f"WHEN regexp_matches(title, {_quoted(rx)}) THEN {{'s': '{system}', 'n': {number}}}")
        key = f"regexp_replace({key}, {_quoted(rx)}, ' ', 'g')"
    key = f"regexp_replace({key}, '\\([^)]*\\)', ' ', 'g')"
    key = f"regexp_replace({key}, '\\b(?:no|nr|op|the|a|an|in|for|and|major|minor|flat|sharp)\\b', ' ', 'g')"
    work = f"regexp_replace(regexp_replace(trim(title), {_quoted(text.EDITION)}, '', 'g'), {_quoted(text.AFTER_WORK)}, '', 'g')"
    work = f"trim(regexp_replace(regexp_replace({work}, {_quoted(text.BEFORE_WORK)}, '', 'g'), '\\s{{2,}}', ' ', 'g'), ' -–—,;:')"
    sung = ", ".join(_quoted(x) for x in text.SUNG)
    rest, plain = f"trim(regexp_extract(trim(title), {counted}, 3))", "trim(lower(strip_accents(trim(title))), ' .-')"
    return f"""
WITH p AS (SELECT row_id, title, list_transform(string_split_regex(title, '\\s+[-–—]\\s+|\\s*:\\s+'), lambda x: trim(x)) AS ps FROM tracks WHERE title IS NOT NULL),
q AS (SELECT *, list_max(list_filter(range(2, len(ps) + 1), lambda i: regexp_matches(ps[i], {counted}) OR (regexp_matches(ps[i], {tempo}) AND length(ps[i]) < 70))) AS i FROM p),
r AS (SELECT *, ps[i] AS mv, regexp_matches(ps[i], {counted}) AS c, CASE {" ".join(mark_arms)} END AS k FROM q)
SELECT row_id, CASE WHEN i IS NULL THEN trim(title) ELSE array_to_string(ps[:i - 1], ' - ') END AS work,
  CASE WHEN c THEN coalesce(TRY_CAST(nullif(regexp_extract(mv, {counted}, 1), '') AS INTEGER), CAST(nullif(list_position({text.ROMAN}, lower(regexp_extract(mv, {counted}, 2))), 0) AS INTEGER)) END AS number,
  CASE WHEN i IS NULL THEN NULL WHEN c THEN trim(regexp_extract(mv, {counted}, 3)) ELSE mv END AS movement, k.s AS system, k.n AS mark,
  ({rest} <> '' AND (regexp_matches({rest}, {tempo}) OR len(string_split_regex({rest}, '\\s+')) <= 4)) OR {plain} IN ({sung}) OR (regexp_matches({plain}, '^(?:{text.TEMPO})') AND len(string_split_regex(trim(title), '\\s+')) <= 5) AS bare,
  regexp_replace({key}, '[^a-z0-9]+', '', 'g') AS title_key, coalesce(nullif({work}, ''), trim(title)) AS work_title FROM r
"""


@query(_title_sql())
def titles_split(spark, d):
    """Work, movement, catalogue mark and key of all titles."""
    t = table(spark, d, "tracks").where("title is not null")
    c = F.col("title")
    return t.select("row_id", text.split_movement(c).alias("m"), text.catalogue_mark(c).alias("k"), text.bare_movement(c).alias("bare"), text.title_key(c).alias("title_key"), text.work_title(c).alias("work_title")).select(
        "row_id", "m.work", "m.number", "m.movement", "k.system", F.col("k.number").alias("mark"), "bare", "title_key", "work_title"
    )


_GROUP_RX, _LED_RX = _quoted(text.GROUP), _quoted(text._LED_BY + "([^;/]+)")


@query(f"""
WITH a AS (SELECT row_id, artist_raw AS raw, nullif(trim(regexp_extract(artist_raw, {_LED_RX}, 1)), '') AS l FROM tracks WHERE artist_raw IS NOT NULL),
b AS (SELECT row_id, raw, CASE WHEN NOT regexp_matches(l, {_GROUP_RX}) AND len(string_split_regex(l, '\\s+')) <= 5 THEN l END AS led FROM a),
c AS (SELECT row_id, led, string_split_regex(CASE WHEN led IS NOT NULL THEN regexp_replace(raw, {_quoted(text._LED_BY + ".*$")}, '') ELSE raw END, '\\s*[;/]\\s*|\\s+&\\s+|(?i)\\s+feat\\.?\\s+') AS ch FROM b),
e AS (SELECT row_id, led, list_filter(list_transform(flatten(list_transform(ch, lambda x: CASE WHEN contains(x, ',') AND regexp_matches(x, {_GROUP_RX}) THEN string_split(x, ',') ELSE [x] END)), lambda y: trim(y)), lambda z: z <> '') AS ps FROM c)
SELECT row_id, array_to_string(list_filter(ps, lambda x: NOT regexp_matches(x, {_GROUP_RX})), '; ') AS people, array_to_string(list_filter(ps, lambda x: regexp_matches(x, {_GROUP_RX})), '; ') AS groups, led AS led_by FROM e
""")
def artists_split(spark, d):
    """People, groups and the leader named in packed artist fields."""
    t = table(spark, d, "tracks").where("artist_raw is not null").select("row_id", text.artist_parts(F.col("artist_raw")).alias("a"))
    return t.select("row_id", F.array_join("a.people", "; ").alias("people"), F.array_join("a.groups", "; ").alias("groups"), "a.led_by")


@query("""
SELECT probe_id, CASE WHEN json_valid(raw_json) THEN json_extract_string(raw_json, '$.format.duration') END AS duration FROM raw_probe WHERE json_valid(raw_json) AND json_type(raw_json, '$.streams') = 'ARRAY'
""")
def probe_json(spark, d):
    from lacquer.operators.nested import shred

    p = table(spark, d, "raw_probe").where("raw_json is not null")
    rows = shred(p.select("probe_id", "raw_json"), "probe_id", "raw_json")
    root = rows.where("table_path = ''").select("probe_id", F.try_element_at("fields", F.lit("/format/duration")).alias("duration"))
    streams = rows.where("table_path = '/streams/*'").select("probe_id").distinct()
    return streams.join(root, "probe_id", "left")


# ---------------------------------------------------------- reconciliation and audit


@query("""
WITH c AS (SELECT release_id AS entity, 'artist' AS field, artist_tag AS value, 'tag' AS source, 0.8 AS strength FROM tracks WHERE release_id IS NOT NULL
           UNION ALL SELECT release_id, 'artist', album_artist, 'release', 0.9 FROM releases),
v AS (SELECT entity, field, value, count(DISTINCT source) AS sources, max(strength) AS strength FROM c WHERE trim(value) <> '' GROUP BY 1, 2, 3),
r AS (SELECT *, count(*) OVER (PARTITION BY entity, field) AS vals, row_number() OVER (PARTITION BY entity, field ORDER BY sources DESC, strength DESC, value) AS k FROM v)
SELECT entity, field, value AS best, vals AS "values", sources, CAST(strength AS DOUBLE) AS strength, CASE WHEN vals > 1 THEN 'contested' WHEN sources > 1 AND strength >= 0.75 THEN 'corroborated' WHEN strength >= 0.95 THEN 'high' WHEN strength >= 0.75 THEN 'medium' ELSE 'low' END AS state
FROM r WHERE k = 1
""")
def claims_verdict(spark, d):
    a = table(spark, d, "tracks").where("release_id is not null").select(F.col("release_id").alias("entity"), F.lit("artist").alias("field"), F.col("artist_tag").alias("value"), F.lit("tag").alias("source"), F.lit(0.8).alias("strength"))
    b = table(spark, d, "releases").select(F.col("release_id").alias("entity"), F.lit("artist").alias("field"), F.col("album_artist").alias("value"), F.lit("release").alias("source"), F.lit(0.9).alias("strength"))
    return groups.claims(a.unionByName(b), "entity", "field", "value", "source", "strength")


@query("""
WITH a AS (SELECT lower(title) AS k, min(CAST(release_year AS VARCHAR)) AS y FROM ext_releases WHERE release_year IS NOT NULL GROUP BY 1),
b AS (SELECT release_id, min(substr(recording_date, 1, 4)) AS y FROM tracks WHERE recording_date IS NOT NULL GROUP BY 1),
j AS (SELECT r.release_id, CAST(r.release_year AS VARCHAR) AS f, a.y AS p, b.y AS q FROM releases r LEFT JOIN a ON lower(r.title) = a.k LEFT JOIN b USING (release_id))
SELECT release_id, CASE WHEN p IS NOT NULL AND q IS NOT NULL AND p <> q THEN 'contested' WHEN p IS NOT NULL AND q IS NOT NULL THEN CASE WHEN p IS NOT DISTINCT FROM f THEN 'confirmed' ELSE 'adopt' END
  WHEN p IS NOT NULL OR q IS NOT NULL THEN CASE WHEN coalesce(p, q) IS NOT DISTINCT FROM f THEN 'confirmed' ELSE 'single-source' END ELSE 'unsourced' END AS state FROM j
""")
def consensus(spark, d):
    a = table(spark, d, "ext_releases").where("release_year is not null").groupBy(F.lower("title").alias("k")).agg(F.min(F.col("release_year").cast("string")).alias("p"))
    b = table(spark, d, "tracks").where("recording_date is not null").groupBy("release_id").agg(F.min(F.substring("recording_date", 1, 4)).alias("q"))
    r = table(spark, d, "releases").select("release_id", F.lower("title").alias("k"), F.col("release_year").cast("string").alias("f"))
    return r.join(a, "k", "left").join(b, "release_id", "left").select("release_id", rules.date_consensus(F.col("f"), F.col("p"), F.col("q")).alias("state"))


@query("""
WITH e AS (SELECT lower(title) AS k, min(release_year) AS y FROM ext_releases GROUP BY 1)
SELECT r.release_id, CASE WHEN e.y IS NULL THEN 'no external year' WHEN r.release_year IS NULL THEN 'no local year' WHEN r.release_year = e.y THEN 'same year' WHEN e.y > r.release_year THEN 'external pressing later' ELSE 'REVIEW external earlier' END AS state
FROM releases r LEFT JOIN e ON lower(r.title) = e.k
""")
def year_states(spark, d):
    e = table(spark, d, "ext_releases").groupBy(F.lower("title").alias("k")).agg(F.min("release_year").alias("y"))
    r = table(spark, d, "releases").select("release_id", F.lower("title").alias("k"), "release_year")
    return r.join(e, "k", "left").select("release_id", rules.year_state(F.col("release_year"), F.col("y")).alias("state"))


_STUDIO = """CASE WHEN regexp_matches(p, '(?i)\\b(interview|announcement|speaks|spoken)\\b') THEN 'interview' WHEN regexp_matches(p, '(?i)\\b(rehearsal|soundcheck|practice|basement)\\b') THEN 'rehearsal'
  WHEN regexp_matches(p, '(?i)\\b(tv show|television|broadcast|radio|jazz casual|rai|ortf|ndr|wdr|sveriges|danmarks|telecast)\\b') THEN 'broadcast'
  WHEN regexp_matches(p, '(?i)\\b(live|concert|in concert|festival|at the|onstage|on stage|tour|theatre|theater|hall|club|jazzhus|konserthuset|set|first set|second set|2nd set)\\b') THEN 'live' ELSE 'studio' END"""

_CHECKS = [
    ("HIGH", "date outside window"), ("MED", "junk title"), ("LOW", "undated"), ("LOW", "no personnel"), ("MED", "tag and folder differ in year"), ("MED", "studio at a venue"), ("HIGH", "release without tracks"), ("HIGH", "orphan track"),
    ("MED", "file loaded twice"), ("MED", "one title, several dates"), ("LOW", "single performance"), ("LOW", "span of 11 years"), ("HIGH", "not on disk"), ("LOW", "personnel outside the band"),
]


@query(f"""
WITH h AS (
  SELECT 'HIGH' AS severity, 'date outside window' AS "check", CAST(row_id AS VARCHAR) AS l FROM tracks WHERE recording_date IS NOT NULL AND NOT (recording_date >= '1925' AND recording_date <= '2025-12-31')
  UNION ALL SELECT 'MED', 'junk title', CAST(row_id AS VARCHAR) FROM tracks WHERE title IS NOT NULL AND (trim(title) = '' OR regexp_full_match(trim(title), '[\\d\\W_]+') OR regexp_matches(trim(title), '(?i)^(track|untitled|audio|unknown|cd\\d)') OR length(trim(title)) <= 2)
  UNION ALL SELECT 'LOW', 'undated', CAST(row_id AS VARCHAR) FROM tracks WHERE recording_date IS NULL
  UNION ALL SELECT 'LOW', 'no personnel', CAST(row_id AS VARCHAR) FROM tracks WHERE coalesce(trim(personnel), '') = ''
  UNION ALL SELECT 'MED', 'tag and folder differ in year', CAST(row_id AS VARCHAR) FROM (SELECT row_id, recording_date, regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '(?:^|[^0-9])((?:1[89][0-9]{{2}}|20[0-4][0-9]))(?:$|[^0-9])', 1) AS y FROM tracks) WHERE y <> '' AND recording_date IS NOT NULL AND y <> substr(recording_date, 1, 4)
  UNION ALL SELECT 'MED', 'studio at a venue', CAST(row_id AS VARCHAR) FROM (SELECT row_id, venue, replace(path, '/', ' ') AS p FROM tracks WHERE path IS NOT NULL AND trim(venue) <> '' AND NOT contains(lower(venue), 'studio')) WHERE {_STUDIO} = 'studio'
  UNION ALL SELECT 'HIGH', 'release without tracks', release_id FROM releases r WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.release_id = r.release_id)
  UNION ALL SELECT 'HIGH', 'orphan track', CAST(row_id AS VARCHAR) FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM releases r WHERE r.release_id = t.release_id)
  UNION ALL SELECT 'MED', 'file loaded twice', track_id FROM tracks WHERE track_id IS NOT NULL GROUP BY track_id HAVING count(*) > 1
  UNION ALL SELECT 'MED', 'one title, several dates', k FROM (SELECT substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 28) AS k, release_year FROM releases WHERE release_year IS NOT NULL AND title IS NOT NULL) WHERE k <> '' GROUP BY k HAVING count(DISTINCT release_year) > 1
  UNION ALL SELECT 'LOW', 'single performance', tune FROM tracks WHERE trim(tune) <> '' GROUP BY tune HAVING count(*) = 1
  UNION ALL SELECT 'LOW', 'span of 11 years', tune FROM tracks WHERE trim(tune) <> '' GROUP BY tune HAVING count(*) >= 5 AND CAST(substr(max(recording_date), 1, 4) AS INTEGER) - CAST(substr(min(recording_date), 1, 4) AS INTEGER) >= 11
  UNION ALL SELECT 'HIGH', 'not on disk', path FROM (SELECT DISTINCT path FROM tracks WHERE path IS NOT NULL) t WHERE NOT EXISTS (SELECT 1 FROM raw_probe p WHERE p.path = t.path)
  UNION ALL SELECT 'LOW', 'personnel outside the band', CAST(row_id AS VARCHAR) FROM (
    SELECT t.row_id, list_filter(list_transform(string_split(t.personnel, ';'), lambda n: trim(n)), lambda n: n <> '') AS named, (SELECT arg_min(l.members, l.ord) FROM lineups l WHERE l.name = t.artist_tag AND trim(l.from_date) <> '' AND
      CASE length(t.recording_date) WHEN 4 THEN t.recording_date || '-06-15' WHEN 7 THEN t.recording_date || '-15' ELSE t.recording_date END >= l.from_date AND CASE length(t.recording_date) WHEN 4 THEN t.recording_date || '-06-15' WHEN 7 THEN t.recording_date || '-15' ELSE t.recording_date END < coalesce(nullif(trim(l.to_date), ''), '9999-12-31')) AS members
    FROM tracks t WHERE trim(t.artist_tag) <> '' AND trim(t.personnel) <> '') WHERE len(named) > 2 AND len(members) > 0 AND NOT list_has_any(named, list_transform(members, lambda m: coalesce(trim(m.name), '')))),
k AS (SELECT severity, "check", l, count(*) AS c, row_number() OVER (PARTITION BY severity, "check" ORDER BY l) AS r FROM h GROUP BY 1, 2, 3),
names(severity, "check") AS (VALUES {", ".join(f"('{s}', '{n}')" for s, n in _CHECKS)})
SELECT n.severity, n."check", CAST(coalesce(sum(c), 0) AS BIGINT) AS n, coalesce(string_agg(l, '; ' ORDER BY l) FILTER (r <= 5), '') AS examples FROM names n LEFT JOIN k USING (severity, "check") GROUP BY 1, 2
""")
def audit_report(spark, d):
    t, r = table(spark, d, "tracks"), table(spark, d, "releases")
    row, date, path = F.col("row_id").cast("string"), F.col("recording_date"), F.col("path")
    folder_year = dates.first_year(text.parent(path)).cast("string")
    at_venue = (F.trim("venue") != "") & ~F.lower("venue").contains("studio")
    one_pass = dict(
        zip(
            _CHECKS[:6],
            (
                date.isNotNull() & ~date.between("1925", "2025-12-31"),
                audit.junk_title(F.col("title")),
                date.isNull(),
                F.coalesce(F.trim("personnel"), F.lit("")) == "",
                folder_year != F.substring(date, 1, 4),
                at_venue & (rules.provenance(path) == "studio") & path.isNotNull(),
            ),
            strict=True,
        )
    )
    arms = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("check"))) for (s, n), c in one_pass.items()])
    hits = t.select(F.explode(F.filter(arms, lambda x: x.isNotNull())).alias("x"), row.alias("l")).select("x.*", "l")
    key = F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""), 1, 28)
    tunes = t.where(F.trim("tune") != "").groupBy("tune").agg(F.count("*").alias("k"), (F.substring(F.max(date), 1, 4).cast("int") - F.substring(F.min(date), 1, 4).cast("int")).alias("span"))
    til = F.coalesce(text.blank_to_null(F.trim("to_date")), F.lit("9999-12-31"))
    bands = table(spark, d, "lineups").where(F.trim("from_date") != "").select(F.col("name").alias("artist_tag"), "members", "ord", "from_date", til.alias("til"))
    named = F.filter(F.transform(F.split("personnel", ";"), lambda n: F.trim(n)), lambda n: n != "")
    played = t.where((F.trim("artist_tag") != "") & (F.trim("personnel") != "")).select("row_id", "artist_tag", "recording_date", named.alias("named")).where(F.size("named") > 2)
    band = joins.interval_join(played, "recording_date", bands, "from_date", "til", "ord", ["artist_tag"]).where(F.size("members") > 0)
    outside = band.where(~F.arrays_overlap("named", F.transform("members", lambda m: F.coalesce(F.trim(m["name"]), F.lit("")))))
    keyed = [
        (r.join(t.select("release_id"), "release_id", "left_anti"), F.col("release_id")),
        (t.join(r.select("release_id"), "release_id", "left_anti"), row),
        (t.where("track_id is not null").groupBy("track_id").count().where("count > 1"), F.col("track_id")),
        (r.where("release_year is not null").groupBy(key.alias("k")).agg(F.count_distinct("release_year").alias("n")).where("k <> '' and n > 1"), F.col("k")),
        (tunes.where("k = 1"), F.col("tune")),
        (tunes.where("k >= 5 and span >= 11"), F.col("tune")),
        (t.where("path is not null").select("path").distinct().join(table(spark, d, "raw_probe").select("path"), "path", "left_anti"), path),
        (outside, row),
    ]
    for (s, n), (df, label) in zip(_CHECKS[6:], keyed, strict=True):
        hits = hits.unionByName(df.select(F.lit(s).alias("severity"), F.lit(n).alias("check"), label.cast("string").alias("l")))
    return audit.counted(hits, _CHECKS)


# --------------------------------------------------------------- sinks and increments


@query("""
SELECT codec, 1 AS place, row_id AS "row", '#EXTINF:' || CASE WHEN coalesce(duration_seconds, 0) > 0 THEN CAST(CAST(floor(duration_seconds) AS BIGINT) AS VARCHAR) ELSE '-1' END || ',' || coalesce(nullif(trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')), ''), '') || chr(13) || chr(10) || path AS text
FROM tracks WHERE codec IS NOT NULL AND path IS NOT NULL
UNION ALL SELECT DISTINCT codec, 0, CAST(NULL AS BIGINT), '#EXTM3U' || chr(13) || chr(10) || '#PLAYLIST:' || codec FROM tracks WHERE codec IS NOT NULL AND path IS NOT NULL
""")
def playlists(spark, d):
    t = table(spark, d, "tracks").where("codec is not null and path is not null")
    order = [F.coalesce("recording_date", F.lit("9999")), F.col("row_id")]
    p = sinks.playlist_lines(t, ["codec"], order, F.col("codec"), F.col("title"), F.col("duration_seconds"), F.col("path"))
    return p.select("codec", "place", F.col("o1").alias("row"), "text")


@query("""
WITH cur AS (SELECT path, max(size) AS size, max(mtime) AS mtime FROM raw_probe WHERE kind = 'audio' AND size IS NOT NULL AND mtime IS NOT NULL GROUP BY path),
lim AS (SELECT avg(mtime) AS m FROM cur),
old AS (SELECT path, size, CASE WHEN size > 30000000 THEN mtime - 1 ELSE mtime END AS mtime FROM cur, lim WHERE mtime <= m UNION ALL SELECT 'gone/' || path, size, mtime FROM cur, lim WHERE mtime > m)
SELECT CASE WHEN cur.path IS NULL THEN 'removed' WHEN old.path IS NOT NULL AND old.size = cur.size AND old.mtime = cur.mtime THEN 'reuse' ELSE 'probe' END AS step, count(*) AS n FROM cur FULL OUTER JOIN old ON cur.path = old.path GROUP BY 1
""")
def incremental_scan(spark, d):
    from lacquer.sources.probe import scan_plan

    cur = table(spark, d, "raw_probe").where("kind = 'audio' and size is not null and mtime is not null").groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    limit = cur.agg(F.avg("mtime").alias("m")).first()["m"] or 0.0
    older = cur.where(F.col("mtime") <= limit).select("path", "size", F.when(F.col("size") > 30000000, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    gone = cur.where(F.col("mtime") > limit).select(F.concat(F.lit("gone/"), "path").alias("path"), "size", "mtime")
    return scan_plan(cur, older.unionByName(gone)).groupBy("step").agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY 1, 2")
def stream_windows(spark, d):
    """The events table as a file stream: each event once, counted by hour, run until all is read.

    Files of a replay come in no order of time, so no watermark may drop late rows: the
    stream only lands what is new, and events are made distinct over all that landed.
    """
    from lacquer.session import ensure_checkpoint_dir
    from lacquer.streaming import ingest

    src = table(spark, d, "events")
    shared = ensure_checkpoint_dir(spark)
    run = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = ingest.file_stream(spark, f"{d}/events.parquet*", src.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.run_once(stream.select("event_id", "ts", "event_type"), f"{run}/rows", f"{run}/state")
    rows = spark.read.parquet(f"{run}/rows").distinct()
    return rows.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("""
SELECT release_id, 'union' AS op, list_aggregate(list_sort(list_distinct(list(codec) || list(date_precision))), 'string_agg', '; ') AS items FROM tracks WHERE release_id IS NOT NULL GROUP BY 1
""")
def set_operations(spark, d):
    t = table(spark, d, "tracks").where("release_id is not null")
    both = F.array_sort(F.array_union(F.collect_set("codec"), F.collect_set("date_precision")))
    return t.groupBy("release_id").agg(F.array_join(both, "; ").alias("items")).withColumn("op", F.lit("union"))


@query("""
SELECT row_id, title IS DISTINCT FROM flat_title AS changed FROM (SELECT row_id, title, substr(coalesce(nullif(title, ''), filename), 1, 120) AS flat_title FROM tracks)
""")
def tag_changes(spark, d):
    flat = F.substring(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("filename")), 1, 120)
    return table(spark, d, "tracks").select("row_id", sinks.changed(F.col("title"), flat).alias("changed"))


@query("SELECT r.release_id, count(t.row_id) AS tracks FROM releases r LEFT JOIN tracks t USING (release_id) GROUP BY 1")
def nested_manifest(spark, d):
    """Releases with nested tracks, read back flat."""
    r, t = table(spark, d, "releases").select("release_id", "path"), table(spark, d, "tracks").select("release_id", "row_id", "path").where("release_id is not null")
    m = sinks.manifest(r, t).groupBy("release_id").agg(F.sum(F.coalesce(F.size("tracks"), F.lit(0))).alias("tracks"))
    return m.select("release_id", F.greatest("tracks", F.lit(0)).cast("bigint").alias("tracks"))


@query()
def works_resolved(spark, d):
    """The work of every track, by its segment and its album's title."""
    from lacquer.operators.works import resolve_works

    real = table(spark, d, "releases").select("release_id", F.coalesce("title", "folder_name").alias("album"))
    t = table(spark, d, "tracks").where("release_id is not null").select("row_id", "release_id", F.coalesce("disc_number", F.lit(0)).alias("disc"), F.col("track_number").alias("number"), "title", "composer")
    return resolve_works(t, real)


@query()
def leaders_in_folders(spark, d):
    """Listed composers named in folder names, with the guards of credits, and leaders by the shape of the name."""
    from lacquer.operators import credits

    ref = table(spark, d, "ref_values").where("kind = 'composer'")
    surname, given = F.trim(F.substring_index("canon", ",", 1)), F.trim(F.substring_index("canon", ",", -1))
    vocab = ref.select(surname.alias("surname"), F.concat_ws(" ", given, surname).alias("name"), F.lit(False).alias("guarded"), F.lit(False).alias("ambiguous"))
    r = table(spark, d, "releases").where("folder_name is not null")
    known = credits.leaders(r, "release_id", "folder_name", vocab)
    shaped = credits.leader_by_shape(F.col("path"))
    j = r.join(known, "release_id", "left").withColumn("s", shaped)
    c = credits.credit(F.col("name"), F.col("confidence"), F.col("s"), F.col("folder_name").rlike(text.GROUP), F.lit(True))
    return j.select("release_id", c["name"].alias("leader"), c["confidence"].alias("confidence"))


@query("""
WITH m AS (SELECT lineup_id, caveat, list_filter(list_transform(members, lambda x: trim(x.name)), lambda n: n IS NOT NULL AND n <> '') AS band FROM lineups),
n AS (SELECT lineup_id, band, CASE WHEN trim(caveat) <> '' THEN string_split(trim(caveat), ' ') END AS named FROM m)
SELECT lineup_id, CASE WHEN len(named) > 0 THEN array_to_string(named, '; ') WHEN len(band) > 0 THEN array_to_string(band, '; ') ELSE '' END AS names, CASE WHEN len(named) > 0 THEN 'named' WHEN len(band) > 0 THEN 'lineup' END AS source FROM n
""")
def personnel_source(spark, d):
    """Names written beside a lineup (the words of its caveat stand for them) win outright, else its members."""
    from lacquer.operators.credits import personnel

    lu = table(spark, d, "lineups")
    band = F.filter(F.transform("members", lambda m: F.trim(m["name"])), lambda n: n.isNotNull() & (n != ""))
    p = personnel(F.when(F.trim("caveat") != "", F.split(F.trim("caveat"), " ")), band)
    return lu.select("lineup_id", F.array_join(p["names"], "; ").alias("names"), p["source"].alias("source"))


@query("""
WITH v AS (SELECT release_id, artist_tag AS value, count(*) AS n FROM tracks WHERE release_id IS NOT NULL AND trim(artist_tag) <> '' GROUP BY 1, 2),
b AS (SELECT release_id, arg_max(value, {'n': n, 'v': value}) AS best, count(*) AS vals FROM v GROUP BY 1)
SELECT b.release_id, CASE WHEN b.best = r.album_artist THEN 'same' WHEN vals > 1 THEN 'contested' WHEN trim(coalesce(r.album_artist, '')) <> '' THEN 'would overwrite' ELSE 'review' END AS stage
FROM b LEFT JOIN releases r USING (release_id)
""")
def decision_stages(spark, d):
    from lacquer.operators.reconcile import score_stage

    v = table(spark, d, "tracks").where("release_id is not null").where(F.trim("artist_tag") != "").groupBy("release_id", F.col("artist_tag").alias("value")).agg(F.count("*").alias("n"))
    b = v.groupBy("release_id").agg(F.max_by("value", F.struct("n", "value")).alias("best"), F.count("*").alias("vals"))
    p = b.select("release_id", "best", F.when(F.col("vals") > 1, "contested").otherwise("low").alias("state"), F.lit(0.5).alias("strength"))
    return score_stage(p, table(spark, d, "releases").select("release_id", "album_artist"), "release_id", "album_artist").select("release_id", "stage")
