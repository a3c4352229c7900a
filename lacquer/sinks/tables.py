"""Sinks: flat projections, manifests, playlists, plans, exports. Each is a table first and a writer second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacquer.functions.text import blank_to_null, leaks, scrub, squeeze


def flat_tags(j: DataFrame) -> DataFrame:
    """The rich model on the tags of a simple player, cut to 120 characters.

    Needs title, filename, composer, album, folder_name, album_artist, genre_primary and
    release_year; classical music is filed under its composer's surname.
    """
    classical = (F.col("genre_primary") == "Classical") & (F.trim("composer") != "")
    surname = blank_to_null(F.trim(F.substring_index("composer", ",", 1)))
    album = F.coalesce(F.when(F.col("album") != "", F.col("album")), F.col("folder_name"))
    year = F.concat(F.lit("("), F.col("release_year").cast("string"), F.lit(")"))
    dated = F.when(F.col("release_year").isNotNull() & ~album.contains(year), F.concat(album, F.lit(" "), year)).otherwise(album)
    cut = lambda c: F.substring(c, 1, 120)
    return j.withColumns(
        {
            "flat_title": cut(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("filename"))),
            "flat_albumartist": F.when(classical, F.coalesce(surname, F.lit("Various"))).otherwise(F.coalesce(F.when(F.col("album_artist") != "", F.col("album_artist")), F.lit("Unknown Artist"))),
            "flat_album": cut(dated),
            "flat_genre": F.coalesce(F.when(F.col("genre_primary") != "", F.col("genre_primary")), F.lit("Unknown")),
        }
    )


def changed(current: Column, proposed: Column) -> Column:
    return ~current.eqNullSafe(proposed)


def manifest(releases: DataFrame, tracks: DataFrame, key: str = "release_id", most: int = 1000) -> DataFrame:
    """Releases with their tracks nested, ``most`` or fewer a row on average; a store keeps both tables flat.

    A release of more tracks has several rows, told apart by ``chunk``.
    """
    cols = [c for c in tracks.columns if c != key]
    n = tracks.groupBy(key).agg(F.ceil(F.count("*") / most).cast("bigint").alias("_k"))
    chunk = F.pmod(F.xxhash64(*cols), F.col("_k")).cast("int")
    nested = tracks.join(n, key).groupBy(key, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("tracks"))
    return releases.join(nested, key, "left")


def iter_tracks(releases: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """One flat track table, whether tracks lie flat or nested in their releases."""
    return tracks if tracks is not None else releases.select(F.explode("tracks").alias("t")).select("t.*")


def library_rows(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """One row per track with its release's columns (prefixed), arrays joined by "; "."""
    r = releases.select("release_id", *[F.col(c).alias(f"release_{c}") for c in releases.columns if c != "release_id"])
    j = tracks.join(r, "release_id")
    return j.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in j.dtypes])


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV in total order, range-partitioned so that no single task sorts everything."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def playlist_entry(label: Column, seconds: Column, path: Column) -> Column:
    """An entry's two lines: length (-1 if unknown) and label, then the path."""
    length = F.when(F.coalesce(seconds, F.lit(0)) > 0, F.floor(seconds).cast("bigint")).otherwise(F.lit(-1)).cast("string")
    return F.concat(F.lit("#EXTINF:"), length, F.lit(","), F.coalesce(squeeze(label), F.lit("")), F.lit("\r\n"), path)


def playlist_lines(df: DataFrame, by: list[str], order: list[Column], title: Column, label: Column, seconds: Column, path: Column) -> DataFrame:
    """Headers and entries of playlists as rows: by, place (0 for the header), the order columns, text.

    No playlist is gathered: a facet may hold most of a library.
    """
    keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
    rows = df.select(*by, F.lit(1).alias("place"), *keys, playlist_entry(label, seconds, path).alias("text"))
    heads = df.groupBy(*by).agg(F.min(F.concat(F.lit("#EXTM3U\r\n#PLAYLIST:"), title)).alias("text")).withColumn("place", F.lit(0))
    return rows.unionByName(heads, allowMissingColumns=True)


def write_playlists(lines: DataFrame, by: list[str], root: str) -> None:
    """Text files by facet; a long playlist is several parts that follow each other by name."""
    order = [*by, "place", *[c for c in lines.columns if c.startswith("o") and c[1:].isdigit()]]
    sorted_ = lines.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    sorted_.select(*by, F.col("text").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").partitionBy(*by).text(root)


def shareable(df: DataFrame, path_col: str, drop: list[str]) -> DataFrame:
    """``df`` without local columns, its path blanked and every path-shaped text cut to its last part."""
    out = df.drop(*drop).withColumn(path_col, F.lit(""))
    return out.select(*[scrub(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])


def leak_counts(df: DataFrame) -> DataFrame:
    """column, leaks: values of each text column that still hold a local path."""
    cols = [c for c, t in df.dtypes if t == "string"]
    one = df.agg(*[F.count_if(leaks(F.col(c))).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("leaks")) for c in cols])).alias("x")).select("x.*")


def write_shareable(df: DataFrame, path: str, path_col: str, drop: list[str]) -> None:
    """Writes the shareable form, or refuses when a leak is found."""
    out = shareable(df, path_col, drop)
    found = leak_counts(out).where("leaks > 0").collect()
    if found:
        raise ValueError("local paths left in " + ", ".join(f"{r['column']} ({r['leaks']})" for r in found))
    out.write.mode("overwrite").json(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """Incoming rows win by key; with ``replace`` nothing of the existing ones stays."""
    if replace:
        return incoming
    return incoming.unionByName(existing.join(incoming.select(key), key, "left_anti"), allowMissingColumns=True)


def apply_values(manifest_rows: DataFrame, decided: DataFrame, key: str, field: str) -> DataFrame:
    """``field`` with accepted values, and its source and confidence beside it."""
    d = decided.select(key, F.col("value").alias("_v"), F.col("source").alias("_s"), F.col("confidence").alias("_c"))
    j = manifest_rows.join(d, key, "left")
    return j.withColumn(field, F.coalesce("_v", field)).withColumn(f"{field}_source", F.col("_s")).withColumn(f"{field}_confidence", F.col("_c")).drop("_v", "_s", "_c")


def journal(current: DataFrame, plan: DataFrame, key: str = "path") -> DataFrame:
    """Before-images of the tags a plan is to change: path, before, wrote."""
    j = plan.join(current, key)
    before = F.map_filter("tags", lambda k, v: F.map_contains_key("changes", k))
    return j.select(key, before.alias("before"), F.col("changes").alias("wrote"))


def write_tags(current: DataFrame, plan: DataFrame, key: str = "path") -> DataFrame:
    """Tags after a plan; files without a plan stay as they are."""
    j = current.join(plan, key, "left")
    kept = F.map_filter("tags", lambda k, v: ~F.coalesce(F.map_contains_key("changes", k), F.lit(False)))
    return j.select(key, F.when(F.col("changes").isNull(), F.col("tags")).otherwise(F.map_concat(kept, "changes")).alias("tags"))


def undo(current: DataFrame, log: DataFrame, key: str = "path") -> DataFrame:
    """Tags as they were before a journal was written: added ones off, changed ones back."""
    j = current.join(log, key, "left")
    kept = F.map_filter("tags", lambda k, v: ~F.coalesce(F.map_contains_key("wrote", k), F.lit(False)))
    return j.select(key, F.when(F.col("wrote").isNull(), F.col("tags")).otherwise(F.map_concat(kept, "before")).alias("tags"))


def deletion_script(copies: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One shell line for each copy that may be removed: cluster, copy, line; dry unless the lines are run.

    Takes the rows of :func:`lacquer.operators.groups.copies`: copy 0 is kept, and nothing
    of a cluster that isn't safe is named. A cluster may have any number of copies.
    """
    quoted = F.concat(F.lit("rm -i -- '"), F.replace("member", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return copies.where((F.col("copy") > 0) & F.col("safe")).select(cluster, "copy", quoted.alias("line"))


PLAN = "path string, tag string, current string, proposed string, source string, confidence string"


def tag_plan(proposals: DataFrame, overwrite: bool = False) -> DataFrame:
    """The rows of a tag plan: proposals that are accepted, differ from the current value and (unless ``overwrite``) fill a gap."""
    current = F.trim(F.coalesce("current", F.lit("")))
    keep = (F.trim(F.coalesce("proposed", F.lit(""))) != "") & ~F.col("proposed").eqNullSafe(F.col("current"))
    rows = proposals.where(keep if overwrite else keep & (current == ""))
    return rows.select("path", "tag", "current", "proposed", "source", "confidence")


def write_plan(plan: DataFrame, path: str) -> None:
    """The plan as CSV; an empty one too replaces what was there, so that nothing of an earlier plan is applied again."""
    plan.orderBy("path", "tag").write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """Probe records as JSON lines, numbers as they are, the fields of the record only."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def scan_index(records: DataFrame) -> DataFrame:
    """The index of a scan: path, size, mtime and whether the file was readable, the latest record of a path."""
    return records.groupBy("path").agg(F.max_by(F.struct("size", "mtime", F.col("error").isNull().alias("readable")), F.coalesce("mtime", F.lit(-1))).alias("r")).select("path", "r.*")


def session_label(date: Column, tune: Column, take: Column, provenance: Column) -> Column:
    """An entry of a session playlist: date, tune, take and the kind of occasion where it isn't a studio."""
    numbered = F.when(take.rlike(r"^\d+$"), F.concat(F.lit(" (take "), take, F.lit(")"))).when(take.isNotNull(), F.concat(F.lit(" ("), take, F.lit(" take)")))
    kind = F.when(provenance != "studio", F.concat(F.lit(" ["), provenance, F.lit("]")))
    return F.concat(F.coalesce(blank_to_null(date), F.lit("undated")), F.lit(" - "), F.coalesce(blank_to_null(tune), F.lit("untitled")), F.coalesce(numbered, F.lit("")), F.coalesce(kind, F.lit("")))


def csv_tables(tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> None:
    """Several tables as CSV below ``root``, each in its total order."""
    for name, (df, order) in tables.items():
        write_csv(df, f"{root}/{name}", order)


def playlist_name(facet: Column, label: Column, number: Column | None = None, unverified: Column | None = None) -> Column:
    """A playlist's file name: number (two digits), label and a mark where the group is yet to be verified."""
    from lacquer.functions.text import safe_name

    no = F.when(number.isNotNull(), F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit(" "))) if number is not None else F.lit(None).cast("string")
    mark = F.when(unverified, F.lit(" (review)")) if unverified is not None else F.lit(None).cast("string")
    return F.concat_ws("/", facet, safe_name(F.concat(F.coalesce(no, F.lit("")), label, F.coalesce(mark, F.lit("")))))


def track_rows(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """One row per track of a release: its own fields, those its release lends it, and what rules derive from them."""
    from lacquer.functions.rules import quality_tier

    r = releases.select("release_id", F.col("title").alias("album"), "album_artist", F.col("genre_primary").alias("genre"), "label")
    own = ["row_id", "track_id", "release_id", "path", "title", "composer", "tune", "take", "recording_date", "date_precision"]
    j = tracks.join(r, "release_id")
    return j.select(
        *own, F.substring("recording_date", 1, 4).alias("year"), F.coalesce("venue", F.lit("")).alias("venue"), "album", "album_artist", "genre", "label",
        quality_tier(F.col("codec"), F.col("bit_depth"), F.col("sample_rate")).alias("tier"),
    )


def session_rows(tracks: DataFrame) -> DataFrame:
    """One row per session, which is a date and a place: venue, else city, else nothing."""
    place = F.coalesce(blank_to_null(F.trim("venue")), blank_to_null(F.trim("city")), F.lit(""))
    g = tracks.where("recording_date is not null").groupBy(F.col("recording_date").alias("date"), place.alias("place"))
    return g.agg(F.count("*").alias("tracks"), F.count_distinct("release_id").alias("releases"), F.count_distinct("tune").alias("tunes"), F.min("row_id").alias("first_row"), F.sum("size_bytes").alias("bytes"))


def write_sessions(tracks: DataFrame, releases: DataFrame, root: str) -> None:
    """The session build's tables as CSV below ``root``: sessions, tracks, releases and tunes, each in its total order."""
    tunes = tracks.where(F.trim("tune") != "").groupBy("tune").agg(F.count("*").alias("performances"), F.min("recording_date").alias("first_recorded"), F.max("recording_date").alias("last_recorded"))
    csv_tables(
        {"sessions": (session_rows(tracks), ["date", "place"]), "tracks": (track_rows(tracks, releases), ["row_id"]), "releases": (releases, ["release_id"]), "tunes": (tunes, ["tune"])},
        root,
    )
