"""Works behind tracks: marks in album titles, segments of tracks, and their assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacquer.functions.text import CATALOGUES, album_title, blank_to_null, fold, mark_number, match_spans, split_movement, surrogate_key, work_title
from lacquer.operators.groups import majority
from lacquer.operators.ordered import leftmost_spans, segments, spread_dense_rank

def album_works(album: Column) -> Column:
    """array<struct(title, system, number)>: each catalogue mark with the last part of the text before it.

    Every mark has its own place in the text and its whole number ("Op 1 No.3"); of marks
    that overlap the leftmost stays, and a mark's text begins where the mark before ends.
    """
    marks = F.flatten(F.array(*[F.transform(match_spans(album, rx, 2), _numbered(system)) for system, rx in CATALOGUES]))
    kept = leftmost_spans(marks)
    starts = F.concat(F.array(F.lit(1)), F.transform(kept, lambda m: m["end"]))

    def work(m: Column, i: Column) -> Column:
        begin = F.get(starts, i)
        parts = F.filter(F.transform(F.split(F.substring(album, begin, m["start"] - begin), r"[-–—,;:]"), lambda p: F.trim(p)), lambda p: p != "")
        return F.struct(F.try_element_at(parts, F.lit(-1)).alias("title"), m["system"].alias("system"), m["number"].alias("number"))

    return F.coalesce(F.transform(kept, work), F.expr("cast(array() as array<struct<title:string,system:string,number:string>>)"))


def _numbered(system: str):
    def of(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(system).alias("system"), mark_number(system, m["g1"], m["g2"]).alias("number"))

    return of


def resolve_works(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """row_id, segment, work, composer and work_id of every track.

    Tracks have row_id, release_id, disc, number, title, composer; albums release_id and
    album. Tracks of one disc fall into segments; a segment's work is the majority of its
    titles' work parts, else the album's work at the same place if the album names as many
    works as there are segments or only one, else the album's title.
    """
    parts = tracks.withColumn("m", split_movement(F.col("title"))).withColumn("label", F.when(F.col("m.movement").isNotNull(), blank_to_null(F.col("m.work"))))
    seg = segments(parts.withColumn("mv", F.coalesce(F.col("m.number"), F.col("number"))), ["release_id", "disc"], ["number", "row_id"], "label", "mv")
    seg = spread_dense_rank(seg, ["release_id"], ["disc", "segment"], "place")
    by = ["release_id", "place"]
    label = majority(seg, by, "label", "row_id", "label")
    composer = majority(seg, by, "composer", "row_id", "composer")
    total = seg.groupBy("release_id").agg(F.max("place").alias("segments"))
    works = albums.select("release_id", "album", album_works(F.col("album")).alias("aw"))
    heads = seg.select(*by).distinct().join(total, "release_id").join(works, "release_id", "left").join(label, by, "left").join(composer, by, "left")
    zipped = F.when(F.size("aw") == F.col("segments"), F.get("aw", F.col("place").cast("int") - 1)).when(F.size("aw") == 1, F.try_element_at("aw", F.lit(1)))
    heads = heads.withColumn("z", zipped).withColumn("work", F.coalesce("label", work_title(F.col("z.title")), album_title(F.col("album"))))
    key = F.concat_ws("|", F.coalesce("composer", F.lit("?")), F.when(F.col("z.number").isNotNull(), F.concat_ws(".", "z.system", "z.number")).otherwise(fold(F.coalesce("work", F.lit("")))))
    heads = heads.select(*by, "work", "composer", surrogate_key("work", key).alias("work_id"))
    return seg.select("row_id", *by).join(heads, by).select("row_id", F.col("place").alias("segment"), "work", "composer", "work_id")
