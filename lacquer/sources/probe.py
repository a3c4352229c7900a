"""Sources: library walk, probe records and their incremental reuse, cue sheets, plans, fetched pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacquer.functions.dates import cue_seconds
from lacquer.functions.text import extension, leaf
from lacquer.operators.ordered import natural_key, state_groups
from lacquer.session import cut

#: A probe record as it is stored, numbers not yet cast.
PROBE = (
    "kind string, path string, size bigint, mtime bigint, error string, tags map<string,string>, duration string, format_name string, bit_rate string, codec string, "
    "sample_rate string, channels int, bits_per_raw_sample string, bits_per_sample int, sample_fmt string, has_embedded_art boolean"
)
# What counts as audio, container and sidecar, and folders that are skipped.
AUDIO = [".flac", ".mp3", ".dsf", ".dff", ".aif", ".aiff", ".aifc", ".wav", ".wv", ".ape", ".m4a", ".ogg", ".opus", ".alac"]
CONTAINER = [".iso"]
SIDECAR = [".cue", ".log", ".txt", ".nfo", ".pdf", ".md5", ".sfv", ".accurip", ".jpg", ".jpeg", ".png", ".webp", ".m3u", ".m3u8", ".fpl", ".mht", ".rtf"]
SKIPPED = ["System Volume Information", "$RECYCLE.BIN", "_library"]


def kind_of(path: Column) -> Column:
    """audio, container or sidecar by the ending; null for what is no part of a library."""
    ext = extension(path)
    return F.when(leaf(path).startswith("._"), None).when(ext.isin(AUDIO), "audio").when(ext.isin(CONTAINER), "container").when(ext.isin(SIDECAR), "sidecar")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with kind, path, size and mtime; contents are not read.

    Folders are listed level by level by the tasks, through the file system that ``root``
    names on the cluster, so names that begin with ``_`` or ``.`` (which Spark's own
    listing hides) are found too. Only ``SKIPPED`` folders and resource forks are left out.
    """
    from pyarrow import fs

    base = root.rstrip("/")
    types = "path string, folder boolean, size bigint, mtime bigint"

    def listed(batches):
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                store, at = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
                for f in store.get_file_info(fs.FileSelector(f"{at}/{folder}".rstrip("/"), recursive=False)):
                    name = f"{folder}/{f.base_name}".lstrip("/")
                    is_folder = f.type == fs.FileType.Directory
                    if not (is_folder and f.base_name in SKIPPED):
                        rows.append((name, is_folder, None if is_folder else f.size, None if is_folder or f.mtime is None else int(f.mtime.timestamp())))
            yield pd.DataFrame(rows, columns=["path", "folder", "size", "mtime"]).astype({"size": "Int64", "mtime": "Int64"})

    level = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        level = cut(level.select("path").mapInPandas(listed, types))
        files = level.where("not folder").select(kind_of(F.col("path")).alias("kind"), "path", "size", "mtime").where("kind is not null")
        found = files if found is None else found.unionByName(files)
        level = level.where("folder")
        if level.isEmpty():
            return found
        level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """Probe records of JSON lines by the fixed schema; a line that is no JSON has nulls only and is left out."""
    return spark.read.schema(PROBE).option("mode", "PERMISSIVE").json(path).where("path is not null")


def routed(records: DataFrame) -> DataFrame:
    """Records with ``route``: audio, container, sidecar or failed; resource forks are left out.

    An unreadable compressed disc image is a container, any other unreadable audio failed.
    """
    audio = F.col("kind") == "audio"
    route = (
        F.when(audio & F.col("error").isNull(), "audio")
        .when(audio & F.lower("path").endswith(".iso.wv"), "container")
        .when(audio, "failed")
        .when(F.col("kind") == "container", "container")
        .otherwise("sidecar")
    )
    return records.where(~leaf(F.col("path")).startswith("._")).withColumn("route", route)


def session_audio(records: DataFrame) -> DataFrame:
    """Readable audio only."""
    return routed(records).where("route = 'audio'").drop("route")


def usable_cache(previous: DataFrame, version: int, root: str, retry_errors: bool = False) -> DataFrame:
    """Earlier audio records that may be reused: none after a change of version or root.

    ``previous`` has version, root and seq (line number); the last record of a path wins.
    """
    ok = previous.where((F.col("version") == version) & (F.col("root") == root) & (F.col("kind") == "audio") & F.col("size").isNotNull() & F.col("mtime").isNotNull())
    if retry_errors:
        ok = ok.where("error is null")
    cols = [c for c in ok.columns if c not in ("path", "version", "root", "seq")]
    return ok.groupBy("path").agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("path", "r.*")


def scan_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Every current file with ``step``: reuse where path, size and mtime are equal, else probe; removed ones as removed.

    One shuffle by path: both sides are tagged, unioned and folded, so a file that moved
    between snapshots costs no second join.
    """
    cur = current.select("path", "size", "mtime", F.lit(1).alias("now"))
    old = previous.select("path", "size", "mtime", F.lit(0).alias("now"))
    g = cur.unionByName(old).groupBy("path").agg(F.max_by(F.struct("size", "mtime"), F.col("now")).alias("c"), F.max("now").alias("here"), F.max(F.when(F.col("now") == 0, F.struct("size", "mtime"))).alias("o"))
    step = F.when(F.col("here") == 0, "removed").when(F.col("c") == F.col("o"), "reuse").otherwise("probe")
    return g.select("path", F.col("c.size").alias("size"), F.col("c.mtime").alias("mtime"), step.alias("step"))


def incremental(current: DataFrame, previous: DataFrame, probe) -> DataFrame:
    """Reused records as they are and ``probe(todo)`` for the rest; removed paths drop out."""
    keys = ["path", "size", "mtime"]
    reuse = previous.join(current.select(*keys), keys, "left_semi")
    todo = current.join(previous.select(*keys), keys, "left_anti")
    return reuse.unionByName(probe(todo), allowMissingColumns=True)


def json_probe(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """The probe's own JSON output as columns: the first audio stream, the format, whether art is embedded."""
    stream = "struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,bits_per_raw_sample:string,duration:string>"
    schema = f"format struct<duration:string,format_name:string,bit_rate:string>, streams array<{stream}>"
    d = df.withColumn("_j", F.from_json(raw, schema))
    first = F.try_element_at(F.filter("_j.streams", lambda s: s["codec_type"] == "audio"), F.lit(1))
    return d.withColumns(
        {
            "probe_duration": F.coalesce(F.col("_j.format.duration"), first["duration"]),
            "probe_codec": first["codec_name"],
            "probe_rate": first["sample_rate"],
            "probe_art": F.coalesce(F.exists("_j.streams", lambda s: s["codec_type"] == "video"), F.lit(False)),
        }
    ).drop("_j")


def cue_tracks(sheets: DataFrame, key: str, text: str) -> DataFrame:
    """Tracks of cue sheets: key, track_number, title, performer, start_seconds; the last line of a kind wins."""
    lines = sheets.select(F.col(key), F.posexplode(F.split(text, r"\r?\n|\r")).alias("pos", "line")).withColumn("line", F.trim("line"))
    opens = F.col("line").rlike(r"(?i)^TRACK\s+\d+\s+AUDIO")
    g = state_groups(lines, key, "pos", opens)
    at = lambda rx: F.max_by(F.when(F.col("line").rlike(rx), F.trim(F.regexp_extract("line", rx, 1))), F.when(F.col("line").rlike(rx), F.col("pos")))
    return g.groupBy(key, "group").agg(
        F.max(F.regexp_extract("line", r"(?i)^TRACK\s+(\d+)\s+AUDIO", 1).try_cast("int")).alias("track_number"),
        at(r'(?i)^TITLE\s+"?(.*?)"?$').alias("title"),
        at(r'(?i)^PERFORMER\s+"?(.*?)"?$').alias("performer"),
        cue_seconds(at(r"(?i)^INDEX\s+01\s+(\S+)")).alias("start_seconds"),
    ).drop("group")


def decode_bytes(c: Column) -> Column:
    """Bytes as text: UTF-8 where it is valid, else Windows-1252, bytes without a meaning there as Latin-1; a byte order mark is taken off."""
    plain = c.cast("string")
    utf8 = F.when(F.is_valid_utf8(plain), plain)
    return F.regexp_replace(F.coalesce(utf8, F.translate(F.decode(c, "ISO-8859-1"), *_windows())), "^\ufeff", "")


def _windows() -> tuple[str, str]:
    """The characters of bytes 128 to 159 in Latin-1, and in Windows-1252 where it has one."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def read_cue(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.cue").load(root)
    return cue_tracks(files.select("path", decode_bytes(F.col("content")).alias("text")), "path", "text")


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(path, changes) of a tag plan in CSV, and how many rows lack a path, tag or value; the last value of a tag wins."""
    schema = "path string, tag string, current string, proposed string, source string, confidence string"
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path).withColumn("_i", F.monotonically_increasing_id())
    good = F.coalesce((F.trim("path") != "") & (F.trim("tag") != "") & (F.trim("proposed") != ""), F.lit(False))
    last = rows.where(good).groupBy("path", "tag").agg(F.max_by("proposed", "_i").alias("proposed"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("tag", "proposed"))).alias("changes")), rows.where(~good).count()


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, as an earlier report is read."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def read_json_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents by ``schema``, an empty table where the file is missing or unreadable."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception:  # a missing path is reported as an analysis error
        return spark.createDataFrame([], schema)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary entries, one row per key: ord, key, and the entry's columns."""
    schema = "ord int, match array<string>, title string, recorded string, precision string, venue string, city string, country string"
    v = read_json_or(spark, path, schema)
    return v.select("*", F.explode("match").alias("key")).drop("match")


def lookup_state(df: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """Answers of an outside service with ``outcome``: only ``final`` ones may be kept.

    A refused key or a broken request is fatal, throttling and server errors are
    transient and asked again, anything else is final, absence included.
    """
    s = F.col(status)
    outcome = F.when(s.isin(401, 403) | F.coalesce(F.col(body).rlike("(?i)invalid api key"), F.lit(False)), "fatal").when(s.isNull() | (s == 429) | (s >= 500), "transient").otherwise("final")
    return df.withColumn("outcome", outcome)


def folders(files: DataFrame) -> DataFrame:
    """Each folder with the count of its audio files by ending."""
    from lacquer.functions.text import parent

    f = files.where(kind_of(F.col("path")) == "audio")
    return f.groupBy(parent(F.col("path")).alias("folder"), extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


def listing(files: DataFrame) -> DataFrame:
    """Files with the natural sort key by which a folder is listed."""
    return files.withColumn("sort_key", natural_key(leaf(F.col("path"))))


def first_missing(paths: DataFrame, disk: DataFrame, most: int = 41) -> DataFrame:
    """The first ``most`` paths (by name) that are not on disk: enough to see that a root is wrong."""
    return paths.select("path").distinct().join(disk.select("path"), "path", "left_anti").orderBy("path").limit(most)
