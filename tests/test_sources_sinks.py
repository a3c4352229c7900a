import json

from pyspark.sql import functions as F

from lacquer.sinks import tables as sinks
from lacquer.sources import probe
from lacquer.streaming import ingest


def test_incremental_steps(spark):
    s = "path string, size bigint, mtime bigint"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], s)
    new = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("d", 1, 1)], s)
    steps = {r.path: r.step for r in probe.scan_plan(new, old).collect()}
    assert steps == {"a": "reuse", "b": "probe", "c": "removed", "d": "probe"}
    full = probe.incremental(new, old, lambda todo: todo)
    assert {tuple(r) for r in full.select("path", "size", "mtime").collect()} == {tuple(r) for r in new.collect()}


def test_walk_and_probe_file(spark, tmp_path):
    lib = tmp_path / "lib"
    for name in ("A/01.flac", "A/._01.flac", "A/cover.JPG", "A/disc.iso", "A/x.doc", "_library/02.flac"):
        f = lib / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = {(r.kind, r.path) for r in probe.walk(spark, str(lib)).select("kind", "path").collect()}
    assert {k for k, _ in got} == {"audio", "sidecar", "container"} and len(got) == 3
    lines = [{"kind": "audio", "path": "a/1.flac", "size": 1}, {"kind": "audio", "path": "a/2.iso.wv", "error": "x"}, {"kind": "audio", "path": "a/3.flac", "error": "x"}, {"kind": "odd", "path": "a/4"}, {"kind": "audio", "path": "a/._5.flac"}]
    p = tmp_path / "raw.jsonl"
    p.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    routes = {r.path: r.route for r in probe.routed(probe.read_probe(spark, str(p))).collect()}
    assert routes == {"a/1.flac": "audio", "a/2.iso.wv": "container", "a/3.flac": "failed", "a/4": "sidecar"}


def test_cue_sheet(spark, tmp_path):
    (tmp_path / "x.cue").write_bytes('TITLE "Album"\r\nTRACK 01 AUDIO\r\n  TITLE "Caf\xe9"\r\n  PERFORMER "P"\r\n  INDEX 01 00:00:00\r\nTRACK 02 AUDIO\r\n  TITLE Two\r\n  INDEX 00 04:00:00\r\n  INDEX 01 04:02:15\r\n'.encode("latin-1"))
    got = [(r.track_number, r.title, r.performer, r.start_seconds) for r in probe.read_cue(spark, str(tmp_path)).orderBy("track_number").collect()]
    assert got == [(1, "Café", "P", 0.0), (2, "Two", None, 242.2)]


def test_cache_and_lookup(spark):
    s = "path string, kind string, size bigint, mtime bigint, error string, version int, root string, seq int"
    prev = spark.createDataFrame([("a", "audio", 1, 1, None, 1, "/m", 1), ("a", "audio", 2, 2, None, 1, "/m", 2), ("b", "audio", 1, None, None, 1, "/m", 3), ("c", "audio", 1, 1, "x", 1, "/m", 4)], s)
    assert {(r.path, r.size) for r in probe.usable_cache(prev, 1, "/m").collect()} == {("a", 2), ("c", 1)}
    assert {r.path for r in probe.usable_cache(prev, 1, "/m", retry_errors=True).collect()} == {"a"}
    assert probe.usable_cache(prev, 2, "/m").count() == 0
    st = spark.createDataFrame([(200, "ok"), (429, ""), (None, None), (403, ""), (404, "")], "status int, body string")
    assert [r.outcome for r in probe.lookup_state(st).collect()] == ["final", "transient", "transient", "fatal", "final"]


def test_plan_journal_undo(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("path,tag,current,proposed,source,confidence\na,TITLE,x,y,s,high\na,TITLE,x,z,s,high\n,TITLE,x,y,s,high\nb,,x,y,s,high\n")
    plan, bad = probe.read_plan(spark, str(tmp_path / "plan.csv"))
    assert bad == 2 and plan.first()["changes"] == {"TITLE": "z"}
    cur = spark.createDataFrame([("a", {"TITLE": "x", "ARTIST": "q"}), ("b", {"TITLE": "w"})], "path string, tags map<string,string>")
    log = sinks.journal(cur, plan)
    after = sinks.write_tags(cur, plan)
    assert {r.path: r.tags for r in after.collect()} == {"a": {"TITLE": "z", "ARTIST": "q"}, "b": {"TITLE": "w"}}
    assert {r.path: r.tags for r in sinks.undo(after, log).collect()} == {r.path: r.tags for r in cur.collect()}


def test_playlist_export_upsert(spark, tmp_path):
    df = spark.createDataFrame([("f", 2, "b\nc", 61.5, "p/2"), ("f", 1, "a", None, "p/1")], "g string, o int, l string, s double, p string")
    lines = sinks.playlist_lines(df, ["g"], [F.col("o")], F.col("g"), F.col("l"), F.col("s"), F.col("p"))
    sinks.write_playlists(lines, ["g"], str(tmp_path / "m3u"))
    parts = sorted((tmp_path / "m3u" / "g=f").glob("part-*"))
    assert b"".join(x.read_bytes() for x in parts) == b"#EXTM3U\r\n#PLAYLIST:f\r\n#EXTINF:-1,a\r\np/1\r\n#EXTINF:61,b c\r\np/2\r\n"
    nested = sinks.manifest(spark.createDataFrame([("r",), ("e",)], "release_id string"), spark.createDataFrame([("r", i) for i in range(50)], "release_id string, i int"), most=10).collect()
    assert sorted(t.i for r in nested for t in (r.tracks or [])) == list(range(50)) and len({r.chunk for r in nested}) > 3
    lib = spark.createDataFrame([("/home/me/x/a.flac", "AC/DC", "/home/me/x")], "path string, artist string, root string")
    out = sinks.shareable(lib, "path", ["root"])
    assert out.first().asDict() == {"path": "", "artist": "AC/DC"} and sum(r.leaks for r in sinks.leak_counts(out).collect()) == 0
    assert sum(r.leaks for r in sinks.leak_counts(lib).collect()) == 2
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int")
    assert {tuple(r) for r in sinks.upsert(old, new, "k").collect()} == {("a", 1), ("b", 2)}


def test_stream_upsert(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size int, n int").write.parquet(str(src / "1"))
    schema = spark.read.parquet(str(src / "1")).schema
    run = lambda: ingest.upsert_stream(ingest.file_stream(spark, str(src / "*"), schema), str(tmp_path / "out"), "path", str(tmp_path / "ck"), "n")
    run()
    spark.createDataFrame([("b", 9, 2), ("c", 1, 2)], "path string, size int, n int").write.parquet(str(src / "2"))
    run()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    got = {(r.path, r.size) for r in spark.read.parquet(str(tmp_path / f"out/generation={last}")).collect()}
    assert got == {("a", 1), ("b", 9), ("c", 1)}


def test_walk_finds_names_that_spark_hides(spark, tmp_path):
    from lacquer.sources.probe import decode_bytes, walk

    for name in ("A/01.flac", "A/_02.flac", "A/.03.flac", "_B/04.flac", "A/._05.flac", "_library/06.flac", "A/notes.docx", "07.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.path: (r.kind, r.size) for r in walk(spark, str(tmp_path)).collect()}
    assert got == {p: ("audio", 1) for p in ("A/01.flac", "A/_02.flac", "A/.03.flac", "_B/04.flac", "07.mp3")}
    df = spark.createDataFrame([(bytearray(b"it\x92s \xe9"),), (bytearray("\ufeffé".encode()),)], "b binary").select(decode_bytes(F.col("b")).alias("t"))
    assert {r.t for r in df.collect()} == {"it\u2019s \u00e9", "é"}


def test_an_empty_plan_replaces_the_earlier_one(spark, tmp_path):
    from lacquer.sinks import tables
    from lacquer.sources.probe import read_plan

    rows = [("p", "title", "", "T", "s", "high"), ("p", "artist", "x", "Y", "s", "high"), ("p", "album", "same", "same", "s", "high")]
    proposals = spark.createDataFrame(rows, tables.PLAN)
    at = str(tmp_path / "plan")
    tables.write_plan(tables.tag_plan(proposals), at)
    assert [r.changes for r in read_plan(spark, at)[0].collect()] == [{"title": "T"}]
    tables.write_plan(tables.tag_plan(proposals.limit(0)), at)
    assert read_plan(spark, at)[0].count() == 0
