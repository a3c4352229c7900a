"""Whole tables, the folder of loose files included, and hot groups split over tasks."""

import time

from lacquer.operators import joins, ordered
from lacquer.plans import registry
from lacquer.session import FREE, cut, cut_by


def test_zip_meets_the_folder_of_loose_files(spark, tmp_path):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    make("tracks", [("r", None, None, i, f"t{i}") for i in range(3)], "release_id string, disc_number int, track_number int, row_id bigint, title string")
    make("releases", [("r", "Loose Files", 0)], "release_id string, title string, track_count int")
    make("ext_releases", [("e", "loose files")], "ext_release_id string, title string")
    make("ext_tracks", [("e", 1, i, f"x{i}", 1) for i in range(3)], "ext_release_id string, disc_number int, track_number int, title string, length_ms bigint")
    got = registry.queries()["zip_equal_length"](spark, str(tmp_path)).collect()
    assert sorted((r.pos, r.title, r.ext_title) for r in got) == [(i + 1, f"t{i}", f"x{i}") for i in range(3)]


def test_a_hot_group_is_ranked_and_cut_over_parts(spark):
    rows = [("h", i % 50, i, None if i % 7 == 0 else "abc"[i // 150], None if i % 5 == 0 else i % 40) for i in range(400)] + [("c", 1, 1, "a", 1)]
    df = spark.createDataFrame(rows, "g string, o int, i int, label string, no int")
    rank = {(r.g, r.i): r.n for r in ordered.spread_dense_rank(df, ["g"], ["o"], "n").collect()}
    assert all(rank["h", i] == i % 50 + 1 for i in range(400)) and rank["c", 1] == 1
    want, seg, carried, prev = {}, 0, None, None
    for _, _, i, label, no in rows[:400]:
        hard = i > 0 and label != prev
        if hard and no is None:
            carried = None
        seg += i == 0 or hard or (no is not None and carried is not None and no <= carried)
        carried, prev, want[i] = no if no is not None else carried, label, seg
    got = {(r.g, r.i): r.segment for r in ordered.segments(df, ["g"], ["i"], "label", "no").collect()}
    assert {i: got["h", i] for i in range(400)} == want and got["c", 1] == 1


def test_duplicates_name_every_member(spark, sf):
    run = lambda q: registry.queries()[q](spark, sf).collect()
    named = {}
    for r in run("duplicate_cluster_members"):
        named.setdefault((r.kind, r.key), []).append((r.release_id, r.bytes))
    facts = [(k[0], len(m), min(m)[0], max(m)[0], sum(b or 0 for _, b in m) - max(b or 0 for _, b in m)) for k, m in named.items()]
    assert sorted(facts) == sorted((r.kind, r.n, r.first_member, r.last_member, r.reclaimable) for r in run("duplicate_clusters")) and facts
    same = {}
    for r in run("duplicate_content_members"):
        same.setdefault((r.n, r.first_release, r.last_release), set()).add(r.release_id)
    assert sorted((len(m), min(m), max(m)) for m in same.values()) == sorted((r.n, r.first_release, r.last_release) for r in run("duplicate_contents"))


def test_a_standard_that_everyone_plays_makes_no_candidates(spark, tmp_path, monkeypatch):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    make("tracks", [(f"r{k}", t) for k in range(40) for t in ("standard", f"a{k}", f"b{k}", f"c{k}")], "release_id string, tune string")
    make("ext_tracks", [(f"{p}{k}", t) for k in range(40) for p in "ef" for t in ("standard", f"a{k}", f"b{k}")], "ext_release_id string, title string")
    make("releases", [(f"r{k}", 1960) for k in range(40)], "release_id string, release_year int")
    make("ext_releases", [(f"{p}{k}", 1960 if p == "e" else 1961) for k in range(40) for p in "ef"], "ext_release_id string, release_year int")
    sizes, cut = [], joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    got = registry.queries()["overlap_best"](spark, str(tmp_path)).collect()
    assert sorted((r.release_id, r.best) for r in got) == sorted((f"r{k}", f"e{k}") for k in range(40))
    assert sizes[-1] == 80


def test_copies_of_a_release_make_no_candidates_of_their_own(spark, tmp_path, monkeypatch):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    # release k comes 20 times, half of them of one year and half of another or none; so does its counterpart
    year = lambda k, i: (1960 + k, 1970 + k if k % 2 else None)[i % 2]
    make("tracks", [(f"r{k}_{i}", f"{t}{k}") for k in range(6) for i in range(20) for t in "abc"], "release_id string, tune string")
    make("ext_tracks", [(f"e{k}_{i}", f"{t}{k}") for k in range(6) for i in range(20) for t in "abc"] + [("e0_gone", f"{t}0") for t in "abc"], "ext_release_id string, title string")
    make("releases", [(f"r{k}_{i}", year(k, i)) for k in range(6) for i in range(20)], "release_id string, release_year int")
    make("ext_releases", [(f"e{k}_{i}", year(k, i)) for k in range(6) for i in range(20)], "ext_release_id string, release_year int")
    sizes, cut = [], joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    got = {r.release_id: r.best for r in registry.queries()["overlap_best"](spark, str(tmp_path)).collect()}
    best = lambda k, i: max(f"e{k}_{j}" for j in range(20) if year(k, i) is None or year(k, j) == year(k, i))
    assert got == {f"r{k}_{i}": best(k, i) for k in range(6) for i in range(20)}
    assert sizes[-1] == 6 * 2 * 2


def test_a_cut_leaves_its_rows_and_partitions_but_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    df = cut(spark.range(1000).repartition(5))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and df.count() == 1000 and spark.conf.get(FREE, "false") == "false"
    keyed = cut_by(spark.range(1000).toDF("k"), "k")
    assert keyed.groupBy("k").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0
