"""State, incremental runs, streams, sources and sinks."""

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from reelshelf import schemas
from reelshelf.operators import enrichment, inventory, report_partials, reports, state_ops
from reelshelf.operators.track_errors import range_errors
from reelshelf.operators.track_fold import fold_by_file, fold_tracks, tracks_of_files
from reelshelf.plans.catalog import Inputs, build_catalog
from reelshelf.plans.incremental import incremental_run, save_run, stored_rows
from reelshelf.session import configure, landed, scratch_dir
from reelshelf.sources import catalog_csv, exports, listing
from reelshelf.sources.state_table import StateTable
from reelshelf.sources.tables import conform
from reelshelf.streaming.ingest import ingest_listing
from workload.queries import QUERIES
from workload.views import Views

NOW = "2026-01-01T00:00:00"
KEYS = "file_path string, mtime timestamp_ntz, size_bytes bigint, tmdb_enriched int"


def files_of(spark, rows):
    day = dt.datetime(2024, 5, 1, 12, 0, 0, 250000)
    return conform(spark.createDataFrame([(p, "F:/M/Movies", s, day) for p, s in rows], "file_path string, source_root string, size_bytes bigint, mtime timestamp_ntz"), schemas.FILES)


@pytest.fixture
def inputs(spark):
    files = files_of(spark, [("F:/M/Movies/Alpha (1999).mkv", 10), ("F:/M/Movies/Beta 2001.mkv", 20), ("F:/M/Movies/p.JPG", 5), ("F:/M/Movies/n.txt", 1)])
    tracks = conform(spark.createDataFrame([("F:/M/Movies/Alpha (1999).mkv", 0, "General", "60000")], "file_path string, track_order bigint, track_type string, duration string"), schemas.TRACKS)
    images = conform(spark.createDataFrame([("F:/M/Movies/p.JPG", 1000, 500, {"Make": " X\t"})], "file_path string, width int, height int, exif map<string,string>"), schemas.IMAGES)
    search = spark.createDataFrame([("movie", "en-US", "Alpha", 1998, 1, 7), ("movie", "en-US", "Alpha", 1999, 2, 8), ("movie", "en-US", "Beta", 1990, 1, 9)], "endpoint string, language string, query string, year int, rank int, id bigint")
    details = spark.createDataFrame([("movie", "en-US", 8, '{"title":"","name":"Alfa","runtime":null,"episode_run_time":[],"genres":[{"name":"A"},{"name":"B"}]}'), ("movie", "en-US", 9, "{}")], "endpoint string, language string, id bigint, json string")
    return Inputs(files, tracks, images, search, details)


def test_catalog_row(inputs):
    rows = {r.filename: r for r in build_catalog(inputs, 2026, NOW).collect()}
    assert set(rows) == {"Alpha (1999).mkv", "Beta 2001.mkv", "p.JPG"}
    alpha, beta, photo = rows["Alpha (1999).mkv"], rows["Beta 2001.mkv"], rows["p.JPG"]
    assert (alpha.tmdb_id, alpha.tmdb_title, alpha.tmdb_runtime, alpha.tmdb_genres, alpha.tmdb_enriched) == (8, "Alfa", None, "A,B", 1)
    assert (beta.tmdb_id, beta.tmdb_enriched, beta.processing_error, beta.quality_score) == (9, 0, "MediaInfo parse failed", None)
    assert (alpha.duration_fmt, alpha.quality_score, alpha.modified_at_ts) == ("00:01:00", 0.0, "2024-05-01T12:00:00.250000")
    assert (photo.media_type, photo.image_megapixels, photo.camera_make, photo.quality_score) == ("photography", 0.5, "X", None)
    assert build_catalog(inputs, 2026, NOW).columns == [f.name for f in schemas.CATALOG.fields]


def test_plan_has_no_python_and_no_cross_join(inputs):
    plan = build_catalog(inputs, 2026, NOW)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert word not in plan


def test_incremental_run_reuses_and_prunes(spark, inputs):
    table = StateTable(spark, scratch_dir(spark, "t"))
    first = incremental_run(inputs, table.load(), 2026, NOW)
    assert table.write_full(first.state, "one") and not table.write_full(first.state, "one") and table.observed["rows"] == 3
    changed = files_of(spark, [("F:/M/Movies/Alpha (1999).mkv", 10), ("F:/M/Movies/p.JPG", 5), ("F:/M/Movies/New S01E02.mkv", 3)])
    run = incremental_run(inputs.of(changed), table.load(), 2026, "2027-01-01T00:00:00")
    scanned = {r.filename: r.scanned_at_ts[:4] for r in run.catalog.collect()}
    # the enriched film is kept; the photo never gets enriched and is redone
    assert scanned == {"Alpha (1999).mkv": "2026", "p.JPG": "2027", "New S01E02.mkv": "2027"}
    off = incremental_run(inputs.of(changed), table.load(), 2026, "2027-01-01T00:00:00", enrich=False, prune=False)
    scanned = {r.filename: r.scanned_at_ts[:4] for r in off.catalog.collect()}
    assert scanned == {"Alpha (1999).mkv": "2026", "Beta 2001.mkv": "2026", "p.JPG": "2026", "New S01E02.mkv": "2027"}
    stats = state_ops.run_statistics(run.decisions, run.catalog, run.errors).first()
    assert (stats.total, stats.hits, stats.misses, stats.rate, stats.errors) == (3, 2, 1, 66.7, 0)


def keyed(spark, *items):
    return spark.createDataFrame([(p, None, s, 1) for p, s in items], KEYS)


def contents(table):
    return {(r.file_path, r.size_bytes) for r in table.load().collect()}


def test_state_generations(spark):
    root = scratch_dir(spark, "g")
    schema = spark.createDataFrame([], KEYS).schema
    table = StateTable(spark, root, schema=schema)
    assert table.load().count() == 0 and table.vacuum() == 0
    table.write_full(keyed(spark, ("a", 1), ("b", 1)), "x")
    table.append_delta(keyed(spark, ("b", 2), ("c", 2)), "s-0")
    table.append_delta(keyed(spark, ("c", 3)), "s-1")
    assert contents(table) == {("a", 1), ("b", 2), ("c", 3)}
    # a batch that runs again, or an older one, writes nothing; another source's does
    assert not table.append_delta(keyed(spark, ("a", 9)), "s-1") and not table.append_delta(keyed(spark, ("a", 9)), "s-0")
    assert table.append_delta(keyed(spark, ("d", 1)), "other-0")
    with pytest.raises(ValueError):
        table.append_delta(keyed(spark, ("a", 9)), "no number")
    # without its newest pointer the table is what it was before: a lost driver leaves a folder that nobody reads
    newest = os.path.join(table.folder, f"current-{table.pointer()['number']:08d}.json")
    os.rename(newest, newest + ".lost")
    assert contents(table) == {("a", 1), ("b", 2), ("c", 3)}
    assert not os.path.exists(os.path.join(table.folder, "_SUCCESS"))
    assert StateTable(spark, root, version="2.0", schema=schema).load().count() == 0


def test_state_does_not_need_success_markers(spark):
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        table = StateTable(spark, scratch_dir(spark, "m"), schema=spark.createDataFrame([], KEYS).schema)
        table.write_full(keyed(spark, ("a", 1)), "x")
        table.append_delta(keyed(spark, ("b", 1)), "s-0")
        assert contents(table) == {("a", 1), ("b", 1)}
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_fifty_batches_leave_a_small_plan(spark):
    schema = spark.createDataFrame([], KEYS).schema
    table = StateTable(spark, scratch_dir(spark, "c"), schema=schema, merge_deltas=4)
    table.write_full(keyed(spark, *[(f"p{i}", 0) for i in range(200)]), "x")
    expected, kinds = {f"p{i}": 0 for i in range(200)}, set()
    for batch in range(50):
        rows = [(f"p{(batch * 3 + k) % 210}", batch + 1) for k in range(2)]
        gone = f"p{(batch * 7) % 200}"
        table.append_delta(keyed(spark, *rows), f"s-{batch}", keyed(spark, (gone, 0)))
        expected.pop(gone, None)
        expected.update(rows)
        generations = table.pointer()["generations"]
        assert len(generations) <= 5
        kinds.add(tuple(g["kind"] for g in generations))
    assert contents(table) == set(expected.items())
    assert ("full",) in kinds and any(len(k) == 2 for k in kinds)  # folded at times, merged at others
    assert not table.append_delta(keyed(spark, ("p0", 9)), "s-49")
    table.compact(fold=True)
    assert contents(table) == set(expected.items()) and [g["rows"] for g in table.pointer()["generations"]] == [len(expected)]
    assert table.vacuum() > 50 and contents(table) == set(expected.items())


def test_lookup_leaves_the_state_where_it_is(spark, inputs):
    schema = spark.createDataFrame([], KEYS).schema
    table = StateTable(spark, scratch_dir(spark, "b"), schema=schema)
    table.write_full(keyed(spark, ("F:/M/Movies/Alpha (1999).mkv", 10), ("x", 1)), "x")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = state_ops.lookup(inputs.files, table.load())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    assert found.count() == 4


def test_merge_of_bucketed_state_and_deltas_groups_right(spark):
    """Unions over bucketed scans must not be taken for grouped by path."""
    schema = spark.createDataFrame([], KEYS).schema
    table = StateTable(spark, scratch_dir(spark, "u"), schema=schema)
    table.write_full(keyed(spark, *[(f"p{i}", 1) for i in range(50)]), "x")
    both = table.load().unionByName(table.load())
    assert both.groupBy("file_path").count().filter("count = 2").count() == 50


def test_listing_stream_equals_batch(spark, inputs):
    root = scratch_dir(spark, "s")
    for i in range(3):
        inputs.files.filter(F.pmod(F.hash("file_path"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    table = StateTable(spark, f"{root}/state")
    stream = spark.readStream.schema(schemas.FILES).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    for _ in range(2):  # the second start finds nothing new
        ingest_listing(stream, inputs, table, f"{root}/cp", 2026, NOW).awaitTermination()
    got = sorted(map(str, table.load().select("data.*").collect()))
    assert got == sorted(map(str, build_catalog(inputs, 2026, NOW).collect()))


def test_csv_keeps_ints_quotes_and_backslashes(spark):
    path = scratch_dir(spark, "c")
    df = spark.createDataFrame([('F:\\M "q", x', 1973, "two\r\nlines"), ("", None, None)], "p string, y int, t string")
    catalog_csv.write_catalog_csv(df, path)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".csv"))
    assert '"1973"' in text and "1973.0" not in text
    back = catalog_csv.read_catalog_csv(spark, path, df.schema)
    assert {tuple(r) for r in back.collect()} == {('F:\\M "q", x', 1973, "two lines"), (None, None, None)}


def test_csv_keeps_blanks_and_sets_broken_lines_aside(spark):
    path = scratch_dir(spark, "d")
    schema = spark.createDataFrame([], "p string NOT NULL, y int, t string").schema
    rows = spark.createDataFrame([(" a ", 1, " b"), ("", None, "")], "p string, y int, t string")
    catalog_csv.write_catalog_csv(rows, path)
    catalog_csv.write_catalog_csv(rows.select("p", "t"), path, mode="append")  # too few fields
    catalog_csv.write_catalog_csv(rows.select(F.lit("z"), F.lit("no year"), "t"), path, mode="append")  # a value of another type
    back = catalog_csv.read_catalog_csv(spark, path, schema)
    assert sorted(map(tuple, back.collect())) == [("", None, None), (" a ", 1, " b")]
    lines = [r.line for r in catalog_csv.read_corrupt_lines(spark, path, schema).collect()]
    assert sorted(lines) == sorted(['"",""', '" a "," b"', '"z","no year",""', '"z","no year"," b"'])


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "old.csv").write_bytes('\ufeff"p","y"\r\n"F:\\\\M","1973.0"\r\n"","" \r\n'.encode())
    schema = spark.createDataFrame([], "p string, y int").schema
    rows = catalog_csv.read_catalog_csv(spark, str(tmp_path), schema, legacy=True).collect()
    assert tuple(rows[0]) == ("F:\\M", 1973)


def test_roots_are_listed_without_content(spark, tmp_path):
    folder = tmp_path / "Movies" / "sub dir"
    folder.mkdir(parents=True)
    for name in ("a.MKV", "b.txt", "c.jpg"):
        (folder / name).write_bytes(b"12345")
    df = listing.list_roots(spark, [str(tmp_path / "Movies"), str(tmp_path / "Missing")])
    assert df.schema.names == [f.name for f in schemas.FILES.fields]
    assert sorted((r.file_path.split("/")[-1], r.size_bytes) for r in df.collect()) == [("a.MKV", 5), ("c.jpg", 5)]


def test_corrupt_reply_is_an_error_row_and_the_file_stays(spark, inputs):
    broken = inputs.ref_details.withColumn("json", F.when(F.col("id") == 8, '{"title":').otherwise(F.col("json")))
    run = incremental_run(Inputs(inputs.files, inputs.tracks, inputs.images, inputs.ref_search, broken), StateTable(spark, scratch_dir(spark, "e")).load(), 2026, NOW)
    assert [(r.file, r.stage) for r in run.errors.collect()] == [("Alpha (1999).mkv", "tmdb")]
    kept = {r.filename: (r.tmdb_id, r.tmdb_enriched) for r in run.catalog.collect()}
    assert kept["Alpha (1999).mkv"] == (8, 0)
    path = scratch_dir(spark, "errors")
    assert exports.write_errors(run.errors, path) == 1 and spark.read.json(path).count() == 1
    assert exports.write_errors(run.errors.limit(0), f"{path}-none") == 0 and not os.path.exists(f"{path}-none")


def test_odd_types_cost_their_own_column(spark):
    replies = {
        1: '{"title":"A","runtime":45.5,"vote_count":3000000000,"genres":[{"name":"X"},{"id":2},7,null,{"name":5}]}',
        2: '{"title":45,"vote_average":"7.5","vote_count":"12","runtime":"88","genres":"Drama","overview":{"a":1}}',
        3: '{"title":"B","title":"C","runtime":null,"episode_run_time":[50],"genres":null,"production_countries":[]}',
        4: '{"title":"D","episode_run_time":7,"vote_average":"NaN"}', 5: '{"title":"E"', 6: "[1]", 7: '"x"', 8: None, 9: '{"title":"F"} rest',
    }
    df = spark.createDataFrame([("movie", "en-US", i, j) for i, j in replies.items()], "endpoint string, language string, id bigint, json string")
    got = {r.id: r for r in enrichment.parse_details(df).select("id", F.col("d").isNull().alias("corrupt"), *enrichment.detail_columns()).collect()}
    assert [i for i in got if got[i].corrupt] == [5, 6, 7, 8, 9]
    one, two, three, four = (got[i] for i in (1, 2, 3, 4))
    assert (one.tmdb_title, one.tmdb_runtime, one.tmdb_vote_count, one.tmdb_genres) == ("A", None, 3_000_000_000, "X,,,,5")
    assert (two.tmdb_title, two.tmdb_rating, two.tmdb_vote_count, two.tmdb_runtime, two.tmdb_genres, two.tmdb_overview) == ("45", 7.5, 12, 88, None, '{"a":1}')
    assert (three.tmdb_title, three.tmdb_runtime, three.tmdb_genres, three.tmdb_production_countries) == ("C", 50, None, None)
    assert (four.tmdb_title, four.tmdb_runtime, four.tmdb_rating) == ("D", None, None)


def test_details_are_reduced_below_the_choice(spark, inputs):
    named = inventory.name_columns(inputs.files, 2026, NOW)
    plan = enrichment.lookup_of(named, inputs.ref_search, inputs.ref_details)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("max(json") < plan.index("LeftSemi")  # the aggregate stands above the reduction


def test_numbers_out_of_range_are_row_errors(spark, inputs):
    path = "F:/M/Movies/Alpha (1999).mkv"
    rows = [(path, 0, "General", "n/a", None, None), (path, 1, "Video", None, "99999999999", "8.0"), (path, 2, "Video", None, "-3000000000", "12")]
    tracks = conform(spark.createDataFrame(rows, "file_path string, track_order bigint, track_type string, duration string, width string, height string"), schemas.TRACKS)
    run = incremental_run(replace(inputs, tracks=tracks), StateTable(spark, scratch_dir(spark, "n")).load(), 2026, NOW)
    told = {r.filename: r.processing_error for r in run.catalog.collect()}
    assert told["Alpha (1999).mkv"] == "width: 99999999999 is out of range (track 1) and 1 more"
    errors = sorted(r.error for r in run.errors.collect() if r.stage == "attributes")
    assert errors == ["duration: n/a is no number (track 0)", "height: 8.0 is no number (track 1)", "width: -3000000000 is out of range (track 2)", "width: 99999999999 is out of range (track 1)"]


def test_statistics_are_counted_by_the_writes(spark, inputs):
    root = scratch_dir(spark, "w")
    table = StateTable(spark, f"{root}/state")
    run = incremental_run(inputs, table.load(), 2026, NOW)
    row = save_run(run, table, "one", NOW, f"{root}/errors", f"{root}/statistics").first()
    plain = state_ops.run_statistics(run.decisions, run.catalog, run.errors).first()
    assert tuple(row) == tuple(plain) and (row.total, row.hits, row.misses) == (3, 0, 3)
    again = incremental_run(inputs, table.load(), 2026, NOW)
    assert tuple(save_run(again, table, "one", NOW).first())[:2] == tuple(row)[:2]  # in force already
    told = spark.read.json(f"{root}/statistics").first()
    assert (told["date"], told.total, told.cache.misses, told.errors) == (NOW, 3, 3, row.errors)


def test_only_touched_partitions_are_written(spark, inputs):
    root = scratch_dir(spark, "x")
    table = StateTable(spark, f"{root}/state")
    save_run(incremental_run(inputs, table.load(), 2026, NOW, enrich=False), table, "one", NOW)
    exports.write_catalog_parquet(table.load().select("data.*"), f"{root}/export")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(f"{root}/export") for f in names if f.endswith(".parquet")}
    before = files()
    assert {f.split("media_type=")[1].split("/")[0] for f in before} == {"movie", "photography"}
    # the photo goes: its partition goes, the films' files stay
    run = incremental_run(inputs.of(inputs.files.filter("NOT file_path LIKE '%JPG'")), table.load(), 2026, NOW, enrich=False)
    exports.write_changed_parquet(run.catalog, run.touched, f"{root}/export")
    assert files() == {f for f in before if "media_type=movie" in f}
    # a changed film: its partition is written anew
    run = incremental_run(inputs.of(inputs.files.withColumn("size_bytes", F.col("size_bytes") + 1)), table.load(), 2026, NOW, enrich=False)
    exports.write_changed_parquet(run.catalog, run.touched, f"{root}/export")
    back = spark.read.parquet(f"{root}/export")
    assert not files() & before and sorted(r.size_bytes for r in back.collect()) == [6, 11, 21]


def test_listing_stream_deletes_and_reports(spark, inputs):
    root = scratch_dir(spark, "l")
    table = StateTable(spark, f"{root}/state", merge_deltas=2)
    kind = StructType([*schemas.FILES.fields, StructField("deleted", BooleanType())])
    bad = inputs.files.limit(1).withColumn("size_bytes", F.lit(-1).cast("bigint"))
    steps = [inputs.files.unionByName(bad).withColumn("deleted", F.lit(None).cast("boolean")), inputs.files.filter("file_path LIKE '%Beta%'").withColumn("deleted", F.lit(True))]
    for step in steps:
        step.coalesce(1).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(kind).parquet(f"{root}/landed")
        ingest_listing(stream, inputs, table, f"{root}/cp", 2026, NOW, errors_to=f"{root}/errors").awaitTermination()
    assert {r.filename for r in table.load().select("data.*").collect()} == {"Alpha (1999).mkv", "p.JPG"}
    assert "negative size" in {r.error for r in spark.read.json(f"{root}/errors").collect()}


def test_search_explode_ranks_by_position(spark):
    replies = spark.createDataFrame([("tv", "en-US", "q", [(5, 2001), (4, None)])], schemas.REF_SEARCH_REPLIES)
    assert [(r["rank"], r.id, r.year) for r in enrichment.explode_search(replies).collect()] == [(1, 5, 2001), (2, 4, None)]


def test_hidden_names_and_unreadable_folders_are_no_loss(spark, tmp_path):
    for name in ("a", "_b", ".c", "_extras/d", ".hid/e", "deep/er/x [1080p] (1999)"):
        file = tmp_path / "Movies" / f"{name}.mkv"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"123")
    (tmp_path / "Movies" / "gone.mkv").symlink_to(tmp_path / "nowhere")
    rows = listing.list_roots(spark, [str(tmp_path / "Movies")]).collect()
    assert sorted(os.path.basename(r.file_path) for r in rows) == sorted(f"{n}.mkv" for n in ("a", "_b", ".c", "d", "e", "x [1080p] (1999)"))
    assert {r.size_bytes for r in rows} == {3} and all(r.mtime and r.ctime for r in rows)


def test_names_that_are_no_text_are_error_rows(spark, tmp_path):
    root = tmp_path / "Movies"
    (root / "ok").mkdir(parents=True)
    (root / "ok" / "a.mkv").write_bytes(b"1")
    for name in (b"b\xff.mkv", b"dir\xfe/c.mkv"):
        path = os.path.join(os.fsencode(root), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "wb").close()
    found = listing.walk_roots(spark, [str(root)], NOW)
    assert [os.path.basename(r.file_path) for r in found.files.collect()] == ["a.mkv"]
    errors = found.errors.collect()
    assert sorted((r.file, r.error, r.stage) for r in errors) == [("b\ufffd.mkv", "name is not UTF-8", "listing"), ("dir\ufffd", "name is not UTF-8", "listing")]
    assert found.errors.columns == [f.name for f in schemas.ERRORS.fields]


def test_changes_of_a_tree(spark, tmp_path):
    """New, changed and deleted files of a tree, listing after listing; a batch that runs again adds nothing."""
    root = tmp_path / "Movies"
    root.mkdir()
    snapshot = StateTable(spark, scratch_dir(spark, "tree"), schema=schemas.FILES, merge_deltas=2)
    write = lambda name, size: (root / name).write_bytes(b"x" * size)
    write("a.mkv", 1), write("b.mkv", 2)
    told = []
    for step in range(4):
        if step == 1:
            write("b.mkv", 3), write("c.mkv", 4), (root / "a.mkv").unlink()
        if step == 3:
            write("a.mkv", 9)
        files = listing.list_roots(spark, [str(root)])
        changes = listing.landed_changes(files, snapshot)
        told.append(sorted((os.path.basename(r.file_path), r.size_bytes, r.deleted) for r in changes.collect()))
        assert listing.keep_listing(changes, snapshot, step) and not listing.keep_listing(changes, snapshot, step)
        assert {r.file_path: r.size_bytes for r in snapshot.load().collect()} == {r.file_path: r.size_bytes for r in files.collect()}
    assert told == [[("a.mkv", 1, None), ("b.mkv", 2, None)], [("a.mkv", None, True), ("b.mkv", 3, None), ("c.mkv", 4, None)], [], [("a.mkv", 9, None)]]


def test_kept_reports_equal_whole_ones(spark, inputs):
    table, kept = StateTable(spark, scratch_dir(spark, "k")), None
    some = lambda like, more: inputs.files.filter(f"file_path LIKE '{like}'").withColumn("size_bytes", F.col("size_bytes") + more)
    for i, files in enumerate((inputs.files, some("%mkv", 0), some("%mkv", 7).unionByName(some("%JPG", 1)), some("%Nothing", 0))):
        run = incremental_run(inputs.of(files), table.load(), 2026, NOW, enrich=False)
        part = landed(report_partials.change_of(run.processed.select("data.*"), run.replaced.select("data.*")), "partials")
        kept = landed(report_partials.merged(*([kept] if kept else []), part), "partials")
        save_run(run, table, f"run-{i}", NOW)
        catalog = table.load().select("data.*")
        for mine, whole in ((report_partials.summary, reports.catalog_summary), (report_partials.quality, reports.quality_breakdown), (report_partials.coverage, reports.language_coverage)):
            order = lambda df: sorted(map(str, df.collect()))
            assert whole(catalog).columns == mine(kept).columns
            if i < 3:  # an empty table has a total row in the one, none in the other
                assert order(mine(kept)) == order(whole(catalog))
    assert kept.count() == 0


def test_doubled_image_rows_leave_one_row_per_file(spark, inputs):
    twice = Inputs(inputs.files, inputs.tracks, inputs.images.unionAll(inputs.images), inputs.ref_search, inputs.ref_details)
    assert build_catalog(twice, 2026, NOW).count() == build_catalog(inputs, 2026, NOW).count()


def test_tracks_of_changed_files_are_dealt_by_chunk(spark, inputs):
    """The semi join lays tracks out by file; the fold must not take that layout over."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = incremental_run(inputs, StateTable(spark, scratch_dir(spark, "p")).load(), 2026, NOW)
        plan = run.processed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("hashpartitioning(file_path" in line and "shiftright(track_order" in line for line in plan.splitlines())


def test_sums_of_read_tables_have_more_than_64_bits(spark, tmp_path):
    """Enough tracks, and their orders add up to more than a long holds."""
    lines = spark.range(4).select(
        F.col("id").alias("l_orderkey"), (F.lit(1 << 43)).alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"), F.lit(9.0).alias("l_extendedprice"), F.lit("R").alias("l_returnflag"))
    lines.unionAll(lines).unionAll(lines.withColumn("l_linenumber", F.lit(1 << 21))).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(5.0).alias("o_totalprice"), F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    told = {r.source: (r.rows, r.total) for r in QUERIES["table_readers"](spark, str(tmp_path)).collect()}
    part = (1 << 43) * 1024 + 1
    assert told["tracks"] == (16, str(8 * (2**40 + part) + 4 * (2**61 + part)))


def test_broadcasts_go_by_measured_sizes(spark, inputs):
    """A side that explodes from a small file is not planned as a broadcast; the session's limit holds for measured sizes."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "3m")
    for _ in range(2):
        configure(session)
        assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "3m"
    session.range(5).selectExpr("'movie' AS endpoint", "'en-US' AS language", "'Alpha' AS query", "sequence(1, 1000) AS hits", "id").write.parquet(path := scratch_dir(session, "hits"))
    search = session.read.parquet(path).selectExpr("endpoint", "language", "query", "explode(hits) AS year", "1 AS rank", "id")
    keys = session.createDataFrame([("movie", "en-US", "Alpha", 7)], "endpoint string, language string, title string, search_year int")
    found = enrichment.resolve_ids(keys, search)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.tmdb_id for r in found.collect()] == [0]


def test_candidates_of_one_small_file_are_dealt(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    candidates = Views(spark, str(tmp_path)).search
    rows = candidates.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) > 1 and sum(r["count"] for r in rows) == 2400


def test_wide_tracks_of_changed_files_move_once(spark, inputs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tracks = tracks_of_files(inputs.tracks, inputs.files, "file_path")
        lines = fold_tracks(tracks)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moves = [line for line in lines if "Exchange hashpartitioning(file_path" in line]
    # the tracks by file and chunk, then the fold's rows by file; the other moves are of narrow pairs
    assert ["shiftright(track_order" in line for line in moves] == [False, True]


def test_tracks_of_files_fold_as_all_tracks_do(spark):
    """Repeated files and tracks, no order, no kind, attributes of another kind: what the fold gives doesn't change."""
    columns = "file_path string, track_order bigint, track_type string, width string, height string, language string, forced string, format string, title string"
    rows = [(f, o, k, "99999999999" if o == 2 else "1920", "1080", "pl", "Yes", f"f{o}", f"t{i}")
            for f in ("a", "b", None) for o in (None, 0, 1, 2, 5000) for i, k in enumerate(("General", "Video", "Audio", "Text", "Menu", None))]
    tracks = conform(spark.createDataFrame(rows + rows[:7], columns), schemas.TRACKS)
    files = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "file_path string")
    plain = fold_tracks(tracks.join(files, "file_path", "left_semi"))
    assert sorted(map(str, fold_tracks(tracks_of_files(tracks, files, "file_path")).collect())) == sorted(map(str, plain.collect()))
    assert plain.count() == 1
    told = lambda df: sorted(map(str, range_errors(df, "file_path").collect()))
    assert told(tracks_of_files(tracks, files, "file_path")) == told(tracks.filter("file_path = 'a'")) != []


def test_stored_rows_are_those_processed(spark, inputs):
    table = StateTable(spark, scratch_dir(spark, "k"))
    for i, files in enumerate((inputs.files, inputs.files.withColumn("size_bytes", F.col("size_bytes") + (F.col("size_bytes") == 20).cast("int")))):
        run = incremental_run(inputs.of(files), table.load(), 2026, NOW, enrich=False)
        made = sorted(map(str, run.processed.collect()))
        save_run(run, table, f"run-{i}", NOW)
        assert sorted(map(str, stored_rows(run, table).collect())) == made and len(made) == (3, 1)[i]


def test_wide_rows_move_once_to_the_catalogue_row(spark, inputs):
    """F5 to F7: tracks of the first chunk meet their files by file; the fold needs no second move once later chunks are found empty."""
    before = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for files in (None, inputs.files):
            folded = fold_by_file(inputs.tracks, "file_path", None, files)
            folded.collect()
            final = folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert final.count("Exchange hashpartitioning(file_path") == (1 if files is None else 2), final
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", before or "10m")


def test_fold_by_file_is_the_fold(spark):
    """Repeated files and tracks, no order, no kind, no file, later chunks with and without a first one."""
    columns = "file_path string, track_order bigint, track_type string, width string, height string, language string, forced string, format string, title string"
    rows = [(f, o, k, "99999999999" if o == 2 else "1920", "1080", "pl", "Yes", f"f{o}", f"t{i}")
            for f in ("a", "b", None) for o in (None, 0, 1, 2, 5000) for i, k in enumerate(("General", "Video", "Audio", "Text", "Menu", None))]
    rows += [("late", o, "Audio", None, None, "en", None, "x", f"t{o}") for o in (9000, 4096, 70000)]
    tracks = conform(spark.createDataFrame(rows + rows[:7], columns), schemas.TRACKS)
    files = spark.createDataFrame([("a",), ("a",), (None,), ("late",)], "file_path string")
    told = lambda df: sorted(map(str, df.collect()))
    for split in (None, F.shiftright("track_order", 1)):
        assert told(fold_by_file(tracks, chunk=split)) == told(fold_tracks(tracks, chunk=split))
        plain = fold_tracks(tracks.join(files, "file_path", "left_semi"), chunk=split)
        assert told(fold_by_file(tracks, chunk=split, files=files)) == told(plain) and plain.count() == 2


def test_stored_rows_stay_in_their_buckets(spark, inputs):
    """F5 to F7, F11 to F13, F17: a second generation's kept rows are not dealt anew, and nothing is lost or doubled."""
    schema = spark.createDataFrame([], KEYS).schema
    table = StateTable(spark, scratch_dir(spark, "w"), schema=schema)
    table.write_full(keyed(spark, ("a", 1), ("b", 2), ("c", 3), (None, 4), ("d", 5), ("d", 6)), "x")
    kept = table.load().filter("coalesce(size_bytes, 0) != 2")
    size = F.sum("size_bytes").alias("size")
    assert table.write_full(keyed(spark, ("b", 7), ("e", 8)), "y", size, kept=kept)
    told = lambda: sorted((str(r.file_path), r.size_bytes) for r in table.load().collect())
    assert told() == [("None", 4), ("a", 1), ("b", 7), ("c", 3), ("d", 5), ("d", 6), ("e", 8)] and table.observed == {"rows": 7, "size": 34}
    assert "Exchange" not in kept.repartition(table.pointer()["buckets"], "file_path")._jdf.queryExecution().executedPlan().toString().replace("AQEShuffleRead", "")
    table.append_delta(keyed(spark, ("a", 9), ("f", 1)), "s-0", keyed(spark, ("c", 0)))
    table.append_delta(keyed(spark, ("f", 2)), "s-1")
    expected = [("None", 4), ("a", 9), ("b", 7), ("d", 5), ("d", 6), ("e", 8), ("f", 2)]
    assert told() == expected
    table.compact(fold=True)
    assert told() == expected and table.pointer()["generations"][0]["rows"] == 7
    other = StateTable(spark, scratch_dir(spark, "w2"), schema=schema)
    other.write_full(keyed(spark, ("z", 1)), "x", kept=table.load())
    assert other.load().count() == 8
