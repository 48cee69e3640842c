"""What moves between tasks and what is written: texts of tracks as one, compressed CSV, batches without repeated paths, runs over few files."""

import gzip
import os
from dataclasses import replace

from pyspark.sql import functions as F

from reelshelf import schemas
from reelshelf.operators import track_errors
from reelshelf.operators.track_fold import fold_by_file, fold_tracks
from reelshelf.plans.incremental import incremental_run, save_run
from reelshelf.session import configure, scratch_dir
from reelshelf.sources import catalog_csv
from reelshelf.sources.state_table import StateTable
from reelshelf.sources.tables import conform
from reelshelf.streaming.ingest import newest_per_path, once_per_path
from test_runs import NOW, inputs  # noqa: F401
from workload import queries

ODD = ["", " a\tb\n", 'q"\\u0041\\', "ż😀,{}", None, "null", "\x01\x02\u2028"]


def test_compressed_csv_comes_back_whole(spark):
    path = scratch_dir(spark, "gz")
    rows = spark.range(0, 25, 1, 2).select("id", F.concat(F.lit('a"b,'), "id").alias("t"))
    catalog_csv.write_catalog_csv(rows, path, compression="gzip", max_rows_per_file=5)
    assert sorted(set(f.split(".", 1)[1] for f in os.listdir(path) if f.startswith("part-"))) == ["csv.gz"]
    assert sum(f.startswith("part-") for f in os.listdir(path)) == 6
    assert sorted(catalog_csv.read_catalog_csv(spark, path, rows.schema).collect()) == sorted(rows.collect())


def test_tracks_move_with_their_texts_as_one(spark):
    values = [(f"f{i % 3}", i, kind, a, b) for i, (a, b, kind) in enumerate((a, b, k) for a in ODD for b in ODD for k in ("General", "Video", "Audio", "Text"))]
    tracks = conform(spark.createDataFrame(values, "file_path string, track_order bigint, track_type string, title string, format string"), schemas.TRACKS)
    tracks = tracks.withColumns({"language": F.col("title"), "encoding_settings": F.col("title"), "movie_name": F.col("title"), "service_kind": F.col("format")})
    folded = fold_by_file(tracks)
    assert "_texts" in folded._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, folded.collect())) == sorted(map(repr, fold_tracks(tracks).select(*folded.columns).collect()))


def test_a_batch_without_repeated_paths_moves_no_rows(spark):
    configure(spark)
    rows = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "2", 3)], "file_path string, scanned_at_ts string, n int")
    assert once_per_path(rows, rows.select("file_path")) is rows
    more = rows.union(spark.createDataFrame([("a", "2", 0), ("c", "2", 9), (None, "1", 5), (None, "1", 4)], rows.schema))
    once = once_per_path(more, more.select("file_path"))
    assert sorted(map(repr, once.collect())) == sorted(map(repr, newest_per_path(more).collect()))
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:  # too many repeated paths to send to all tasks
        spark.conf.set(key, "1")
        assert sorted(map(repr, once_per_path(more, more.select("file_path")).collect())) == sorted(map(repr, once.collect()))
    finally:
        spark.conf.set(key, before)


def test_a_run_over_few_files_moves_their_tracks_only(spark, inputs):  # noqa: F811
    configure(spark)
    table = StateTable(spark, scratch_dir(spark, "few"))
    inputs = replace(inputs, ref_search=None, ref_details=None)
    save_run(incremental_run(inputs, table.load(), 2026, NOW), table, "run-1", NOW)
    listed = inputs.files.withColumn("size_bytes", F.col("size_bytes") + F.col("file_path").contains("Alpha").cast("int"))
    run = incremental_run(inputs.of(listed), table.load(), 2026, NOW)
    plan = run.processed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert [(r.file_path, r.data.duration_fmt) for r in run.processed.collect()] == [("F:/M/Movies/Alpha (1999).mkv", "00:01:00")]
    assert run.catalog.count() == 3


def test_deltas_are_read_twice_however_many_there_are(spark):
    configure(spark)
    schema = "file_path string, mtime timestamp_ntz, size_bytes bigint, tmdb_enriched int"

    def rows(*items):
        return spark.createDataFrame([(path, None, size, 0) for path, size in items], schema)

    def filled(**options):
        table = StateTable(spark, scratch_dir(spark, "d"), schema=rows().schema, **options)
        table.write_full(rows(("a", 1), ("b", 1), ("c", 1), (None, 1)), "base")
        # a path twice in a delta, paths that are NULL, a mark and then a row, a row and then a mark
        table.append_delta(rows(("a", 2), ("d", 2)), "r-0", rows(("b", 0), ("e", 0)))
        table.append_delta(rows(("d", 3), ("d", 4), (None, 3)), "r-1", rows(("a", 0), (None, 0)))
        table.append_delta(rows(("b", 5)), "r-2", rows(("b", 0), ("f", 0), ("f", 0)))
        table.append_delta(rows(("e", 6)), "r-3", rows(("g", 0)))
        return table

    expected = [(None, 1), ("b", 5), ("c", 1), ("d", 3), ("d", 4), ("e", 6)]
    for options in ({}, {"merge_deltas": 4, "fold_share": 9.0}, {"merge_deltas": 4, "fold_share": 0.0}):
        loaded = filled(**options).load()
        plan = loaded._jdf.queryExecution().optimizedPlan().toString()
        assert options or plan.count("Relation ") == 1 + 2 * 4
        got = [(r.file_path, r.size_bytes) for r in loaded.collect()]
        assert sorted(got, key=lambda r: (r[0] is not None, r)) == expected


def test_rows_sorted_by_file_are_folded_as_they_come(spark):
    """F1 to F4, F6: sorted while packed, then both levels of the fold take a row at a time; no hash table that falls back to a sort."""
    configure(spark)
    rows = [(f"f{i % 5}", i, kind, "pl", str(i)) for i, kind in enumerate(("General", "Video", "Audio", "Text", "Menu", None) * 5)]
    tracks = conform(spark.createDataFrame(rows, "file_path string, track_order bigint, track_type string, language string, title string"), schemas.TRACKS)
    folded = fold_by_file(tracks)
    assert sorted(map(repr, folded.collect())) == sorted(map(repr, fold_tracks(tracks).select(*folded.columns).collect()))
    final = folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("SortAggregate") == 2 and "ObjectHashAggregate" not in final, final


def test_good_numbers_are_dropped_before_anything_is_built_for_them(spark):
    """F1 to F4, F6: out of range is what 32 bits don't hold, asked by length first; the others never reach the explode."""
    texts = ["2147483647", "2147483648", "-2147483648", "-2147483649", "+2147483648", " 8 ", "0000000001", "00002147483648", "x", "8.0", "12345678901x", "", None]
    rows = [("f", i, kind, text, text) for i, text in enumerate(texts) for kind in ("General", "Video", "Audio", None)]
    tracks = conform(spark.createDataFrame(rows, "file_path string, track_order bigint, track_type string, width string, part_id string"), schemas.TRACKS)
    told = {(r.track_order, r.attribute, r.reason) for r in track_errors.track_problems(tracks, "file_path").collect()}
    beyond, none = (1, 3, 4, 7), (8, 9, 10)
    assert told == {(i, a, reason) for a in ("width", "part_id") for some, reason in ((beyond, "out of range"), (none, "no number")) for i in some}
    found = track_errors.range_errors(tracks, "file_path")
    assert found.first().attribute_error == "part_id: 2147483648 is out of range (track 1) and 7 more"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "(length(width#" in plan.split("Generate")[1]


def test_what_a_run_lands_and_stores_is_packed_well(spark, inputs, tmp_path):  # noqa: F811
    """F5, F8 to F10: landed rows and generations of the state are zstd."""
    table = StateTable(spark, str(tmp_path), schema=schemas.STATE)
    run = incremental_run(replace(inputs, ref_search=None, ref_details=None), table.load(), 2026, NOW)
    save_run(run, table, "run-1", NOW)
    table.append_delta(table.load().limit(1), "d-1")
    stored = [f for _, _, files in os.walk(tmp_path) for f in files if f.startswith("part-")]
    landed = [os.path.basename(f) for f in run.decisions.inputFiles()]
    assert stored and landed and all(f.endswith(".zstd.parquet") for f in stored + landed)


def test_tables_land_as_compressed_json(spark, tmp_path, monkeypatch):
    """the text of all tracks is read back whole from gzip files, of bounded rows."""
    lines = spark.range(40).select(
        F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"), F.lit(9.0).alias("l_extendedprice"), F.lit("R").alias("l_returnflag"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(5.0).alias("o_totalprice"), F.lit("2000-01-01").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(queries, "scratch_dir", lambda *_: f"{tmp_path}/readers")
    monkeypatch.setitem(queries.PACKED_JSON, "maxRecordsPerFile", 7)
    rows = {r.source: r.rows for r in queries.QUERIES["table_readers"](spark, str(tmp_path)).collect()}
    assert rows == {"images": 4, "tracks": 80, "search": 12, "details": 12}
    for table, most in (("tracks", 7), ("search", 4)):
        files = [f for f in os.listdir(f"{tmp_path}/readers/{table}") if f.startswith("part-")]
        assert files and all(f.endswith(".json.gz") for f in files)
        assert max(len(gzip.open(f"{tmp_path}/readers/{table}/{f}").readlines()) for f in files) <= most
