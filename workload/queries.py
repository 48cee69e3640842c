"""The registered queries: one per operator, each over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelshelf import schemas
from reelshelf.functions import attributes as A
from reelshelf.functions import names as N
from reelshelf.functions.numbers import exact_round, parse_float, safe_int, thousandth
from reelshelf.operators import enrichment as E
from reelshelf.operators import images, inventory, report_partials, reports, sanitize, state_ops, track_errors
from reelshelf.operators.track_fold import (
    AUDIO_FLAGS, AUDIO_LISTS, GENERAL_LAST, GENERAL_LAST_NUMBER, GENERAL_LAST_TRUTHY, TEXT_FLAGS,
    TEXT_LISTS, VIDEO_LAST, VIDEO_LAST_NUMBER, VIDEO_LAST_TRUTHY, fold_tracks,
)
from reelshelf.plans.catalog import build_catalog
from reelshelf.plans.incremental import incremental_run, save_run, stored_rows
from reelshelf.session import configure, scratch_dir
from reelshelf.sources import listing, tables
from reelshelf.sources.catalog_csv import read_catalog_csv, read_catalog_stream, write_catalog_csv
from reelshelf.sources.exports import write_catalog_parquet, write_changed_parquet
from reelshelf.sources.state_table import StateTable
from reelshelf.sources.tables import conform
from reelshelf.streaming.ingest import ingest_catalog, ingest_listing
from workload.views import AS_OF_YEAR, LATER_TS, SCAN_TS, Views

# A catalogue of 130 quoted columns is mostly quotes and commas: a sixth when compressed. A file is some 200 MB of text at most.
PACKED = {"compression": "gzip", "max_rows_per_file": 250_000}
# JSON names each attribute in each row, so it too is landed compressed, in files of bounded rows.
PACKED_JSON = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 250_000}


def _path():
    return F.col("file_path")


# --- column groups, shared with the oracle ------------------------------------
GENERAL_COLUMNS = [
    *GENERAL_LAST, *GENERAL_LAST_TRUTHY, *GENERAL_LAST_NUMBER, "duration_fmt", "has_attachments",
    "has_cover_art", "ai_enhanced", "has_ai_upscaling",
]
VIDEO_COLUMNS = [*VIDEO_LAST, *VIDEO_LAST_TRUTHY, *VIDEO_LAST_NUMBER, "width", "height", "video_resolution"]
AUDIO_LIST_COLUMNS = ["audio_languages_list", *AUDIO_LISTS]
SUBTITLE_COLUMNS = ["subtitle_count", "has_subtitles", "subtitle_forced_count", "subtitle_languages_list", *TEXT_LISTS]
STATE_ROW = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("size_bytes", T.LongType()),
    T.StructField("media_type", T.StringType()), T.StructField("extracted_title", T.StringType()),
    T.StructField("extracted_year", T.IntegerType()), T.StructField("scanned_at_ts", T.StringType()),
])


def _fold(v: Views) -> DataFrame:
    return fold_tracks(v.tracks, "file_id", v.chunk)


def _named(v: Views) -> DataFrame:
    return inventory.name_columns(inventory.file_inventory(v.files), AS_OF_YEAR, SCAN_TS)


def _catalog(v: Views, enrich: bool = True) -> DataFrame:
    return build_catalog(v.inputs, AS_OF_YEAR, SCAN_TS, enrich)


def _kind(v: Views, kind: str) -> DataFrame:
    return v.tracks.filter(F.col("track_type") == kind)


_TRACK = ["file_id", "track_order"]


# --- sources --------------------------------------------------------------------
def read_tracks(v):
    return v.tracks.groupBy("track_type").agg(
        F.count("*").alias("tracks"), F.count("format").alias("with_format"),
        F.count("language").alias("with_language"), F.count("extra").alias("with_chapters"),
    )


def state_load(v):
    """Write a state, then load it by its own and by a foreign version."""
    root = scratch_dir(v.spark, "state-load")
    schema = v.state.schema
    StateTable(v.spark, root, schema=schema).write_full(v.state, "first")
    current = StateTable(v.spark, root, schema=schema).load()
    foreign = StateTable(v.spark, root, version="0.9", schema=schema).load()
    return current.select(F.lit("current").alias("version"), "file_path", "size_bytes", "tmdb_enriched").unionByName(
        foreign.select(F.lit("foreign").alias("version"), "file_path", "size_bytes", "tmdb_enriched")
    )


def _small_catalog(v):
    """Narrow catalogue rows for the CSV and stream round trips."""
    return _named(v).select(
        "file_path", "size_bytes", "media_type", "extracted_title", "extracted_year", "scanned_at_ts"
    )


def state_table_lookup(v):
    """The lookup against a stored full generation: the state's side is read bucket by bucket."""
    table = StateTable(v.spark, scratch_dir(v.spark, "bucketed"), schema=v.state.schema)
    table.write_full(v.state, "base")
    return state_ops.lookup(inventory.file_inventory(v.files), table.load()).select("file_path", "hit", "reuse")


def state_compaction(v):
    """Ten deltas with changes and deletions over a full generation; they are merged and folded on the way."""
    table = StateTable(v.spark, scratch_dir(v.spark, "compaction"), schema=v.state.schema, merge_deltas=4, fold_share=0.5)
    table.write_full(v.state, "base")
    for i in range(10):
        share = F.col("file_id") % 10
        rows = v.files.filter(share == i).select("file_path", "mtime", (F.col("size_bytes") + 5).alias("size_bytes"), F.lit(1).alias("tmdb_enriched"))
        table.append_delta(rows, f"run-{i}", v.files.filter((share == (i + 3) % 10) & (F.col("file_id") % 3 == 1)))
    return table.load().select("file_path", "size_bytes", "tmdb_enriched")


def csv_catalog(v):
    """The whole catalogue row written as CSV and read back."""
    path = scratch_dir(v.spark, "csv-catalog")
    write_catalog_csv(_catalog(v), path, **PACKED)
    return read_catalog_csv(v.spark, path)


def _with_broken_lines(v, rows, folder):
    """Rows landed as CSV, and among the files some whose lines have two fields."""
    write_catalog_csv(rows, folder, **PACKED)
    broken = v.files.filter(F.col("file_id") % 50 == 0).select("file_path", F.lit("x").alias("rest"))
    write_catalog_csv(broken, folder, mode="append", **PACKED)


def stream_catalog(v):
    """The whole catalogue row landed as CSV, with broken lines between -> stream -> state."""
    root = scratch_dir(v.spark, "stream-catalog")
    _with_broken_lines(v, _catalog(v), f"{root}/landed")
    table = StateTable(v.spark, f"{root}/state")
    stream = read_catalog_stream(v.spark, f"{root}/landed", files_per_batch=8)
    ingest_catalog(stream, table, f"{root}/checkpoint", errors_to=f"{root}/errors").awaitTermination()
    return table.load().select("data.*")


def stream_dead_letters(v):
    """The broken lines of a landed folder, as the stream sets them aside."""
    root = scratch_dir(v.spark, "stream-errors")
    _with_broken_lines(v, _small_catalog(v), f"{root}/landed")
    table = StateTable(v.spark, f"{root}/state", schema=STATE_ROW)
    stream = read_catalog_stream(v.spark, f"{root}/landed", STATE_ROW, files_per_batch=8)
    ingest_catalog(stream, table, f"{root}/checkpoint", to_state=lambda rows: rows, errors_to=f"{root}/errors").awaitTermination()
    return v.spark.read.schema("line string").json(f"{root}/errors").select("line")


def stream_listing(v):
    """A listing that lands in three steps (older versions, changes, deletions) -> the incremental run of each batch -> state."""
    root = scratch_dir(v.spark, "stream-listing")
    old = F.col("file_id") % 7 == 0
    first = v.files.select("file_id", F.when(old, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), "file_path", "source_root", "mtime", F.lit(None).cast("boolean").alias("deleted"))
    gone = v.files.filter(F.col("file_id") % 9 == 0).select("file_id", "size_bytes", F.concat(F.lit("gone/"), "file_path").alias("file_path"), "source_root", "mtime")
    unusable = v.files.filter(F.col("file_id") % 31 == 0).select("file_id", F.lit(None).cast("bigint").alias("size_bytes"), F.concat(F.lit("bad/"), "file_path").alias("file_path"), "source_root", "mtime", F.lit(None).cast("boolean").alias("deleted"))
    steps = [
        first.filter(F.col("file_id") % 11 != 0).unionByName(gone.withColumn("deleted", F.lit(False))).unionByName(unusable),
        first.filter(old | (F.col("file_id") % 11 == 0)).withColumn("size_bytes", F.col("size_bytes") - old.cast("int")),
        gone.withColumn("deleted", F.lit(True)),
    ]
    table = StateTable(v.spark, f"{root}/state")
    for step in steps:
        step.write.mode("append").parquet(f"{root}/landed")
        stream = v.spark.readStream.schema(step.schema).parquet(f"{root}/landed")
        ingest_listing(stream, v.inputs, table, f"{root}/checkpoint", AS_OF_YEAR, SCAN_TS, errors_to=f"{root}/errors").awaitTermination()
    return table.load().select("data.*")


def stream_ingest(v):
    """CSV landed in several files -> stream -> state, read back."""
    root = scratch_dir(v.spark, "stream")
    write_catalog_csv(_small_catalog(v), f"{root}/landed")
    table = StateTable(v.spark, f"{root}/state", schema=STATE_ROW)
    stream = read_catalog_stream(v.spark, f"{root}/landed", STATE_ROW, files_per_batch=4)
    ingest_catalog(stream, table, f"{root}/checkpoint", to_state=lambda rows: rows).awaitTermination()
    return table.load()


# --- sinks ----------------------------------------------------------------------
def csv_roundtrip(v):
    """Texts with quotes, commas, backslashes and line breaks, written and read."""
    rows = v.table("documents").select(
        "doc_id", "lang", F.col("text"),
        F.concat(F.lit('F:\\"q", '), "source", F.lit("\\")).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("maybe_empty"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars").cast("int")).alias("maybe_int"),
    )
    path = scratch_dir(v.spark, "csv")
    write_catalog_csv(rows, path)
    back = read_catalog_csv(v.spark, path, rows.schema)
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"), "path", "maybe_empty", "maybe_int")


def sanitize_newlines(v):
    clean = sanitize.sanitize_newlines(v.table("documents"))
    return clean.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def _new_state(v):
    """What a run over the whole listing would store."""
    return v.files.select(
        "file_path", "mtime", (F.col("size_bytes") + 5).alias("size_bytes"), F.lit(1).alias("tmdb_enriched")
    )


def state_upsert(v):
    """Upsert through the stored table: a full generation, then a delta."""
    table = StateTable(v.spark, scratch_dir(v.spark, "upsert"), schema=v.state.schema)
    table.write_full(v.state, "base")
    table.append_delta(_new_state(v), "run-1")
    return table.load().select("file_path", N.iso_timestamp(F.col("mtime")).alias("mtime"), "size_bytes", "tmdb_enriched")


def state_upsert_join(v):
    merged = state_ops.upsert(v.state, _new_state(v))
    return merged.select("file_path", N.iso_timestamp(F.col("mtime")).alias("mtime"), "size_bytes", "tmdb_enriched")


def errors_table(v):
    """Unusable listing rows and files whose detail reply is corrupt."""
    broken, named = inventory.listing_errors(v.raw_listing, SCAN_TS), _named(v)
    return broken.unionByName(E.detail_errors(named, E.lookup_of(named, v.search, v.broken_details), SCAN_TS))


def row_errors(v):
    """Track attributes that are no number or out of range, as error rows."""
    return track_errors.attribute_errors(_named(v), v.tracks, "file_id", SCAN_TS)


def run_stats(v):
    listing = inventory.file_inventory(v.files)
    decisions = state_ops.lookup(listing, v.state)
    named = inventory.name_columns(listing, AS_OF_YEAR, SCAN_TS)
    return state_ops.run_statistics(decisions, named, inventory.listing_errors(v.raw_listing, SCAN_TS))


# --- tracks -----------------------------------------------------------------------
def safe_float(v):
    parsed = v.tracks.select(*_TRACK, parse_float(F.col("bit_rate")).alias("b"), parse_float(F.col("frame_rate")).alias("f"))
    return parsed.select(*_TRACK, exact_round(F.col("b"), 2).alias("bit_rate"), exact_round(F.col("f"), 2).alias("frame_rate"))


def bitrate_kbps(v):
    parsed = v.tracks.select(*_TRACK, *[parse_float(F.col(c)).alias(c) for c in ("bit_rate", "bit_rate_maximum", "source_duration")])
    rounded = parsed.select(*_TRACK, *[exact_round(F.col(c), 2).alias(c) for c in parsed.columns[2:]])
    return rounded.select(
        *_TRACK, thousandth(F.col("bit_rate")).alias("video_bitrate_kbps"),
        thousandth(F.col("bit_rate_maximum")).alias("video_bit_rate_max_kbps"),
        thousandth(F.col("source_duration")).alias("source_duration_sec"),
    )


def content_language(v):
    named = _named(v).select("file_id", "file_path", "folder_language")
    heard = _fold(v).select("file_id", "audio_language_code")
    return named.join(heard, "file_id", "left").select(
        "file_path", F.coalesce("audio_language_code", "folder_language").alias("content_language")
    )


def image_metadata(v):
    return _named(v).filter(F.col("media_type") == "photography").select("file_id", "file_path").join(
        images.image_columns(v.images, "file_id"), "file_id", "left"
    ).select("file_path", *images.IMAGE_COLUMNS)


# --- enrichment ---------------------------------------------------------------------
def _keys(v):
    # asked is no grouping column, so the filter stays above the parsing of names
    keyed = E.with_search_key(_named(v))
    keys = E.distinct_search_keys(keyed).columns
    return keyed.groupBy(*keys).agg(F.max("endpoint").alias("asked")).filter(F.col("asked") != "").drop("asked")


def enrich_gate(v):
    columns = ["file_path", "endpoint", "language", "title", "search_year"]
    listing = E.with_search_key(_named(v)).groupBy("file_path").agg(*[F.max(c).alias(c) for c in columns[1:]])
    # the paths are unique; as an aggregate the endpoint is filtered above the parsing of names
    return listing.filter(F.col("endpoint") != "").select(*columns)


def ref_details_parse(v):
    return E.parse_details(v.details).select(
        "endpoint", "language", "id", *E.detail_columns()
    )


def ref_details_odd(v):
    """Replies with fields of odd types: each costs its own column."""
    return E.parse_details(v.broken_details).filter(E.is_usable_reply()).select("endpoint", "language", "id", *E.detail_columns())


def enrich_details(v):
    named = _named(v)
    return E.enrich(named, E.lookup_of(named, v.search, v.broken_details)).select("file_path", *E.TMDB_COLUMNS)


# --- state ------------------------------------------------------------------------------
def incremental_split(v):
    listing = inventory.file_inventory(v.files)
    action = F.when(F.col("reuse") == 1, "reuse").otherwise("process")
    return state_ops.lookup(listing, v.state).select("file_path", action.alias("action"))


def incremental_catalog(v):
    """Two whole runs: the first is stored, the second sees moved and changed files."""
    moved, changed = F.col("file_id") % 11 == 0, F.col("file_id") % 7 == 0
    before = v.files.withColumns({
        "file_path": F.when(moved, F.concat(F.lit("gone/"), "file_path")).otherwise(F.col("file_path")),
        "size_bytes": F.col("size_bytes") + changed.cast("int"),
    })
    table = StateTable(v.spark, scratch_dir(v.spark, "incremental"))
    table.write_full(incremental_run(v.inputs.of(before), table.load(), AS_OF_YEAR, SCAN_TS, enrich=False).state, "run-1")
    run = incremental_run(v.inputs, table.load(), AS_OF_YEAR, LATER_TS, enrich=False)
    return run.catalog.select(
        "file_path", "size_bytes", "scanned_at_ts", "media_type", "audio_count", "quality_score", "processing_error"
    )


def incremental_enriched(v):
    """Two whole runs with titles over the whole row: what has got its details is kept, the rest is redone."""
    moved, changed = F.col("file_id") % 11 == 0, F.col("file_id") % 7 == 0
    before = v.files.withColumns({
        "file_path": F.when(moved, F.concat(F.lit("gone/"), "file_path")).otherwise(F.col("file_path")),
        "size_bytes": F.col("size_bytes") + changed.cast("int"),
    })
    table = StateTable(v.spark, scratch_dir(v.spark, "incremental-enriched"))
    save_run(incremental_run(v.inputs.of(before), table.load(), AS_OF_YEAR, SCAN_TS), table, "run-1", SCAN_TS)
    return incremental_run(v.inputs, table.load(), AS_OF_YEAR, LATER_TS).catalog


def run_stats_written(v):
    """The statistics that a second run's own writes have counted, as they stand in the JSON file."""
    root = scratch_dir(v.spark, "statistics")
    table = StateTable(v.spark, f"{root}/state")
    before = v.raw_listing.withColumn("size_bytes", F.col("size_bytes") + (F.col("file_id") % 7 == 0).cast("int"))
    save_run(incremental_run(v.inputs.of(before), table.load(), AS_OF_YEAR, SCAN_TS, enrich=False), table, "run-1", SCAN_TS)
    run = incremental_run(v.inputs.of(v.raw_listing), table.load(), AS_OF_YEAR, LATER_TS, enrich=False)
    save_run(run, table, "run-2", LATER_TS, f"{root}/errors", f"{root}/statistics")
    schema = "date string, total long, size_gb double, cache struct<hits long, misses long, rate double>, errors long"
    return v.spark.read.schema(schema).json(f"{root}/statistics").select("date", "total", "size_gb", "cache.*", "errors")


def export_changed(v):
    """A whole export, then a run that touches some media types: only these are written anew."""
    path = scratch_dir(v.spark, "export-changed")
    photo = F.col("file_path").rlike(r"(?i)\.jpg$")
    before = v.files.withColumn("size_bytes", F.col("size_bytes") + photo.cast("int"))
    table = StateTable(v.spark, scratch_dir(v.spark, "export-state"))
    save_run(incremental_run(v.inputs.of(before), table.load(), AS_OF_YEAR, SCAN_TS, enrich=False), table, "run-1", SCAN_TS)
    write_catalog_parquet(table.load().select("data.*"), path)
    run = incremental_run(v.inputs, table.load(), AS_OF_YEAR, LATER_TS, enrich=False)
    write_changed_parquet(run.catalog, run.touched, path)
    return v.spark.read.parquet(path).select("file_path", "size_bytes", "scanned_at_ts", "media_type", "quality_score")


# --- reports -------------------------------------------------------------------------------
def export_parquet(v):
    path = scratch_dir(v.spark, "export")
    write_catalog_parquet(_catalog(v), path)
    return v.spark.read.parquet(path).groupBy("media_type").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes")
    )


def _kept_reports(v):
    """Partials after three runs: each adds what it wrote and takes away what it replaced."""
    root = scratch_dir(v.spark, "reports")
    table = StateTable(v.spark, f"{root}/state")
    id_ = F.col("file_id")
    listings = [
        v.files.filter(id_ % 5 != 0).withColumn("size_bytes", F.col("size_bytes") + 1),
        v.files.filter(id_ % 4 != 0).withColumn("size_bytes", F.col("size_bytes") + (id_ % 3 == 0).cast("int")),
        v.files,
    ]
    for i, files in enumerate(listings):
        run = incremental_run(v.inputs.of(files), table.load(), AS_OF_YEAR, SCAN_TS, enrich=False)
        save_run(run, table, f"run-{i}", SCAN_TS)
        report_partials.change_of(stored_rows(run, table).select("data.*"), run.replaced.select("data.*")).write.parquet(f"{root}/partials/run={i}")
    return report_partials.merged(v.spark.read.parquet(f"{root}/partials").drop("run"))


def listing_changes(v):
    """A stored listing against the present one: what is new, changed and gone; nothing once it is brought up to date."""
    moved, changed = F.col("file_id") % 11 == 0, F.col("file_id") % 7 == 0
    now = conform(v.files, schemas.FILES)
    before = conform(v.files.withColumns({
        "file_path": F.when(moved, F.concat(F.lit("gone/"), "file_path")).otherwise(F.col("file_path")),
        "size_bytes": F.col("size_bytes") + changed.cast("int"),
    }), schemas.FILES)
    snapshot = StateTable(v.spark, scratch_dir(v.spark, "listing-changes"), schema=schemas.FILES)
    listing.keep_listing(listing.landed_changes(before, snapshot), snapshot, 0)
    snapshot.compact(fold=True)
    first = listing.landed_changes(now, snapshot)
    listing.keep_listing(first, snapshot, 1)
    second = listing.listing_changes(now, snapshot)
    return first.select(F.lit(1).alias("step"), "file_path", "size_bytes", "deleted").unionByName(
        second.select(F.lit(2).alias("step"), "file_path", "size_bytes", "deleted"))


def table_readers(v):
    """Images, tracks, search replies and details written as a user would land them, and read by the library's readers."""
    root = scratch_dir(v.spark, "readers")
    key = F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("file_path")
    v.images.select(key, "width", "height", "exif").write.parquet(f"{root}/images")
    v.tracks.select(key, *[c for c in v.tracks.columns if c != "file_id"]).write.options(**PACKED_JSON).json(f"{root}/tracks")
    v.search_replies.write.options(**PACKED_JSON).json(f"{root}/search")
    v.details.write.parquet(f"{root}/details")
    pictures = tables.read_images(v.spark, f"{root}/images")
    tracks = tables.read_tracks(v.spark, f"{root}/tracks", "json")
    search = tables.read_search(v.spark, f"{root}/search")
    details = tables.read_details(v.spark, f"{root}/details")
    facts = [
        ("images", F.col("width") + F.col("height"), pictures),
        ("tracks", F.col("track_order"), tracks),
        ("search", F.col("rank") * F.col("id"), search),
        ("details", F.length("json"), details),
    ]
    # the orders of a few million tracks add up to more than 64 bits hold
    rows = [
        df.agg(F.count("*").alias("rows"), F.sum(value.cast("decimal(38,0)")).cast("string").alias("total")).select(F.lit(name).alias("source"), "rows", "total")
        for name, value, df in facts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _fold_columns(*names):
    return lambda v: _fold(v).select("file_id", *names)


def _name_columns(*names):
    return lambda v: _named(v).select("file_path", *names)


_QUERIES = {
    # sources
    "file_inventory": lambda v: inventory.file_inventory(v.files.unionAll(v.files)).select(
        "file_path", "source_root", "size_bytes", N.iso_timestamp(F.col("mtime")).alias("mtime")),
    "filter_extensions": lambda v: inventory.filter_extensions(v.files).select("file_path"),
    "listing_changes": listing_changes,
    "read_tracks": read_tracks,
    "table_readers": table_readers,
    "image_metadata": image_metadata,
    "ref_search_explode": lambda v: v.search,
    "ref_details_parse": ref_details_parse,
    "ref_details_odd": ref_details_odd,
    "state_load": state_load,
    "stream_ingest": stream_ingest,
    "stream_catalog": stream_catalog,
    "stream_dead_letters": stream_dead_letters,
    "stream_listing": stream_listing,
    # sinks
    "csv_roundtrip": csv_roundtrip,
    "sanitize_newlines": sanitize_newlines,
    "state_upsert": state_upsert,
    "state_upsert_join": state_upsert_join,
    "csv_catalog": csv_catalog,
    "state_compaction": state_compaction,
    "errors_table": errors_table,
    "row_errors": row_errors,
    "run_stats": run_stats,
    "run_stats_written": run_stats_written,
    # names
    "path_parts": lambda v: v.files.select(
        "file_path", N.filename(_path()).alias("filename"), N.folder_name(_path()).alias("folder_name"),
        N.extension(N.filename(_path())).alias("extension"), N.filename(F.col("source_root")).alias("source_root")),
    "extract_year": lambda v: v.files.select("file_path", N.extract_year(N.filename(_path()), AS_OF_YEAR).alias("year")),
    "year_fallback": _name_columns("extracted_year"),
    "season_episode": _name_columns("season_number", "episode_number"),
    "clean_title": lambda v: v.files.select("file_path", N.clean_title(N.filename(_path())).alias("title")),
    "parsed_resolution": _name_columns("parsed_resolution"),
    "parsed_source": _name_columns("parsed_source"),
    "classify_media": _name_columns("media_type", "folder_language", "is_polish_production"),
    "size_units": _name_columns("size_bytes", "size_mb", "size_gb"),
    "is_series": lambda v: _named(v).select(
        "file_path", N.is_series(F.col("media_type"), F.col("season_number")).cast("int").alias("is_series")),
    "ts_format": lambda v: v.table("events").select("event_id", N.iso_timestamp(F.col("ts")).alias("ts_iso")),
    # track attributes
    "safe_float": safe_float,
    "safe_int": lambda v: v.tracks.select(
        *_TRACK, safe_int(F.col("width")).alias("width"), safe_int(F.col("height")).alias("height")),
    "light_level": lambda v: _kind(v, "Video").select(
        *_TRACK, A.light_level(F.col("maximum_content_light_level")).alias("max_cll"),
        A.light_level(F.col("mastering_display_luminance")).alias("luminance")),
    "delay_ms": lambda v: _kind(v, "Audio").select(
        *_TRACK, A.delay_ms(F.col("delay_relative_to_video")).alias("delay_ms"),
        A.whole_text(A.delay_ms(F.col("delay_relative_to_video"))).alias("delay_text")),
    "normalize_lang": lambda v: v.tracks.select(*_TRACK, A.normalize_lang(F.col("language")).alias("code")),
    "duration_fmt": _fold_columns("duration_sec", "duration_fmt"),
    "bitrate_kbps": bitrate_kbps,
    "is_4k": _fold_columns("is_4k"),
    "hdr_flags": _fold_columns("has_hdr", "has_dolby_vision"),
    "audio_tech_flags": _fold_columns("has_atmos", "has_dts_x", "has_lossless_audio"),
    # folds
    "fold_general": _fold_columns(*GENERAL_COLUMNS),
    "fold_video": _fold_columns(*VIDEO_COLUMNS),
    "fold_audio_lists": _fold_columns(*AUDIO_LIST_COLUMNS),
    "audio_counts": _fold_columns("audio_count", "is_multi_audio"),
    "main_audio": _fold_columns("audio_main_codec", "audio_main_channels", "audio_main_language", "audio_main_bitrate_kbps"),
    "audio_lang_flags": _fold_columns(*AUDIO_FLAGS),
    "fold_subtitles": _fold_columns(*SUBTITLE_COLUMNS),
    "subtitle_lang_flags": _fold_columns(*TEXT_FLAGS),
    "chapters": _fold_columns("has_chapters", "chapter_count"),
    "content_language": content_language,
    "quality_score": lambda v: _catalog(v, enrich=False).select("file_path", "quality_score", "processing_error"),
    # enrichment
    "enrich_gate": enrich_gate,
    "search_top1": lambda v: E.top_candidates(v.search).select(
        "endpoint", "language", "query", "year", F.col("best.id").alias("id")),
    "search_fallback": lambda v: E.resolve_ids(_keys(v), v.search),
    "enrich_details": enrich_details,
    # state
    "state_lookup": lambda v: state_ops.lookup(inventory.file_inventory(v.files), v.state).select("file_path", "hit", "reuse"),
    "state_table_lookup": state_table_lookup,
    "incremental_split": incremental_split,
    "incremental_catalog": incremental_catalog,
    "incremental_enriched": incremental_enriched,
    "state_prune": lambda v: state_ops.prune(v.state, v.files).select("file_path", "size_bytes", "tmdb_enriched"),
    "state_deleted": lambda v: state_ops.deleted(v.state, v.files),
    # whole catalogue
    "build_catalog": _catalog,
    "catalog_summary": lambda v: reports.catalog_summary(_named(v)),
    "quality_breakdown": lambda v: reports.quality_breakdown(_catalog(v, enrich=False)),
    "language_coverage": lambda v: reports.language_coverage(_catalog(v, enrich=False)),
    "summary_kept": lambda v: report_partials.summary(_kept_reports(v)),
    "quality_kept": lambda v: report_partials.quality(_kept_reports(v)),
    "coverage_kept": lambda v: report_partials.coverage(_kept_reports(v)),
    "export_parquet": export_parquet,
    "export_changed": export_changed,
}


def _bound(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(Views(configure(spark), sf_dir))

    return run


QUERIES = {name: _bound(query) for name, query in _QUERIES.items()}
