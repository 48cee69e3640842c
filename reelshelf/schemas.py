"""Explicit schemas of every table the engine reads or writes.

Column names and their order in CATALOG are fixed values: consumers of the
catalogue address them by name.
"""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "STRING_MAP": T.MapType(T.StringType(), T.StringType()),
    "INT_ARRAY": T.ArrayType(T.IntegerType()),
}


def _struct(columns: str, **nested: T.DataType) -> T.StructType:
    """A schema from 'name TYPE [NOT NULL], ...'. Unlike fromDDL it needs no running session."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, nested.get(kind) or _TYPES[kind], not rest))
    return T.StructType(fields)


FILES = _struct("""
    file_path STRING, source_root STRING, size_bytes BIGINT,
    mtime TIMESTAMP_NTZ, ctime TIMESTAMP_NTZ
""")

# One row per track, all attributes as text, as a probe tool reports them.
# (file_path, track_order) is unique; track_order counts a file's tracks.
TRACK_ATTRIBUTES = """
    format STRING, format_version STRING, writing_application STRING, encoded_date STRING,
    movie_name STRING, collection STRING, track_name STRING, performer STRING,
    description STRING, recorded_date STRING, part_id STRING, videoai STRING,
    errordetectiontype STRING, attachments STRING, unique_id STRING, duration STRING,
    overall_bit_rate STRING,
    format_profile STRING, writing_library STRING, encoding_settings STRING, width STRING,
    height STRING, display_aspect_ratio STRING, frame_rate STRING, bit_rate STRING,
    bit_rate_maximum STRING, source_duration STRING, time_code_of_first_frame STRING,
    bit_depth STRING, scan_type STRING, color_space STRING, hdr_format STRING,
    color_primaries STRING, transfer_characteristics STRING, matrix_coefficients STRING,
    mastering_display_color_primaries STRING, mastering_display_luminance STRING,
    maximum_content_light_level STRING, maximum_frameaverage_light_level STRING,
    language STRING, commercial_name STRING, channel_s STRING, channels STRING, title STRING,
    service_kind STRING, delay_relative_to_video STRING, compression_mode STRING,
    forced STRING, muxing_mode STRING, count_of_elements STRING,
    extra STRING_MAP
"""
TRACKS = _struct("file_path STRING, track_order BIGINT, track_type STRING, " + TRACK_ATTRIBUTES)

IMAGES = _struct("file_path STRING, width INT, height INT, exif STRING_MAP")

# One search reply per query; the results' order is the service's relevance and
# each hit has its own year, which a search with a year asks for.
REF_SEARCH_REPLIES = _struct("""
    endpoint STRING, language STRING, query STRING, results HITS
""", HITS=T.ArrayType(_struct("id BIGINT, year INT")))
REF_SEARCH = _struct("""
    endpoint STRING, language STRING, query STRING, year INT, rank INT, id BIGINT
""")
REF_DETAILS = _struct("endpoint STRING, language STRING, id BIGINT, json STRING")

ERRORS = _struct("file STRING, path STRING, error STRING, stage STRING, time STRING")

CATALOG = _struct("""
    file_path STRING NOT NULL, filename STRING NOT NULL, folder_name STRING NOT NULL,
    extension STRING NOT NULL, source_root STRING NOT NULL, media_type STRING NOT NULL,
    content_language STRING NOT NULL,

    size_bytes BIGINT NOT NULL, size_mb DOUBLE NOT NULL, size_gb DOUBLE NOT NULL,
    created_at_ts STRING, modified_at_ts STRING NOT NULL, scanned_at_ts STRING NOT NULL,

    extracted_year INT, extracted_title STRING, season_number INT, episode_number INT,
    parsed_resolution STRING, parsed_source STRING,

    collection_name STRING, track_name STRING, performer STRING, content_description STRING,
    recorded_date STRING, part_id INT,

    duration_sec DOUBLE, duration_fmt STRING, video_codec STRING, video_profile STRING,
    video_resolution STRING, width INT, height INT, aspect_ratio STRING, frame_rate DOUBLE,
    video_bitrate_kbps DOUBLE, video_bit_rate_max_kbps DOUBLE, video_bit_depth INT,
    scan_type STRING, color_space STRING, source_duration_sec DOUBLE,
    timecode_first_frame STRING,

    hdr_format_commercial STRING, color_primaries STRING, transfer_characteristics STRING,
    matrix_coefficients STRING, mastering_display_primaries STRING,
    mastering_display_luminance STRING, max_content_light_level INT,
    max_frame_avg_light_level INT,

    audio_main_codec STRING, audio_main_channels STRING, audio_main_language STRING,
    audio_main_bitrate_kbps DOUBLE, audio_count INT NOT NULL, audio_languages_list STRING,
    audio_formats STRING, audio_commercial_names STRING, audio_bitrates STRING,
    audio_channels_list STRING, audio_titles STRING, audio_service_kinds STRING,
    audio_delays_ms STRING,

    subtitle_count INT NOT NULL, subtitle_languages_list STRING, subtitle_formats STRING,
    subtitle_titles STRING, subtitle_event_counts STRING, subtitle_muxing_modes STRING,
    subtitle_forced_count INT NOT NULL,

    container_format STRING, format_version STRING, overall_bitrate_kbps DOUBLE,
    matroska_unique_id STRING, movie_name STRING, error_detection_type STRING,
    has_attachments INT NOT NULL, attachment_list STRING, writing_library STRING,
    writing_application STRING, encoding_settings STRING, encoded_date STRING,

    ai_enhanced INT NOT NULL, ai_processing_info STRING, has_chapters INT NOT NULL,
    chapter_count INT NOT NULL,

    image_width INT, image_height INT, image_megapixels DOUBLE, camera_make STRING,
    camera_model STRING, date_taken STRING,

    tmdb_id BIGINT, tmdb_title STRING, tmdb_original_title STRING, tmdb_rating DOUBLE,
    tmdb_vote_count BIGINT, tmdb_genres STRING, tmdb_release_date STRING, tmdb_overview STRING,
    tmdb_runtime INT, tmdb_production_countries STRING, tmdb_poster_path STRING,

    is_4k INT NOT NULL, has_hdr INT NOT NULL, has_dolby_vision INT NOT NULL,
    has_atmos INT NOT NULL, has_dts_x INT NOT NULL, has_lossless_audio INT NOT NULL,

    has_polish_audio INT NOT NULL, has_english_audio INT NOT NULL, has_czech_audio INT NOT NULL,
    has_spanish_audio INT NOT NULL, has_german_audio INT NOT NULL,
    has_french_audio INT NOT NULL, has_italian_audio INT NOT NULL,

    has_polish_subtitles INT NOT NULL, has_english_subtitles INT NOT NULL,
    has_czech_subtitles INT NOT NULL, has_spanish_subtitles INT NOT NULL,
    has_german_subtitles INT NOT NULL, has_french_subtitles INT NOT NULL,
    has_italian_subtitles INT NOT NULL,

    is_polish_production INT NOT NULL, is_multi_audio INT NOT NULL,
    has_subtitles INT NOT NULL, has_ai_upscaling INT NOT NULL, has_cover_art INT NOT NULL,

    quality_score DOUBLE, processing_error STRING, tmdb_enriched INT NOT NULL
""")

# What the state table stores per file: the lookup key and the row.
STATE = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("mtime", T.TimestampNTZType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("tmdb_enriched", T.IntegerType()),
    T.StructField("data", T.StructType([
        T.StructField(f.name, f.dataType, True) for f in CATALOG.fields
    ])),
])
