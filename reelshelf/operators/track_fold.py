"""Tracks -> one technical row per file.

Two levels of aggregation:

1. per (file, chunk), where a chunk is a run of consecutive tracks. A file with
   an ordinary number of tracks has one chunk; a file that holds a third of all
   tracks has many, so its work spreads over many tasks. Lists leave this level
   already ordered and joined to one string per chunk.
2. per file, over one narrow row per chunk. The last task of a hot file thus
   handles its output cells plus one row per chunk, never its single tracks.

Flags fold as bits of one int per kind (``bit_or``), "last value wins" folds as
the maximum of a struct led by the track order (a NULL inside the struct
survives, as the last track's missing value must), so both combine before the
shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelshelf.functions import attributes as A
from reelshelf.functions import fixed_values as V
from reelshelf.functions.numbers import exact_round, parse_float, safe_int, thousandth, truthy_text

CHUNK_BITS = 12  # 4096 consecutive tracks per chunk

# Attribute of the last General / Video track, missing value included: column -> attribute.
GENERAL_LAST = {
    "container_format": "format",
    "format_version": "format_version",
    "writing_application": "writing_application",
    "encoded_date": "encoded_date",
    "movie_name": "movie_name",
    "collection_name": "collection",
    "track_name": "track_name",
    "performer": "performer",
    "content_description": "description",
    "recorded_date": "recorded_date",
    "part_id": "part_id",
    "error_detection_type": "errordetectiontype",
}
VIDEO_LAST = {
    "video_codec": "format",
    "video_profile": "format_profile",
    "writing_library": "writing_library",
    "frame_rate": "frame_rate",
    "timecode_first_frame": "time_code_of_first_frame",
    "video_bit_depth": "bit_depth",
    "scan_type": "scan_type",
    "color_space": "color_space",
    "hdr_format_commercial": "hdr_format",
    "color_primaries": "color_primaries",
    "transfer_characteristics": "transfer_characteristics",
    "matrix_coefficients": "matrix_coefficients",
    "mastering_display_primaries": "mastering_display_color_primaries",
}
# Last non-empty text over the tracks of that kind: column -> attribute.
GENERAL_LAST_TRUTHY = {
    "ai_processing_info": "videoai",
    "attachment_list": "attachments",
    "matroska_unique_id": "unique_id",
}
VIDEO_LAST_TRUTHY = {
    "encoding_settings": "encoding_settings",
    "aspect_ratio": "display_aspect_ratio",
    "mastering_display_luminance": "mastering_display_luminance",
    "max_content_light_level": "maximum_content_light_level",
    "max_frame_avg_light_level": "maximum_frameaverage_light_level",
}
# Last usable number, in thousands: column -> attribute.
GENERAL_LAST_NUMBER = {"duration_sec": "duration", "overall_bitrate_kbps": "overall_bit_rate"}
VIDEO_LAST_NUMBER = {
    "video_bitrate_kbps": "bit_rate",
    "video_bit_rate_max_kbps": "bit_rate_maximum",
    "source_duration_sec": "source_duration",
}
# Output list -> field of the per-track list entry.
AUDIO_LISTS = {
    "audio_formats": "format",
    "audio_commercial_names": "commercial_name",
    "audio_bitrates": "kbps_text",
    "audio_channels_list": "channels_text",
    "audio_titles": "title",
    "audio_service_kinds": "service_kind",
    "audio_delays_ms": "delay_text",
}
TEXT_LISTS = {
    "subtitle_formats": "format",
    "subtitle_titles": "title",
    "subtitle_event_counts": "count_of_elements",
    "subtitle_muxing_modes": "muxing_mode",
}
# Sticky flags and their bit.
FLAG_BITS = [
    "is_4k", "has_hdr", "has_dolby_vision", "has_atmos", "has_dts_x", "has_lossless_audio", "has_chapters",
]
AUDIO_FLAGS = [f"has_{word}_audio" for _, word, _, _ in V.LANGUAGE_RULES]
TEXT_FLAGS = [f"has_{word}_subtitles" for _, word, _, _ in V.LANGUAGE_RULES]


def _c(name: str) -> Column:
    return F.col(name)


def _bit(flag: str, condition: Column) -> Column:
    return F.when(condition, F.lit(1 << FLAG_BITS.index(flag))).otherwise(F.lit(0))


# Attributes that are numbers in text; each is parsed, then rounded, once per track.
_FLOATS = ["frame_rate", *GENERAL_LAST_NUMBER.values(), *VIDEO_LAST_NUMBER.values()]
_INTS = ["width", "height", "bit_depth", "part_id"]


def _with_numbers(tracks: DataFrame, chunk: Column) -> DataFrame:
    """Numeric attributes as numbers. Two selects: the rounding reads plain columns."""
    parsers = {**dict.fromkeys(_FLOATS, parse_float), **dict.fromkeys(_INTS, safe_int)}
    parsed = tracks.select(
        chunk.alias("chunk"),
        *[parsers[c](F.col(c)).alias(c) if c in parsers else c for c in tracks.columns],
    )
    return parsed.select(
        "chunk", *[exact_round(F.col(c), 2).alias(c) if c in _FLOATS else c for c in tracks.columns]
    )


def _track_facts(tracks: DataFrame, key: str, chunk: Column) -> DataFrame:
    """One narrow row per track: what it contributes to each aggregate."""
    tracks = _with_numbers(tracks, chunk)
    order = _c("track_order")
    kind = _c("track_type")
    general, video, audio, text = (kind == k for k in ("General", "Video", "Audio", "Text"))

    def placed(condition: Column, **fields: Column) -> Column:
        return F.when(
            condition, F.struct(order.alias("o"), *[v.alias(k) for k, v in fields.items()])
        )

    def last_of(condition, mapping):
        return placed(condition, **{out: _c(attribute) for out, attribute in mapping.items()})

    width, height, depth = _c("width"), _c("height"), _c("bit_depth")
    bits = (
        F.when(
            video,
            _bit("is_4k", A.is_4k(width, height))
            .bitwiseOR(_bit("has_hdr", A.is_hdr(_c("hdr_format"), depth)))
            .bitwiseOR(_bit("has_dolby_vision", A.is_dolby_vision(_c("hdr_format")))),
        )
        .when(
            audio,
            _bit("has_atmos", A.is_atmos(_c("commercial_name")))
            .bitwiseOR(_bit("has_dts_x", A.is_dts_x(_c("commercial_name"))))
            .bitwiseOR(_bit("has_lossless_audio", A.is_lossless(_c("compression_mode"), _c("format")))),
        )
        .when(kind == "Menu", F.lit(1 << FLAG_BITS.index("has_chapters")))
        .otherwise(F.lit(0))
    )
    channels = A.channel_text(_c("channel_s"), _c("channels"))
    bit_rate = _c("bit_rate")
    columns = [
        _c(key), _c("chunk"), order.alias("track_order"), kind.alias("track_type"),
        bits.alias("bits"),
        F.when(audio, A.language_bit(_c("language"))).otherwise(F.lit(0)).alias("audio_bits"),
        F.when(text, A.language_bit(_c("language"))).otherwise(F.lit(0)).alias("text_bits"),
        F.when(text & (F.lower(_c("forced")) == "yes"), F.lit(1)).otherwise(F.lit(0)).alias("forced"),
        last_of(general, GENERAL_LAST).alias("general_last"),
        last_of(video, VIDEO_LAST).alias("video_last"),
        placed(video & (width != 0) & (height != 0), width=width, height=height).alias("frame"),
        placed(
            (kind == "Menu") & _c("extra").isNotNull(), chapter_count=A.chapter_count(_c("extra"))
        ).alias("chapters"),
        F.when(
            audio,
            F.struct(
                order.alias("o"),
                truthy_text(_c("language")).alias("language"),
                truthy_text(_c("format")).alias("format"),
                truthy_text(_c("commercial_name")).alias("commercial_name"),
                F.when(bit_rate != 0, A.whole_text(bit_rate / F.lit(1000.0))).alias("kbps_text"),
                F.concat(channels, F.lit("ch")).alias("channels_text"),
                truthy_text(_c("title")).alias("title"),
                truthy_text(_c("service_kind")).alias("service_kind"),
                A.whole_text(A.delay_ms(_c("delay_relative_to_video"))).alias("delay_text"),
            ),
        ).alias("audio_entry"),
        placed(
            audio,
            audio_main_codec=_c("format"),
            audio_main_channels=channels,
            audio_main_language=_c("language"),
            audio_main_bitrate=_c("bit_rate"),
        ).alias("main_audio"),
        F.when(
            text,
            F.struct(
                order.alias("o"),
                truthy_text(_c("language")).alias("language"),
                *[truthy_text(_c(a)).alias(a) for a in TEXT_LISTS.values()],
            ),
        ).alias("text_entry"),
    ]
    for condition, mapping in ((general, GENERAL_LAST_TRUTHY), (video, VIDEO_LAST_TRUTHY)):
        columns += [
            placed(condition & (_c(attribute) != ""), v=_c(attribute)).alias(out)
            for out, attribute in mapping.items()
        ]
    for condition, mapping in ((general, GENERAL_LAST_NUMBER), (video, VIDEO_LAST_NUMBER)):
        columns += [
            placed(condition & (_c(attribute) != 0), v=_c(attribute)).alias(out)
            for out, attribute in mapping.items()
        ]
    return tracks.select(*columns)


# The greatest one counts, on both levels.
_MAXED = (
    ["general_last", "video_last", "frame", "chapters"]
    + list(GENERAL_LAST_TRUTHY) + list(VIDEO_LAST_TRUTHY)
    + list(GENERAL_LAST_NUMBER) + list(VIDEO_LAST_NUMBER)
)


def _flags_on_both_levels():
    return [F.bit_or(c).alias(c) for c in ("bits", "audio_bits", "text_bits")]


def _joined(entries: Column, field: str) -> Column:
    """Comma list of one field over ordered entries; missing ones leave no gap."""
    return truthy_text(F.concat_ws(",", F.transform(entries, lambda e: e[field])))


def _chunk_lists(entries: Column, lists: dict, languages: str) -> list[Column]:
    seen = F.transform(entries, lambda e: e["language"])
    return [_joined(entries, field).alias(out) for out, field in lists.items()] + [
        F.array_distinct(F.array_compact(seen)).alias(languages)
    ]


def chunk_of(chunk: Column | None) -> Column:
    """The given chunk, or by default runs of 2^CHUNK_BITS tracks; tracks without an order come first."""
    given = F.shiftright("track_order", CHUNK_BITS) if chunk is None else chunk
    return F.coalesce(given, F.lit(-(1 << 63)))


# What the fold reads of each kind of track.
_USED = {
    "General": {*GENERAL_LAST.values(), *GENERAL_LAST_TRUTHY.values(), *GENERAL_LAST_NUMBER.values()},
    "Video": {*VIDEO_LAST.values(), *VIDEO_LAST_TRUTHY.values(), *VIDEO_LAST_NUMBER.values(), "width", "height"},
    "Audio": {
        "language", "format", "commercial_name", "bit_rate", "channel_s", "channels", "title", "service_kind",
        "delay_relative_to_video", "compression_mode",
    },
    "Text": {"language", "forced", *TEXT_LISTS.values()},
    "Menu": {"extra"},
}


def used_attributes(tracks: DataFrame, key: str) -> DataFrame:
    """Tracks without what the fold doesn't read of their kind: the other attributes are NULL, and cost no shuffle."""
    def kept(name: str) -> Column:
        kinds = [kind for kind, used in _USED.items() if name in used]
        return F.when(F.col("track_type").isin(kinds), F.col(name)).alias(name)

    return tracks.select(*[c if c in (key, "track_order", "track_type") else kept(c) for c in tracks.columns])


def _places(tracks: DataFrame, key: str) -> dict[str, list[str]]:
    """The texts that the fold reads of each kind of track, in the order in which a move takes them."""
    texts = [f.name for f in tracks.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (key, "track_type")]
    return {kind: [c for c in texts if c in used] for kind, used in _USED.items()}


def _packed(tracks: DataFrame, key: str) -> DataFrame:
    """The used texts of each track as one JSON list, for a move: a wide row of mostly absent texts takes near twice as much."""
    lists = " ".join(f"WHEN '{kind}' THEN array({', '.join(f'`{c}`' for c in texts)})" for kind, texts in _places(tracks, key).items() if texts)
    others = [f.name for f in tracks.schema.fields if f.name in (key, "track_type") or not isinstance(f.dataType, T.StringType)]
    return tracks.select(*others, F.expr(f"to_json(CASE track_type {lists} END) AS _texts"))


def _unpacked(packed: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """The columns of ``tracks`` again; texts that the fold doesn't read of a kind are NULL."""
    places = _places(tracks, key)

    def text(column: str) -> str:
        found = [f"WHEN '{kind}' THEN get(_texts, {texts.index(column)})" for kind, texts in places.items() if column in texts]
        return f"CASE track_type {' '.join(found)} END AS `{column}`" if found else f"CAST(NULL AS string) AS `{column}`"

    read = packed.withColumn("_texts", F.from_json("_texts", "array<string>", {"mode": "FAILFAST"}))
    return read.selectExpr(*[f"`{c}`" if c in packed.columns else text(c) for c in tracks.columns])


def tracks_of_files(tracks: DataFrame, files: DataFrame, key: str, chunk: Column | None = None) -> DataFrame:
    """What the fold reads of some files' tracks, laid out by file and chunk.

    The join by file is on the narrow (file, chunk) pairs. The wide tracks move once, by
    file and chunk, which is the fold's layout; by file alone all tracks of one file would meet in one task.
    """
    pairs = tracks.select(F.col(key).alias("_file"), chunk_of(chunk).alias("_chunk")).distinct()
    wanted = pairs.join(files.select(F.col(key).alias("_file")), "_file", "left_semi")
    same = (F.col(key) == F.col("_file")) & (chunk_of(chunk) == F.col("_chunk"))
    return used_attributes(tracks, key).join(wanted, same, "left_semi")


def fold_tracks(tracks: DataFrame, key: str = "file_path", chunk: Column | None = None) -> DataFrame:
    """Fold a TRACKS table to one row per ``key`` with all technical columns.

    ``chunk`` must not decrease with track_order. The default cuts a file into
    runs of 2^CHUNK_BITS, given that track_order counts the file's tracks.
    """
    return _per_file(_per_chunk(tracks, key, chunk_of(chunk)), key)


def fold_by_file(tracks: DataFrame, key: str = "file_path", chunk: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """As fold_tracks, with wide rows that move once; where ``files`` are given, of their tracks alone.

    Tracks of chunk 0, all that most files have, move by file: they are one chunk a file, so a hot file
    brings no more of them into a task than any chunk. Later chunks move by file and chunk. Where there are none,
    Spark finds that side of the union empty, and the second level needs no further move.
    """
    lead = chunk_of(chunk) == 0
    first, later = used_attributes(tracks.filter(lead), key), tracks.filter(~lead)
    first = _packed(first, key)
    if files is None:
        later = used_attributes(later, key)
    else:
        # an inner join with distinct files, as a semi join would go below a union of tracks and move them twice
        first = first.join(files.select(key).distinct(), key)
        later = tracks_of_files(later, files, key, chunk)
    # no move after a join that has laid them out by file, the one move otherwise; nothing is combined, and so sorted, before it.
    # Sorted while packed: both levels of the fold and the joins by file take the rows as they come.
    first = _unpacked(first.repartition(key).sortWithinPartitions(key), tracks, key)
    # The second sort finds its rows sorted and costs nothing; without it Spark doesn't see so in time.
    return _per_file(_per_chunk(first, key).sortWithinPartitions(key).unionByName(_per_chunk(later, key, chunk_of(chunk))), key)


def _per_chunk(tracks: DataFrame, key: str, chunk: Column | None = None) -> DataFrame:
    """One row per file and chunk; without a chunk all tracks are of chunk 0, and go by file alone."""
    number = F.lit(0).cast("bigint").alias("chunk")
    facts = _track_facts(tracks, key, number if chunk is None else chunk)
    return (
        facts.groupBy(*([key] if chunk is None else [key, "chunk"]))
        .agg(
            *[F.max(c).alias(c) for c in _MAXED], F.min("main_audio").alias("main_audio"), *_flags_on_both_levels(),
            F.count_if(F.col("track_type") == "Audio").alias("audio_count"),
            F.count_if(F.col("track_type") == "Text").alias("subtitle_count"),
            F.sum("forced").alias("subtitle_forced_count"),
            F.sort_array(F.collect_list("audio_entry")).alias("audio_entries"),
            F.sort_array(F.collect_list("text_entry")).alias("text_entries"),
        )
        .select(
            key, *_MAXED, "main_audio", "bits", "audio_bits", "text_bits",
            "audio_count", "subtitle_count", "subtitle_forced_count",
            F.struct(
                number if chunk is None else "chunk",
                *_chunk_lists(F.col("audio_entries"), AUDIO_LISTS, "audio_languages"),
                *_chunk_lists(F.col("text_entries"), TEXT_LISTS, "subtitle_languages"),
            ).alias("lists"),
        )
    )


def _per_file(per_chunk: DataFrame, key: str) -> DataFrame:
    """One row per file. Most files have one chunk: its row is gathered whole, which takes less than a comparison by column."""
    gathered = [*_MAXED, "main_audio", "lists"]
    chunks = per_chunk.groupBy(key).agg(
        *_flags_on_both_levels(),
        *[F.sum(c).cast("int").alias(c) for c in ("audio_count", "subtitle_count", "subtitle_forced_count")],
        F.collect_list(F.struct(*gathered)).alias("rows"),
    )
    narrow = [c for c in chunks.columns if c != "rows"]
    per_file = chunks.select(
        *narrow, *[F.array_max(F.col("rows")[c]).alias(c) for c in _MAXED],
        F.array_min(F.col("rows")["main_audio"]).alias("main_audio"), F.sort_array(F.col("rows")["lists"]).alias("lists"),
    )
    # The costly parts first, then what reads them: the rounding and the duration text.
    values = per_file.select(key, *_output_columns())
    thousands = [*GENERAL_LAST_NUMBER, *VIDEO_LAST_NUMBER, "audio_main_bitrate_kbps"]
    rounded = values.select(
        *[thousandth(F.col(c)).alias(c) if c in thousands else c for c in values.columns]
    )
    return rounded.select("*", A.duration_fmt(F.col("duration_sec")).alias("duration_fmt"))


def _output_columns() -> list[Column]:
    lists = F.col("lists")

    def languages(field):
        per_chunk = F.transform(lists, lambda e: e[field])
        return truthy_text(F.concat_ws(",", F.array_distinct(F.flatten(per_chunk))))

    def flags(bits, names):
        return [F.getbit(F.col(bits), F.lit(i)).cast("int").alias(n) for i, n in enumerate(names)]

    light = {"max_content_light_level", "max_frame_avg_light_level"}
    capped = {"ai_processing_info": V.AI_INFO_MAX_CHARS, "encoding_settings": V.ENCODER_SETTINGS_MAX_CHARS}

    out = []
    for source, mapping in (("general_last", GENERAL_LAST), ("video_last", VIDEO_LAST)):
        out += [F.col(source)[name].alias(name) for name in mapping]
    for name in [*GENERAL_LAST_TRUTHY, *VIDEO_LAST_TRUTHY]:
        value = F.col(name)["v"]
        if name in light:
            value = A.light_level(value)
        elif name in capped:
            value = F.substring(value, 1, capped[name])
        out.append(value.alias(name))
    out += [F.col(name)["v"].alias(name) for name in [*GENERAL_LAST_NUMBER, *VIDEO_LAST_NUMBER]]
    frame, main = F.col("frame"), F.col("main_audio")
    out += [
        frame["width"].alias("width"),
        frame["height"].alias("height"),
        F.concat(frame["width"].cast("string"), F.lit("x"), frame["height"].cast("string")).alias("video_resolution"),
        main["audio_main_codec"].alias("audio_main_codec"),
        main["audio_main_channels"].alias("audio_main_channels"),
        main["audio_main_language"].alias("audio_main_language"),
        main["audio_main_bitrate"].alias("audio_main_bitrate_kbps"),
        F.col("audio_count"), F.col("subtitle_count"), F.col("subtitle_forced_count"),
        languages("audio_languages").alias("audio_languages_list"),
        languages("subtitle_languages").alias("subtitle_languages_list"),
        *[_joined(lists, name).alias(name) for name in [*AUDIO_LISTS, *TEXT_LISTS]],
        *flags("bits", FLAG_BITS), *flags("audio_bits", AUDIO_FLAGS), *flags("text_bits", TEXT_FLAGS),
        F.coalesce(F.col("chapters")["chapter_count"], F.lit(0)).alias("chapter_count"),
        (F.col("audio_count") > 1).cast("int").alias("is_multi_audio"),
        (F.col("subtitle_count") > 0).cast("int").alias("has_subtitles"),
        *[F.col("ai_processing_info").isNotNull().cast("int").alias(n) for n in ("ai_enhanced", "has_ai_upscaling")],
        *[F.col("attachment_list").isNotNull().cast("int").alias(n) for n in ("has_attachments", "has_cover_art")],
        _audio_language_code(F.col("audio_bits")).alias("audio_language_code"),
    ]
    return out


def _audio_language_code(bits: Column) -> Column:
    """The one language heard, 'mixed' for several, NULL for none."""
    chain = F.when(F.bit_count(bits) > 1, F.lit("mixed"))
    for i, (code, *_) in enumerate(V.LANGUAGE_RULES):
        chain = chain.when(bits == (1 << i), F.lit(code))
    return chain


# Every column the fold yields, besides its key.
FOLDED_COLUMNS = (
    [*GENERAL_LAST, *VIDEO_LAST, *GENERAL_LAST_TRUTHY, *VIDEO_LAST_TRUTHY, *GENERAL_LAST_NUMBER,
     *VIDEO_LAST_NUMBER, "duration_fmt", "width", "height", "video_resolution", "audio_main_codec",
     "audio_main_channels", "audio_main_language", "audio_main_bitrate_kbps", "audio_count",
     "subtitle_count", "subtitle_forced_count", "audio_languages_list", "subtitle_languages_list",
     *AUDIO_LISTS, *TEXT_LISTS, *FLAG_BITS, *AUDIO_FLAGS, *TEXT_FLAGS, "chapter_count",
     "is_multi_audio", "has_subtitles", "ai_enhanced", "has_ai_upscaling", "has_attachments",
     "has_cover_art"]
)
