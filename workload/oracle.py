"""The same results in DuckDB SQL, written from the semantics, not from the plans.

``printf('%.2f')`` rounds half-even on the exact binary value, which is what the
engine's ``exact_round`` promises. RE2 has no lookahead, so 'hd(?!tv)' is spelled out.
"""

from workload import views as W

# Languages, folder rules, extensions and patterns as the catalogue's results need them.
_LANGS = [("pl", "polish"), ("en", "english"), ("cs", "czech"), ("es", "spanish"), ("de", "german"), ("fr", "french"), ("it", "italian")]
_FOLDERS = [
    ("christmas", "christmas", "mixed"), ("concert", "concert", "mixed"), ("docu", "documentary", "mixed"),
    ("fun", "fun", "mixed"), ("kids movies", "kids_movie", "mixed"), ("kids series", "kids_series", "mixed"),
    ("movies", "movie", "en"), ("movies extras", "movie_extra", "mixed"), ("movies pl", "movie_pl", "pl"),
    ("music", "music", "mixed"), ("music clips", "music_clip", "mixed"), ("photography", "photography", "unknown"),
    ("religious", "religious", "mixed"), ("others", "mixed", "mixed"), ("series", "series", "en"),
    ("series original", "series_original", "original"), ("series polish", "series_pl", "pl"),
    ("theater", "theater", "mixed"), ("tato", "movie", "en"),
]
_ALLOWED = (
    "'.mp4','.mkv','.avi','.wmv','.ts','.m4v','.mov','.m2ts','.webm','.ogv','.flv','.vob','.iso','.bdmv',"
    "'.flac','.mp3','.m4a','.wav','.aac','.ogg','.wma',"
    "'.jpg','.jpeg','.png','.tif','.tiff','.raw','.cr2','.nef','.arw','.dng'"
)
_SE = r"(?i)(?:s(\d{1,2})e(\d{1,3}))|(?:(\d{1,2})x(\d{1,3}))"
_NOISE = r"(?i)\b(1080p|720p|4k|2160p|bluray|bdrip|brrip|remux|web-?dl|x264|x265|hevc|h264|h265|aac|ac3|dts|pl|lektor|dubbing|dub|subbed)\b"
_YEAR = r"\b(19[2-9]\d|20[0-2]\d)\b"


def _round(x, digits):
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def _iso(ts):
    return f"CASE WHEN date_part('microsecond', {ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END"


def _float(text):
    return _round(f"(CASE WHEN regexp_full_match(trim({text}), '[-+]?[0-9]+([.][0-9]*)?') THEN TRY_CAST({text} AS DOUBLE) END)", 2)


def _int(text):
    return f"(CASE WHEN regexp_full_match(trim({text}), '[-+]?[0-9]+') THEN TRY_CAST(trim({text}) AS INTEGER) END)"


def _light(text):
    return f"TRY_CAST(nullif(regexp_extract({text}, '([0-9]+)\\s*cd/m[²2]', 1), '') AS INTEGER)"


def _delay(text):
    return f"TRY_CAST(nullif(regexp_extract({text}, '([-+]?[0-9]+([.][0-9]+)?)\\s*ms', 1), '') AS DOUBLE)"


def _lang(text):
    low = f"lower({text})"
    marks = {"pl": ["pol"], "en": ["eng"], "cs": ["cze"], "es": ["spa"], "de": ["ger"], "fr": ["fre", "fra"], "it": ["ita"]}
    arms = " ".join(
        f"WHEN starts_with({low}, '{c}')" + "".join(f" OR contains({low}, '{m}')" for m in ms) + f" THEN '{c}'"
        for c, ms in marks.items()
    )
    return f"(CASE {arms} END)"


def _years(text):
    return (
        f"list_filter(list_transform(regexp_extract_all({text}, '{_YEAR}', 1), lambda y: CAST(y AS INTEGER)),"
        f" lambda y: y <= {W.AS_OF_YEAR + 2})[-1]"
    )


def _title(name):
    t = f"regexp_replace({name}, '^([.]*[^.].*)[.][^.]*$', '\\1')"
    for pattern, to in [(_YEAR, ""), (_SE, ""), (_NOISE, ""), ("[._-]+", " "), (r"\[[^\n]*?\]|\([^\n]*?\)", ""), (r"\s+", " ")]:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"trim({t})"


_EXT = "lower(regexp_extract({n}, '^[.]*[^.].*([.][^.]*)$', 1))"
_NAME = "regexp_extract({p}, '[^/]*$')"

_folder_arms = " ".join(
    f"WHEN list_contains(parts, '{k}') THEN struct_pack(t := '{t}', l := '{lang}')" for k, t, lang in _FOLDERS
)
_last = lambda kind, fields: (
    "arg_max(struct_pack(" + ", ".join(f"{o} := {a}" for o, a in fields.items())
    + f"), track_order) FILTER (WHERE track_type = '{kind}')"
)
_GENERAL = {
    "container_format": "format", "format_version": "format_version", "writing_application": "writing_application",
    "encoded_date": "encoded_date", "movie_name": "movie_name", "collection_name": "collection", "track_name": "track_name",
    "performer": "performer", "content_description": "description", "recorded_date": "recorded_date",
    "part_id": _int("part_id"), "error_detection_type": "errordetectiontype",
}
_VIDEO = {
    "video_codec": "format", "video_profile": "format_profile", "writing_library": "writing_library",
    "frame_rate": _float("frame_rate"), "timecode_first_frame": "time_code_of_first_frame", "video_bit_depth": _int("bit_depth"),
    "scan_type": "scan_type", "color_space": "color_space", "hdr_format_commercial": "hdr_format",
    "color_primaries": "color_primaries", "transfer_characteristics": "transfer_characteristics",
    "matrix_coefficients": "matrix_coefficients", "mastering_display_primaries": "mastering_display_color_primaries",
}
_TEXT_TRUTHY = {
    "ai_processing_info": ("General", "videoai"), "attachment_list": ("General", "attachments"),
    "matroska_unique_id": ("General", "unique_id"), "encoding_settings": ("Video", "encoding_settings"),
    "aspect_ratio": ("Video", "display_aspect_ratio"), "mastering_display_luminance": ("Video", "mastering_display_luminance"),
    "cll": ("Video", "maximum_content_light_level"), "fall": ("Video", "maximum_frameaverage_light_level"),
}
_NUMBERS = {
    "duration_sec": ("General", "duration"), "overall_bitrate_kbps": ("General", "overall_bit_rate"),
    "video_bitrate_kbps": ("Video", "bit_rate"), "video_bit_rate_max_kbps": ("Video", "bit_rate_maximum"),
    "source_duration_sec": ("Video", "source_duration"),
}
_CH = "coalesce(nullif(channel_s, ''), channels)"
_ALISTS = {
    "audio_formats": "nullif(format, '')", "audio_commercial_names": "nullif(commercial_name, '')",
    "audio_bitrates": f"CASE WHEN {_float('bit_rate')} <> 0 THEN CAST(CAST(trunc({_float('bit_rate')} / 1000) AS BIGINT) AS VARCHAR) END",
    "audio_channels_list": f"{_CH} || 'ch'", "audio_titles": "title", "audio_service_kinds": "service_kind",
    "audio_delays_ms": f"CAST(CAST(trunc({_delay('delay_relative_to_video')}) AS BIGINT) AS VARCHAR)",
}
_TLISTS = {
    "subtitle_formats": "nullif(format, '')", "subtitle_titles": "title", "subtitle_event_counts": "count_of_elements",
    "subtitle_muxing_modes": "muxing_mode",
}


def _joined(kind, expr):
    return f"nullif(array_to_string(list({expr} ORDER BY track_order) FILTER (WHERE track_type = '{kind}' AND ({expr}) IS NOT NULL), ','), '')"


def _any(kind, condition):
    return f"CAST(coalesce(max(CASE WHEN track_type = '{kind}' AND ({condition}) THEN 1 ELSE 0 END), 0) AS INTEGER)"


_W, _H = _int("width"), _int("height")
_fold_sql = ",\n  ".join(
    ["file_id", f"{_last('General', _GENERAL)} AS g", f"{_last('Video', _VIDEO)} AS v"]
    + [f"arg_max({a}, track_order) FILTER (WHERE track_type = '{k}' AND {a} <> '') AS {o}" for o, (k, a) in _TEXT_TRUTHY.items()]
    + [f"{_round(f'(arg_max({_float(a)}, track_order) FILTER (WHERE track_type = {chr(39)}{k}{chr(39)} AND {_float(a)} <> 0)) / 1000', 2)} AS {o}" for o, (k, a) in _NUMBERS.items()]
    + [f"arg_max(struct_pack(w := {_W}, h := {_H}), track_order) FILTER (WHERE track_type = 'Video' AND {_W} <> 0 AND {_H} <> 0) AS dims",
       f"arg_min(struct_pack(c := format, ch := {_CH}, l := language, b := {_float('bit_rate')}), track_order) FILTER (WHERE track_type = 'Audio') AS main",
       "CAST(count(*) FILTER (WHERE track_type = 'Audio') AS INTEGER) AS audio_count",
       "CAST(count(*) FILTER (WHERE track_type = 'Text') AS INTEGER) AS subtitle_count",
       "CAST(count(*) FILTER (WHERE track_type = 'Text' AND lower(forced) = 'yes') AS INTEGER) AS subtitle_forced_count",
       _any("Video", f"{_W} <> 0 AND {_H} <> 0 AND ({_W} >= 3800 OR {_H} >= 2100)") + " AS is_4k",
       _any("Video", f"coalesce(hdr_format, '') <> '' OR {_int('bit_depth')} >= 10") + " AS has_hdr",
       _any("Video", "contains(lower(hdr_format), 'dolby') OR contains(lower(hdr_format), 'vision')") + " AS has_dolby_vision",
       _any("Audio", "contains(lower(commercial_name), 'atmos')") + " AS has_atmos",
       _any("Audio", "contains(lower(commercial_name), 'dts:x') OR contains(lower(commercial_name), 'dts-x')") + " AS has_dts_x",
       _any("Audio", "contains(lower(compression_mode), 'lossless') OR upper(format) IN ('FLAC','ALAC','MLP FBA','DTS XLL','TRUEHD')") + " AS has_lossless_audio",
       _any("Menu", "true") + " AS has_chapters",
       "CAST(coalesce(arg_max(len(list_filter(string_split(chapters, '|'), lambda c: starts_with(c, '00:'))), track_order) FILTER (WHERE track_type = 'Menu' AND chapters IS NOT NULL), 0) AS INTEGER) AS chapter_count"]
    + [_any("Audio", f"{_lang('language')} = '{c}'") + f" AS has_{w}_audio" for c, w in _LANGS]
    + [_any("Text", f"{_lang('language')} = '{c}'") + f" AS has_{w}_subtitles" for c, w in _LANGS]
    + [f"{_joined('Audio', e)} AS {o}" for o, e in _ALISTS.items()]
    + [f"{_joined('Text', e)} AS {o}" for o, e in _TLISTS.items()]
)

_wrap = lambda kind: (
    "SELECT file_id, array_to_string(list(language ORDER BY first_seen), ',') AS langs FROM (SELECT file_id, language, min(track_order) AS first_seen"
    f" FROM media_tracks WHERE track_type = '{kind}' AND language <> '' GROUP BY file_id, language) q GROUP BY file_id"
)

CTES = {
    "media_files": W.MEDIA_FILES,
    "line_tracks": W.MEDIA_TRACKS,
    "general_tracks": W.MEDIA_GENERAL,
    "media_tracks": "SELECT * FROM line_tracks UNION ALL BY NAME SELECT * FROM general_tracks",
    "ref_search": W.REF_SEARCH_ORACLE,
    "ref_details": W.REF_DETAILS,
    "broken_details": W.BROKEN_DETAILS,
    "images": W.IMAGES,
    "state": W.STATE,
    "raw_listing": W.RAW_LISTING,
    "inventory": f"SELECT *, {_NAME.format(p='file_path')} AS filename, string_split(lower(file_path), '/') AS parts FROM media_files WHERE {_EXT.format(n=_NAME.format(p='file_path'))} IN ({_ALLOWED})",
    "typed": f"""SELECT *, {_EXT.format(n='filename')} AS extension, regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS folder_name,
  CASE WHEN {_EXT.format(n='filename')} IN ('.jpg','.jpeg','.png','.raw','.nef','.cr2','.arw','.dng','.tif','.tiff') THEN struct_pack(t := 'photography', l := 'unknown')
    WHEN {_EXT.format(n='filename')} IN ('.mp3','.flac','.wav','.aac','.ogg','.wma','.m4a') THEN
      CASE WHEN contains(lower(file_path), 'music clip') THEN struct_pack(t := 'music_clip', l := 'mixed') ELSE struct_pack(t := 'music', l := 'mixed') END
    {_folder_arms}
    WHEN regexp_matches(filename, '{_SE}') THEN struct_pack(t := 'series', l := 'unknown')
    ELSE struct_pack(t := 'unknown', l := 'unknown') END AS f FROM inventory""",
    "named": f"""SELECT *, f.t AS media_type, f.l AS folder_language, CAST(f.l = 'pl' AS INTEGER) AS is_polish_production,
  {_round('size_bytes / 1048576.0::DOUBLE', 2)} AS size_mb, {_round('size_bytes / 1073741824.0::DOUBLE', 3)} AS size_gb,
  {_iso('mtime')} AS modified_at_ts, '{W.SCAN_TS}' AS scanned_at_ts,
  coalesce({_years('filename')}, {_years('folder_name')}) AS extracted_year, {_title('filename')} AS extracted_title,
  CAST(coalesce(nullif(regexp_extract(filename, '{_SE}', 1), ''), nullif(regexp_extract(filename, '{_SE}', 3), '')) AS INTEGER) AS season_number,
  CAST(coalesce(nullif(regexp_extract(filename, '{_SE}', 2), ''), nullif(regexp_extract(filename, '{_SE}', 4), '')) AS INTEGER) AS episode_number,
  CASE WHEN regexp_matches(filename, '(?i)8k|4320p') THEN '8K' WHEN regexp_matches(filename, '(?i)4k|2160p|uhd') THEN '4K'
    WHEN regexp_matches(filename, '(?i)1080p|fhd') THEN '1080p' WHEN regexp_matches(filename, '(?i)720p|hd($|[^t]|t($|[^v]))') THEN '720p'
    WHEN regexp_matches(filename, '(?i)480p|sd') THEN '480p' END AS parsed_resolution,
  CASE WHEN regexp_matches(filename, '(?i)blu-?ray|bdrip|brrip|remux') THEN 'BluRay' WHEN regexp_matches(filename, '(?i)web-?dl|webrip|vod') THEN 'Web-DL'
    WHEN regexp_matches(filename, '(?i)hdtv|pdtv') THEN 'HDTV' WHEN regexp_matches(filename, '(?i)dvd-?rip|dvd') THEN 'DVD' END AS parsed_source
  FROM typed""",
    "audio_langs": _wrap("Audio"),
    "text_langs": _wrap("Text"),
    "raw_fold": f"SELECT {_fold_sql} FROM media_tracks GROUP BY file_id",
    "folded": """SELECT r.* EXCLUDE (g, v, dims, main, cll, fall, ai_processing_info, encoding_settings), g.* , v.*,
  substr(ai_processing_info, 1, 300) AS ai_processing_info, substr(encoding_settings, 1, 500) AS encoding_settings,
  """ + _light("cll") + " AS max_content_light_level, " + _light("fall") + """ AS max_frame_avg_light_level,
  dims.w AS width, dims.h AS height, dims.w || 'x' || dims.h AS video_resolution,
  main.c AS audio_main_codec, main.ch AS audio_main_channels, main.l AS audio_main_language,
  """ + _round("nullif(main.b, 0) / 1000", 2) + """ AS audio_main_bitrate_kbps,
  CASE WHEN duration_sec IS NOT NULL THEN printf('%02d:%02d:%02d', CAST(floor(duration_sec) AS BIGINT) % 86400 // 3600, CAST(floor(duration_sec) AS BIGINT) % 3600 // 60, CAST(floor(duration_sec) AS BIGINT) % 60) END AS duration_fmt,
  a.langs AS audio_languages_list, t.langs AS subtitle_languages_list,
  CAST(audio_count > 1 AS INTEGER) AS is_multi_audio, CAST(subtitle_count > 0 AS INTEGER) AS has_subtitles,
  CAST(ai_processing_info IS NOT NULL AS INTEGER) AS ai_enhanced, CAST(ai_processing_info IS NOT NULL AS INTEGER) AS has_ai_upscaling,
  CAST(attachment_list IS NOT NULL AS INTEGER) AS has_attachments, CAST(attachment_list IS NOT NULL AS INTEGER) AS has_cover_art,
  CASE WHEN """ + " + ".join(f"has_{w}_audio" for _, w in _LANGS) + " > 1 THEN 'mixed' "
    + " ".join(f"WHEN has_{w}_audio = 1 THEN '{c}'" for c, w in _LANGS) + """ END AS audio_language_code
  FROM raw_fold r LEFT JOIN audio_langs a USING (file_id) LEFT JOIN text_langs t USING (file_id)""",
    "scored": """SELECT *, CAST(
  CASE WHEN is_4k = 1 THEN 30 WHEN height >= 1080 THEN 20 WHEN height >= 720 THEN 10 ELSE 0 END
  + CASE WHEN has_dolby_vision = 1 THEN 20 WHEN has_hdr = 1 THEN 15 ELSE 0 END
  + CASE WHEN has_atmos = 1 OR has_dts_x = 1 THEN 25 WHEN has_lossless_audio = 1 THEN 20 WHEN audio_count > 1 THEN 10 ELSE 0 END
  + CASE WHEN overall_bitrate_kbps > 50000 THEN 15 WHEN overall_bitrate_kbps > 20000 THEN 10 WHEN overall_bitrate_kbps > 10000 THEN 5 ELSE 0 END
  + CASE WHEN has_polish_subtitles = 1 THEN 5 ELSE 0 END + CASE WHEN has_ai_upscaling = 1 THEN 5 ELSE 0 END AS DOUBLE) AS quality_score FROM folded""",
    "pictures": f"""SELECT file_id, width AS image_width, height AS image_height, {_round('CAST(width AS BIGINT) * height / 1000000.0::DOUBLE', 2)} AS image_megapixels,
  trim(make) AS camera_make, trim(model) AS camera_model, trim(taken) AS date_taken FROM images""",
    "gated": """SELECT *, CASE WHEN s THEN 'tv' ELSE 'movie' END AS endpoint, CASE WHEN is_polish_production = 1 THEN 'pl-PL' ELSE 'en-US' END AS language,
  extracted_title AS title, CASE WHEN NOT s THEN extracted_year END AS search_year
  FROM (SELECT *, media_type IN ('series','series_pl','series_original','kids_series') OR season_number IS NOT NULL AS s FROM named) n
  WHERE media_type NOT IN ('photography','music','music_clip') AND extracted_title <> ''""",
    "top_year": "SELECT endpoint, language, query, year, id FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, language, query, year ORDER BY rank) AS rn FROM ref_search) q WHERE rn = 1",
    "top_any": "SELECT endpoint, language, query, id FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, language, query ORDER BY rank) AS rn FROM ref_search) q WHERE rn = 1",
    "resolved": """SELECT g.*, coalesce(y.id, a.id) AS tmdb_id FROM gated g
  LEFT JOIN top_year y ON y.endpoint = g.endpoint AND y.language = g.language AND y.query = g.title AND y.year = g.search_year
  LEFT JOIN top_any a ON a.endpoint = g.endpoint AND a.language = g.language AND a.query = g.title""",
}


def _problems():
    whole, number = "[-+]?[0-9]+", "[-+]?[0-9]+([.][0-9]*)?"
    asked = [("General", "part_id", whole), *[("Video", a, whole) for a in ("width", "height", "bit_depth")],
             *[("General", a, number) for a in ("duration", "overall_bit_rate")],
             *[("Video", a, number) for a in ("frame_rate", "bit_rate", "bit_rate_maximum", "source_duration")], ("Audio", "bit_rate", number)]
    return " UNION ALL ".join(
        f"SELECT file_id, track_order, '{a}' AS attribute, {a} AS raw, CASE WHEN regexp_full_match(trim({a}), '{pattern}') THEN 'out of range' ELSE 'no number' END AS reason"
        f" FROM media_tracks WHERE track_type = '{kind}' AND {a} <> '' AND (NOT regexp_full_match(trim({a}), '{pattern}')"
        + (f" OR TRY_CAST(trim({a}) AS INTEGER) IS NULL)" if pattern == whole else ")")
        for kind, a, pattern in asked
    )


CTES["problems"] = _problems()
CTES["ranged"] = """SELECT file_id, arg_min(attribute || ': ' || raw || ' is out of range (track ' || track_order || ')', struct_pack(a := track_order, b := attribute, c := raw))
  || CASE WHEN count(*) > 1 THEN ' and ' || (count(*) - 1) || ' more' ELSE '' END AS attribute_error FROM problems WHERE reason = 'out of range' GROUP BY file_id"""


def _details(table):
    js = lambda f: f"json_extract_string(json, '$.{f}')"
    whole = lambda text, kind: f"CASE WHEN regexp_full_match({text}, '[-+]?[0-9]+') THEN TRY_CAST({text} AS {kind}) END"
    number = lambda text: f"CASE WHEN regexp_full_match({text}, '[-+]?[0-9]+([.][0-9]*)?') THEN TRY_CAST({text} AS DOUBLE) END"
    runtime = f"coalesce({js('runtime')}, {js('episode_run_time[0]')})"
    return f"""SELECT endpoint, language, id,
  coalesce(nullif({js('title')}, ''), {js('name')}) AS tmdb_title, coalesce(nullif({js('original_title')}, ''), {js('original_name')}) AS tmdb_original_title,
  {number(js('vote_average'))} AS tmdb_rating, {whole(js('vote_count'), 'BIGINT')} AS tmdb_vote_count,
  nullif(array_to_string(json_extract_string(json, '$.genres[*].name'), ','), '') AS tmdb_genres,
  coalesce(nullif({js('release_date')}, ''), {js('first_air_date')}) AS tmdb_release_date, {js('overview')} AS tmdb_overview,
  {whole(runtime, 'INTEGER')} AS tmdb_runtime,
  nullif(array_to_string(json_extract_string(json, '$.production_countries[*].iso_3166_1'), ','), '') AS tmdb_production_countries,
  {js('poster_path')} AS tmdb_poster_path FROM (SELECT endpoint, language, id, CASE WHEN json_valid(json) THEN json END AS json FROM {table}) d WHERE json IS NOT NULL"""


CTES["details"] = _details("ref_details")
CTES["details_left"] = _details("broken_details")
_TMDB = ["tmdb_title", "tmdb_original_title", "tmdb_rating", "tmdb_vote_count", "tmdb_genres", "tmdb_release_date",
         "tmdb_overview", "tmdb_runtime", "tmdb_production_countries", "tmdb_poster_path"]


def _enriched(details):
    return ("SELECT n.file_id, r.tmdb_id, " + ", ".join(f"d.{c}" for c in _TMDB)
            + f", CASE WHEN d.id IS NULL THEN 0 ELSE 1 END AS tmdb_enriched FROM named n LEFT JOIN resolved r USING (file_id)"
              f" LEFT JOIN {details} d ON d.endpoint = r.endpoint AND d.language = r.language AND d.id = r.tmdb_id")


CTES["enriched"] = _enriched("details")
CTES["enriched_left"] = _enriched("details_left")


def _catalog_sql():
    from reelshelf.schemas import CATALOG

    names = {"content_language": "coalesce(audio_language_code, folder_language)", "created_at_ts": "CAST(NULL AS VARCHAR)",
             "processing_error": "CASE WHEN media_type <> 'photography' AND fid IS NULL THEN 'MediaInfo parse failed' ELSE attribute_error END"}
    cols = []
    for f in CATALOG.fields:
        expr = names.get(f.name, f.name)
        if not f.nullable and f.dataType.simpleString() == "int":
            expr = f"coalesce({expr}, 0)"
        cols.append(f"{expr} AS {f.name}")
    return ("SELECT " + ", ".join(cols) + """ FROM (SELECT n.* EXCLUDE (f, parts, file_id), s.* EXCLUDE (file_id), s.file_id AS fid, p.* EXCLUDE (file_id), e.* EXCLUDE (file_id), x.attribute_error
  FROM named n LEFT JOIN scored s ON s.file_id = n.file_id AND n.media_type <> 'photography'
  LEFT JOIN pictures p ON p.file_id = n.file_id AND n.media_type = 'photography' LEFT JOIN enriched e ON e.file_id = n.file_id
  LEFT JOIN ranged x ON x.file_id = n.file_id AND n.media_type <> 'photography') j""")


CTES["catalog"] = _catalog_sql()


def _with(select):
    """Prefix the CTEs a query needs, in order."""
    import re

    def words(sql):
        return set(re.findall(r"\w+", sql)) & set(CTES)

    needed, todo = set(), list(words(select))
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += list(words(CTES[name]) - {name})
    parts = [f"{n} AS ({sql})" for n, sql in CTES.items() if n in needed]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def _folded(*names):
    return "SELECT file_id, " + ", ".join(names) + " FROM folded"


def _named(*names):
    return "SELECT file_path, " + ", ".join(names) + " FROM named"


def build():
    from workload import queries as Q

    hit = "i.mtime = s.mtime AND i.size_bytes = s.size_bytes"
    lookup = f"""SELECT i.file_path, CAST(coalesce({hit}, false) AS INTEGER) AS hit,
  CAST(coalesce({hit}, false) AND coalesce(tmdb_enriched, 0) <> 0 AS INTEGER) AS reuse FROM inventory i LEFT JOIN state s USING (file_path)"""
    upsert = f"""SELECT file_path, {_iso('mtime')} AS mtime, size_bytes + 5 AS size_bytes, 1 AS tmdb_enriched FROM media_files
  UNION ALL SELECT file_path, {_iso('mtime')}, size_bytes, tmdb_enriched FROM state WHERE file_path NOT IN (SELECT file_path FROM media_files)"""
    listing_errors = f"""SELECT {_NAME.format(p='file_path')} AS file, file_path AS path,
  CASE WHEN size_text = 'n/a' THEN 'missing size' WHEN size_text = '-1' THEN 'negative size' ELSE 'missing modification time' END AS error,
  'processing' AS stage, '{W.SCAN_TS}' AS time FROM raw_listing
  WHERE (size_text IN ('n/a', '-1') OR mtime IS NULL) AND {_EXT.format(n=_NAME.format(p='file_path'))} IN ({_ALLOWED})"""
    from reelshelf.schemas import CATALOG

    gb = "CAST(sum(CAST(size_gb AS DECIMAL(24,3))) AS DOUBLE)"
    read_back = "SELECT " + ", ".join(
        f"nullif({f.name}, '') AS {f.name}" if f.nullable and f.dataType.simpleString() == "string" else f.name for f in CATALOG.fields
    ) + " FROM catalog"
    attribute_errors = f"""SELECT n.filename AS file, n.file_path AS path, attribute || ': ' || raw || ' is ' || reason || ' (track ' || track_order || ')' AS error,
  'attributes' AS stage, '{W.SCAN_TS}' AS time, n.file_id FROM problems p JOIN named n ON n.file_id = p.file_id WHERE n.media_type <> 'photography'"""
    usable = "SELECT n.* FROM named n JOIN raw_listing r ON r.file_id = n.file_id WHERE r.size_text NOT IN ('n/a', '-1') AND r.mtime IS NOT NULL"
    ids = "(SELECT file_id, file_path FROM media_files)"
    flags = ["is_4k", "has_hdr", "has_dolby_vision", "has_atmos", "has_dts_x", "has_lossless_audio"]
    sql = {
        "file_inventory": f"SELECT file_path, source_root, size_bytes, {_iso('mtime')} AS mtime FROM inventory",
        "filter_extensions": "SELECT file_path FROM inventory",
        "read_tracks": "SELECT track_type, count(*) AS tracks, count(format) AS with_format, count(language) AS with_language, count(chapters) AS with_chapters FROM media_tracks GROUP BY track_type",
        "image_metadata": "SELECT n.file_path, p.* EXCLUDE (file_id) FROM named n LEFT JOIN pictures p USING (file_id) WHERE n.media_type = 'photography'",
        "ref_search_explode": "SELECT endpoint, language, query, CAST(year AS INTEGER) AS year, CAST(rank AS INTEGER) AS rank, id FROM ref_search",
        "ref_details_parse": "SELECT * FROM details",
        "state_load": "SELECT 'current' AS version, file_path, size_bytes, tmdb_enriched FROM state",
        "stream_ingest": "SELECT file_path, size_bytes, media_type, nullif(extracted_title, '') AS extracted_title, extracted_year, scanned_at_ts FROM named",
        "csv_roundtrip": r"""SELECT doc_id, lang, md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS text_md5, 'F:\"q", ' || source || '\' AS path,
  CASE WHEN doc_id % 3 <> 0 THEN nullif(source, '') END AS maybe_empty, CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars AS INTEGER) END AS maybe_int FROM documents""",
        "sanitize_newlines": r"SELECT doc_id, CAST(length(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS INTEGER) AS chars, md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS text_md5 FROM documents",
        "ref_details_odd": "SELECT * FROM details_left",
        "stream_catalog": read_back,
        "stream_listing": "SELECT * FROM catalog",
        "stream_dead_letters": "SELECT '\"' || file_path || '\",\"x\"' AS line FROM media_files WHERE file_id % 50 = 0",
        "csv_catalog": read_back,
        "state_compaction": """SELECT file_path, size_bytes + 5 AS size_bytes, 1 AS tmdb_enriched FROM media_files WHERE NOT (file_id % 10 < 3 AND file_id % 3 = 1)
  UNION ALL SELECT file_path, size_bytes, tmdb_enriched FROM state WHERE file_path NOT IN (SELECT file_path FROM media_files)""",
        "state_table_lookup": lookup,
        "listing_changes": """SELECT 1 AS step, file_path, size_bytes, CAST(NULL AS BOOLEAN) AS deleted FROM media_files WHERE file_id % 11 = 0 OR file_id % 7 = 0
  UNION ALL SELECT 1, 'gone/' || file_path, NULL, true FROM media_files WHERE file_id % 11 = 0""",
        "table_readers": """SELECT 'images' AS source, count(*) AS rows, CAST(sum(width + height) AS VARCHAR) AS total FROM images
  UNION ALL SELECT 'tracks', count(*), CAST(sum(CAST(track_order AS HUGEINT)) AS VARCHAR) FROM media_tracks
  UNION ALL SELECT 'search', count(*), CAST(sum(rank * id) AS VARCHAR) FROM ref_search
  UNION ALL SELECT 'details', count(*), CAST(sum(length(json)) AS VARCHAR) FROM ref_details""",
        "row_errors": f"SELECT * EXCLUDE (file_id) FROM ({attribute_errors}) q",
        "run_stats_written": f"""SELECT '{W.LATER_TS}' AS date, count(*) AS total, {gb} AS size_gb, count(*) FILTER (WHERE file_id % 7 <> 0) AS hits, count(*) FILTER (WHERE file_id % 7 = 0) AS misses,
  {_round('count(*) FILTER (WHERE file_id % 7 <> 0) / count(*)::DOUBLE * 100', 1)} AS rate,
  (SELECT count(*) FROM ({listing_errors}) e) + (SELECT count(*) FROM ({attribute_errors}) a JOIN ({usable}) u USING (file_id) WHERE file_id % 7 = 0) AS errors FROM ({usable}) t""",
        "incremental_enriched": f"""SELECT c.* REPLACE (CASE WHEN file_id % 11 <> 0 AND file_id % 7 <> 0 AND c.tmdb_enriched = 1 THEN '{W.SCAN_TS}' ELSE '{W.LATER_TS}' END AS scanned_at_ts)
  FROM catalog c JOIN {ids} m ON m.file_path = c.file_path""",
        "export_changed": f"""SELECT file_path, size_bytes, CASE WHEN extension = '.jpg' THEN '{W.LATER_TS}' ELSE '{W.SCAN_TS}' END AS scanned_at_ts, media_type, quality_score FROM catalog""",
        "state_upsert": upsert,
        "state_upsert_join": upsert,
        "errors_table": listing_errors + f"""
  UNION ALL SELECT filename, file_path, 'corrupt details of id ' || tmdb_id, 'tmdb', '{W.SCAN_TS}' FROM resolved r
  JOIN broken_details d ON d.endpoint = r.endpoint AND d.language = r.language AND d.id = r.tmdb_id WHERE NOT json_valid(json)""",
        "run_stats": f"""SELECT (SELECT count(*) FROM named) AS total, (SELECT {gb} FROM named) AS size_gb, h.hits, h.misses,
  {_round('h.hits / (h.hits + h.misses)::DOUBLE * 100', 1)} AS rate, (SELECT count(*) FROM ({listing_errors}) e) AS errors
  FROM (SELECT CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(1 - hit) AS BIGINT) AS misses FROM ({lookup}) l) h""",
        "path_parts": f"SELECT file_path, {_NAME.format(p='file_path')} AS filename, regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS folder_name, {_EXT.format(n=_NAME.format(p='file_path'))} AS extension, source_root FROM media_files",
        "extract_year": f"SELECT file_path, {_years(_NAME.format(p='file_path'))} AS year FROM media_files",
        "year_fallback": _named("extracted_year"),
        "season_episode": _named("season_number", "episode_number"),
        "clean_title": f"SELECT file_path, {_title(_NAME.format(p='file_path'))} AS title FROM media_files",
        "parsed_resolution": _named("parsed_resolution"),
        "parsed_source": _named("parsed_source"),
        "classify_media": _named("media_type", "folder_language", "is_polish_production"),
        "size_units": _named("size_bytes", "size_mb", "size_gb"),
        "is_series": "SELECT file_path, CAST(media_type IN ('series','series_pl','series_original','kids_series') OR season_number IS NOT NULL AS INTEGER) AS is_series FROM named",
        "ts_format": f"SELECT event_id, {_iso('ts')} AS ts_iso FROM events",
        "safe_float": f"SELECT file_id, track_order, {_float('bit_rate')} AS bit_rate, {_float('frame_rate')} AS frame_rate FROM media_tracks",
        "safe_int": f"SELECT file_id, track_order, {_W} AS width, {_H} AS height FROM media_tracks",
        "light_level": f"SELECT file_id, track_order, {_light('maximum_content_light_level')} AS max_cll, {_light('mastering_display_luminance')} AS luminance FROM media_tracks WHERE track_type = 'Video'",
        "delay_ms": f"SELECT file_id, track_order, {_delay('delay_relative_to_video')} AS delay_ms, {_ALISTS['audio_delays_ms']} AS delay_text FROM media_tracks WHERE track_type = 'Audio'",
        "normalize_lang": f"SELECT file_id, track_order, {_lang('language')} AS code FROM media_tracks",
        "duration_fmt": _folded("duration_sec", "duration_fmt"),
        "bitrate_kbps": "SELECT file_id, track_order, " + ", ".join(
            f"{_round(f'nullif({_float(a)}, 0) / 1000', 2)} AS {o}" for o, (k, a) in _NUMBERS.items() if k == "Video"
        ) + " FROM media_tracks",
        "is_4k": _folded("is_4k"),
        "hdr_flags": _folded("has_hdr", "has_dolby_vision"),
        "audio_tech_flags": _folded("has_atmos", "has_dts_x", "has_lossless_audio"),
        "fold_general": _folded(*Q.GENERAL_COLUMNS),
        "fold_video": _folded(*Q.VIDEO_COLUMNS),
        "fold_audio_lists": _folded(*Q.AUDIO_LIST_COLUMNS),
        "audio_counts": _folded("audio_count", "is_multi_audio"),
        "main_audio": _folded("audio_main_codec", "audio_main_channels", "audio_main_language", "audio_main_bitrate_kbps"),
        "audio_lang_flags": _folded(*Q.AUDIO_FLAGS),
        "fold_subtitles": _folded(*Q.SUBTITLE_COLUMNS),
        "subtitle_lang_flags": _folded(*Q.TEXT_FLAGS),
        "chapters": _folded("has_chapters", "chapter_count"),
        "content_language": "SELECT file_path, coalesce(audio_language_code, folder_language) AS content_language FROM named LEFT JOIN folded USING (file_id)",
        "quality_score": "SELECT file_path, quality_score, processing_error FROM catalog",
        "enrich_gate": "SELECT file_path, endpoint, language, title, search_year FROM gated",
        "search_top1": "SELECT endpoint, language, query, CAST(year AS INTEGER) AS year, id FROM top_year",
        "search_fallback": "SELECT DISTINCT endpoint, language, title, search_year, tmdb_id FROM resolved",
        "enrich_details": "SELECT n.file_path, e.* EXCLUDE (file_id) FROM named n JOIN enriched_left e USING (file_id)",
        "state_lookup": lookup,
        "incremental_split": f"SELECT file_path, CASE WHEN reuse = 1 THEN 'reuse' ELSE 'process' END AS action FROM ({lookup}) l",
        "incremental_catalog": f"""SELECT file_path, size_bytes, CASE WHEN file_id % 11 <> 0 AND file_id % 7 <> 0 THEN '{W.SCAN_TS}' ELSE '2026-02-02T00:00:00' END AS scanned_at_ts,
  c.media_type, c.audio_count, c.quality_score, c.processing_error FROM catalog c JOIN (SELECT file_id, file_path FROM media_files) m USING (file_path)""",
        "state_prune": "SELECT file_path, size_bytes, tmdb_enriched FROM state WHERE file_path IN (SELECT file_path FROM media_files)",
        "state_deleted": "SELECT file_path FROM state WHERE file_path NOT IN (SELECT file_path FROM media_files)",
        "build_catalog": "SELECT * FROM catalog",
        "catalog_summary": f"SELECT media_type, source_root, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, {gb} AS total_gb, CAST(grouping(media_type, source_root) AS INTEGER) AS level FROM named GROUP BY ROLLUP (media_type, source_root)",
        "quality_breakdown": "SELECT media_type, count(*) AS files, " + ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}_files" for f in flags) + """,
  count(*) FILTER (WHERE overall_bitrate_kbps > 50000) AS rate_over_50_mbps,
  count(*) FILTER (WHERE overall_bitrate_kbps > 20000 AND overall_bitrate_kbps <= 50000) AS rate_20_to_50_mbps,
  count(*) FILTER (WHERE overall_bitrate_kbps > 10000 AND overall_bitrate_kbps <= 20000) AS rate_10_to_20_mbps,
  count(*) FILTER (WHERE overall_bitrate_kbps <= 10000) AS rate_up_to_10_mbps,
  count(quality_score) AS scored_files, avg(quality_score) AS avg_score, max(quality_score) AS max_score,
  quantile_cont(quality_score, 0.25) AS score_p25, quantile_cont(quality_score, 0.5) AS score_p50, quantile_cont(quality_score, 0.75) AS score_p75
  FROM catalog GROUP BY media_type""",
        "language_coverage": "SELECT media_type, language, kind, files, covered_files FROM (" + " UNION ALL ".join(
            f"SELECT media_type, '{c}' AS language, '{k}' AS kind, count(*) AS files, CAST(sum(has_{w}_{k}) AS BIGINT) AS covered_files FROM catalog GROUP BY media_type"
            for c, w in _LANGS for k in ("audio", "subtitles")
        ) + ") q",
        "export_parquet": "SELECT media_type, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM catalog GROUP BY media_type",
    }
    sql |= {"summary_kept": sql["catalog_summary"], "quality_kept": sql["quality_breakdown"], "coverage_kept": sql["language_coverage"]}
    return {name: _with(text) for name, text in sql.items()}
