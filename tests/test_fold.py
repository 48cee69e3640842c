"""The fold against a plain fold of ordered tracks, with a file that has most of them."""

import random

from pyspark.sql import functions as F
from reelshelf import schemas
from reelshelf.operators.track_fold import fold_tracks
from reelshelf.sources.tables import conform


def tracks_of(spark, rows):
    names = sorted({k for r in rows for k in r})
    df = spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in rows],
        ", ".join(f"{n} {'bigint' if n == 'track_order' else 'map<string,string>' if n == 'extra' else 'string'}" for n in names),
    )
    return conform(df, schemas.TRACKS)


def plain_fold(rows):
    out = {"audio_count": 0, "audio_titles": [], "audio_languages_list": [], "video_codec": None, "width": None,
           "has_atmos": 0, "subtitle_formats": [], "audio_main_codec": None, "chapter_count": 0}
    for r in sorted(rows, key=lambda r: r["track_order"]):
        kind = r["track_type"]
        if kind == "Video":
            out["video_codec"] = r.get("format")
            if r.get("width", "").isdigit() and r.get("height", "").isdigit():
                out["width"] = int(r["width"])
        elif kind == "Audio":
            out["audio_count"] += 1
            if out["audio_count"] == 1:
                out["audio_main_codec"] = r.get("format")
            if r.get("title"):
                out["audio_titles"].append(r["title"])
            if r.get("language") and r["language"] not in out["audio_languages_list"]:
                out["audio_languages_list"].append(r["language"])
            out["has_atmos"] |= int("atmos" in (r.get("commercial_name") or "").lower())
        elif kind == "Text" and r.get("format"):
            out["subtitle_formats"].append(r["format"])
        elif kind == "Menu" and r.get("extra") is not None:
            out["chapter_count"] = sum(k.startswith("00:") for k in r["extra"])
    return {k: ",".join(v) or None if isinstance(v, list) else v for k, v in out.items()}


def test_fold_matches_plain_fold_whatever_the_chunks(spark):
    rng = random.Random(3)
    files = [f"f{i}" for i in range(20)]
    rows = []
    for path in files + ["hot"]:
        for order in range(2000 if path == "hot" else rng.randrange(1, 9)):
            row = {"file_path": path, "track_order": order, "track_type": rng.choice(["Video", "Audio", "Text", "Menu", "General"])}
            for name, values in {
                "format": ["AAC", "AVC", "", None], "title": ["t%d" % order, "", None], "language": ["pl", "en", "de", "", None],
                "width": ["1920", "8.0", None], "height": ["1080", "x"], "commercial_name": ["Dolby Atmos", None],
            }.items():
                value = rng.choice(values)
                if value is not None:
                    row[name] = value
            if row["track_type"] == "Menu" and order % 2:
                row["extra"] = {"00:01:00": "a", "01:00:00": "b"} if order % 3 else {}
            rows.append(row)
    rng.shuffle(rows)
    expected = {p: plain_fold([r for r in rows if r["file_path"] == p]) for p in files + ["hot"]}
    columns = list(expected["hot"])
    tracks = tracks_of(spark, rows)
    for chunk in (None, F.shiftright("track_order", 4)):
        got = {r["file_path"]: {c: r[c] for c in columns} for r in fold_tracks(tracks, chunk=chunk).select("file_path", *columns).collect()}
        assert got == expected


def test_last_value_and_last_usable_value(spark):
    rows = [
        {"file_path": "a", "track_order": 0, "track_type": "General", "duration": "90061000", "videoai": "x" * 400, "format": "MKV"},
        {"file_path": "a", "track_order": 1, "track_type": "General", "duration": "0"},
        {"file_path": "a", "track_order": 2, "track_type": "Video", "format": "HEVC", "width": "3840", "height": "2160", "bit_depth": "10"},
        {"file_path": "a", "track_order": 3, "track_type": "Video", "width": "0", "height": "5", "maximum_content_light_level": "bright"},
        {"file_path": "a", "track_order": 4, "track_type": "Audio", "bit_rate": "1234565", "channels": "6", "language": "pl"},
    ]
    row = fold_tracks(tracks_of(spark, rows)).first()
    assert (row.container_format, row.video_codec) == (None, None)
    assert (row.duration_sec, row.duration_fmt, len(row.ai_processing_info)) == (90061.0, "01:01:01", 300)
    assert (row.width, row.video_resolution, row.is_4k, row.has_hdr, row.has_dolby_vision) == (3840, "3840x2160", 1, 1, 0)
    assert (row.audio_main_bitrate_kbps, row.audio_bitrates, row.audio_channels_list) == (round(1234565 / 1000, 2), "1234", "6ch")
    assert row.max_content_light_level is None and row.audio_language_code == "pl"
