"""Fixed values.

The lists, patterns and constants below are data: results are only right when
they hold exactly these values. Everything else in the package is logic.
"""

# --- file extensions -------------------------------------------------------
VIDEO_EXTENSIONS = [
    ".mp4", ".mkv", ".avi", ".wmv", ".ts", ".m4v", ".mov",
    ".m2ts", ".webm", ".ogv", ".flv", ".vob", ".iso", ".bdmv",
]
AUDIO_EXTENSIONS = [".flac", ".mp3", ".m4a", ".wav", ".aac", ".ogg", ".wma"]
IMAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".raw",
    ".cr2", ".nef", ".arw", ".dng",
]
ALLOWED_EXTENSIONS = VIDEO_EXTENSIONS + AUDIO_EXTENSIONS + IMAGE_EXTENSIONS

# --- library roots ---------------------------------------------------------
ROOT_FOLDERS = [
    "Christmas", "Concert", "Docu", "Fun", "Kids Movies", "Kids Series",
    "Movies", "Movies Extras", "Movies PL", "Music", "Music Clips", "Others",
    "Photography", "Religious", "Series", "Series Original", "Series Polish",
    "Theater", "Tato",
]

# --- folder name -> (media type, content language), first match wins --------
FOLDER_RULES = [
    ("christmas", "christmas", "mixed"),
    ("concert", "concert", "mixed"),
    ("docu", "documentary", "mixed"),
    ("fun", "fun", "mixed"),
    ("kids movies", "kids_movie", "mixed"),
    ("kids series", "kids_series", "mixed"),
    ("movies", "movie", "en"),
    ("movies extras", "movie_extra", "mixed"),
    ("movies pl", "movie_pl", "pl"),
    ("music", "music", "mixed"),
    ("music clips", "music_clip", "mixed"),
    ("photography", "photography", "unknown"),
    ("religious", "religious", "mixed"),
    ("others", "mixed", "mixed"),
    ("series", "series", "en"),
    ("series original", "series_original", "original"),
    ("series polish", "series_pl", "pl"),
    ("theater", "theater", "mixed"),
    ("tato", "movie", "en"),
]
MUSIC_CLIP_MARK = "music clip"
SERIES_TYPES = ["series", "series_pl", "series_original", "kids_series"]
UNENRICHED_TYPES = ["photography", "music", "music_clip"]

# --- name patterns (Java regex; (?U) = Unicode classes and word edges) ------
YEAR_PATTERN = r"(?U)\b(19[2-9]\d|20[0-2]\d)\b"
YEAR_FLOOR = 1920
YEAR_AHEAD = 2
SEASON_EPISODE_PATTERN = r"(?iU)(?:s(\d{1,2})e(\d{1,3}))|(?:(\d{1,2})x(\d{1,3}))"
NOISE_WORDS_PATTERN = (
    r"(?iU)\b(1080p|720p|4k|2160p|bluray|bdrip|brrip|remux|web-?dl|x264|x265|hevc|h264|h265|"
    r"aac|ac3|dts|pl|lektor|dubbing|dub|subbed)\b"
)
RESOLUTION_PATTERNS = [
    ("8K", r"(?iU)8k|4320p"),
    ("4K", r"(?iU)4k|2160p|uhd"),
    ("1080p", r"(?iU)1080p|fhd"),
    ("720p", r"(?iU)720p|hd(?!tv)"),
    ("480p", r"(?iU)480p|sd"),
]
SOURCE_PATTERNS = [
    ("BluRay", r"(?iU)blu-?ray|bdrip|brrip|remux"),
    ("Web-DL", r"(?iU)web-?dl|webrip|vod"),
    ("HDTV", r"(?iU)hdtv|pdtv"),
    ("DVD", r"(?iU)dvd-?rip|dvd"),
]

# --- track attribute patterns ----------------------------------------------
LIGHT_LEVEL_PATTERN = r"(?U)(\d+)\s*cd/m[²2]"
DELAY_PATTERN = r"(?U)([-+]?\d+(?:\.\d+)?)\s*ms"

# --- language codes: (code, flag word, prefix, contained marks), in order ---
LANGUAGE_RULES = [
    ("pl", "polish", "pl", ["pol"]),
    ("en", "english", "en", ["eng"]),
    ("cs", "czech", "cs", ["cze"]),
    ("es", "spanish", "es", ["spa"]),
    ("de", "german", "de", ["ger"]),
    ("fr", "french", "fr", ["fre", "fra"]),
    ("it", "italian", "it", ["ita"]),
]

# --- picture and sound thresholds -------------------------------------------
UHD_MIN_WIDTH = 3800
UHD_MIN_HEIGHT = 2100
HDR_MIN_BIT_DEPTH = 10
LOSSLESS_FORMATS = ["FLAC", "ALAC", "MLP FBA", "DTS XLL", "TRUEHD"]
FIRST_HOUR_PREFIX = "00:"
AI_INFO_MAX_CHARS = 300
ENCODER_SETTINGS_MAX_CHARS = 500
PROBE_FAILED = "MediaInfo parse failed"

# --- quality score points ----------------------------------------------------
SCORE_4K, SCORE_1080, SCORE_720 = 30, 20, 10
SCORE_DOLBY_VISION, SCORE_HDR = 20, 15
SCORE_OBJECT_AUDIO, SCORE_LOSSLESS, SCORE_MULTI_AUDIO = 25, 20, 10
SCORE_BITRATES = [(50000, 15), (20000, 10), (10000, 5)]
SCORE_POLISH_SUBTITLES = 5
SCORE_AI = 5

# --- catalogue service keys ---------------------------------------------------
ENDPOINT_SERIES, ENDPOINT_MOVIE = "tv", "movie"
LANGUAGE_POLISH, LANGUAGE_DEFAULT = "pl-PL", "en-US"

# --- state ---------------------------------------------------------------------
STATE_VERSION = "1.0"
