"""Golden values and properties of the row-level rules."""

import random

from pyspark.sql import functions as F
from reelshelf.functions import attributes as A
from reelshelf.functions import names as N
from reelshelf.functions import numbers as M


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_years(spark):
    names = ["Reksio (1973).mkv", "Movie.2022.1080p.mkv", "A_2022_x.mkv", "a.1999.2001.mkv", "x 2029", "x 1919", "é2022"]
    assert one(spark, names, lambda c: N.extract_year(c, 2026)) == [1973, 2022, None, 2001, None, None, None]


def test_season_episode(spark):
    names = ["S01E05.mkv", "1x07.mkv", "V 1920x1080.mkv", "5.1x264.mkv", "none.mkv"]
    assert one(spark, names, N.season_number) == [1, 1, 20, 1, None]
    assert one(spark, names, N.episode_number) == [5, 7, 108, 264, None]


def test_titles(spark):
    names = ["Reksio (1973).mkv", "Movie.2022.1080p.mkv", "Żółw_i_zając [grp] (x).mp4", "2022.mkv", "a\u00a0\u00a0b.mkv", ".hidden"]
    assert one(spark, names, N.clean_title) == ["Reksio", "Movie", "Żółw i zając", "", "a b", "hidden"]


def test_resolution_and_source(spark):
    names = ["Movie HDR", "Show HDTV", "Wednesday", "x UHD", "a 4320p", "b fhd", "plain"]
    assert one(spark, names, N.parsed_resolution) == ["720p", None, "480p", "4K", "8K", "1080p", None]
    assert one(spark, ["a.REMUX", "WEBDL", "pdtv", "dvdrip", "-"], N.parsed_source) == ["BluRay", "Web-DL", "HDTV", "DVD", None]


def test_paths(spark):
    paths = [r"F:\MEDIA\Movies\a.b.MKV", "/m/x/.hidden", "/m/x/..a", "name"]
    assert one(spark, paths, N.filename) == ["a.b.MKV", ".hidden", "..a", "name"]
    assert one(spark, paths, N.folder_name) == ["Movies", "x", "x", ""]
    assert one(spark, paths, lambda c: N.extension(N.filename(c))) == [".mkv", "", "", ""]


def test_classification(spark):
    paths = [
        "F:/MEDIA/Movies/Christmas/a.mkv", "F:/MEDIA/Photography/a.mp4", "F:/MEDIA/X/Show S01E01.mkv",
        "F:/MEDIA/Movies/Series/x.mkv", "F:/m/Music Clips/a.mp3", "F:/m/Music Clips/a.mp4", "F:/m/Tato/a.mkv",
        "F:/m/Movies PL/a.mkv", "F:/m/x/a.JPG", "F:/m/x/a.flac", "F:/m/x/a.mkv",
    ]
    got = [tuple(r) for r in one(spark, paths, N.classify)]
    assert got == [
        ("christmas", "mixed"), ("photography", "unknown"), ("series", "unknown"), ("movie", "en"),
        ("music_clip", "mixed"), ("music_clip", "mixed"), ("movie", "en"), ("movie_pl", "pl"),
        ("photography", "unknown"), ("music", "mixed"), ("unknown", "unknown"),
    ]


def test_exact_round_is_python_round(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 2.675, 1234.565, 1.005, -2.675, 0.0, 1e300, 131072 / 2**20]
    values += [rng.randrange(10**7) / 1000 for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)]
    assert one(spark, values, lambda c: M.exact_round(c, 2), "double") == [round(v, 2) for v in values]
    assert one(spark, values, lambda c: M.exact_round(c, 3), "double") == [round(v, 3) for v in values]


def test_numbers(spark):
    texts = ["8.0", " 8 ", "8", "n/a", "", None, "-3", "1d", "0x1", "nan", "2.675", "1e3"]
    assert one(spark, texts, M.safe_int) == [None, 8, 8, None, None, None, -3, None, None, None, None, None]
    assert one(spark, texts, M.safe_float) == [8.0, 8.0, 8.0, None, None, None, -3.0, None, None, None, 2.67, 1000.0]


def test_attribute_rules(spark):
    langs = ["Bengali", "Estonian", "ces", "Spanish", "Polish", "fra", "", None]
    assert one(spark, langs, A.normalize_lang) == ["en", "es", None, "es", "pl", "fr", None, None]
    assert one(spark, [90061.0, 59.99, 0.0, None], A.duration_fmt, "double") == ["01:01:01", "00:00:59", "00:00:00", None]
    assert one(spark, ["1000 cd/m2", "min 0.5, max: 12 cd/m²", "x", None], A.light_level) == [1000, 12, None, None]
    assert one(spark, ["-12.7 ms", "0 ms", "12", None], lambda c: A.whole_text(A.delay_ms(c))) == ["-12", "0", None, None]
    chapters = [{"00:05:00": "a", "01:05:00": "b"}, {}, None]
    assert one(spark, chapters, A.chapter_count, "map<string,string>") == [1, 0, None]


def test_timestamps(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-02 03:04:05' a, timestamp_ntz'2020-01-02 03:04:05.5' b")
    assert tuple(df.select(N.iso_timestamp(F.col("a")), N.iso_timestamp(F.col("b"))).first()) == (
        "2020-01-02T03:04:05", "2020-01-02T03:04:05.500000",
    )


def test_rounding_equals_python_in_every_decade(spark):
    rng = random.Random(3)
    values = [rng.choice((1, -1)) * rng.uniform(1, 10) * 10.0 ** e for e in range(-3, 301, 1) for _ in range(12 if e < 20 else 2)]
    values += [4897515925693.154, 106254413581742.06, 0.005, 0.125, 2.675, 1234.565, 0.5, 2.5, 45035996273704.965, 9007199254740.995]
    for digits in (1, 2, 3):
        assert one(spark, values, lambda c: M.exact_round(c, digits), "double") == [round(v, digits) for v in values]
