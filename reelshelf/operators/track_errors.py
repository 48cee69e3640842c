"""Track attributes that should be numbers and aren't, as rows.

Two kinds. An int beyond 32 bits would have been a value but finds no room in the
row: it goes to ``processing_error``. Text that is no number counts as absent, as
always; it is reported in the error table only. Each track is judged on its
own, so nothing gathers by file but one short text and a count.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions.numbers import is_float_text, is_int_text

# Attributes that the catalogue reads as numbers, by kind of track.
INTS = {"General": ["part_id"], "Video": ["width", "height", "bit_depth"]}
FLOATS = {
    "General": ["duration", "overall_bit_rate"],
    "Video": ["frame_rate", "bit_rate", "bit_rate_maximum", "source_duration"],
    "Audio": ["bit_rate"],
}
OUT_OF_RANGE, NO_NUMBER = "out of range", "no number"


def _problem(attribute: str, reason: str, asked: Column) -> Column:
    return F.when(asked, F.struct(F.lit(attribute).alias("attribute"), F.col(attribute).alias("raw"), F.lit(reason).alias("reason")))


def _no_int(c: Column) -> Column:
    return ~is_int_text(c)


def _beyond_int(c: Column) -> Column:
    """Whole numbers that need more than 32 bits; a text of up to nine characters can't be one, and costs no pattern."""
    return (F.length(c) > 9) & is_int_text(c) & c.try_cast("int").isNull()


def _checks() -> list[tuple[str, str, str, Column]]:
    """kind, attribute, reason, condition. A whole number written as a float reads as absent and is told like any other text."""
    ints = [(kind, a) for kind, attributes in INTS.items() for a in attributes]
    floats = [(kind, a) for kind, attributes in FLOATS.items() for a in attributes]
    return [
        *[(kind, a, NO_NUMBER, _no_int(F.col(a))) for kind, a in ints],
        *[(kind, a, OUT_OF_RANGE, _beyond_int(F.col(a))) for kind, a in ints],
        *[(kind, a, NO_NUMBER, ~is_float_text(F.col(a))) for kind, a in floats],
    ]


def track_problems(tracks: DataFrame, key: str, reasons: tuple[str, ...] = (NO_NUMBER, OUT_OF_RANGE)) -> DataFrame:
    """key, track_order, attribute, raw, reason: a row for each unreadable number. One pass, no shuffle.

    Tracks without a problem, most of them, are dropped by a plain condition before anything is built for them.
    """
    found = {
        (kind, a, reason): (F.col("track_type") == kind) & (F.col(a) != "") & condition
        for kind, a, reason, condition in _checks() if reason in reasons
    }
    told = [_problem(a, reason, asked) for (_, a, reason), asked in found.items()]
    some = tracks.filter(reduce(Column.__or__, found.values()))
    rows = some.select(key, "track_order", F.explode(F.array_compact(F.array(*told))).alias("p"))
    return rows.select(key, "track_order", "p.*")


def _told(attribute: Column, raw: Column, reason: Column, order: Column) -> Column:
    return F.concat(attribute, F.lit(": "), raw, F.lit(" is "), reason, F.lit(" (track "), order.cast("string"), F.lit(")"))


def range_errors(tracks: DataFrame, key: str) -> DataFrame:
    """key and attribute_error: the first number of a file that is out of range, and how many more are."""
    rows = track_problems(tracks, key, (OUT_OF_RANGE,))
    per_file = rows.groupBy(key).agg(
        F.min(F.struct("track_order", "attribute", "raw")).alias("p"), F.count("*").alias("n")
    )
    first = _told(F.col("p.attribute"), F.col("p.raw"), F.lit(OUT_OF_RANGE), F.col("p.track_order"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")
    return per_file.select(key, F.concat(first, more).alias("attribute_error"))


def attribute_errors(named: DataFrame, tracks: DataFrame, key: str, scan_ts: str) -> DataFrame:
    """Error rows (stage attributes) of listed files, in the shape of the error table; the files stay. Photos have no tracks."""
    problems = track_problems(tracks, key).withColumnRenamed(key, "_problem_key")
    files = named.filter(F.col("media_type") != "photography").select(F.col(key).alias("_file_key"), "file_path", "filename")
    told = files.join(problems, F.col("_file_key") == F.col("_problem_key"))
    return told.select(
        F.col("filename").alias("file"), F.col("file_path").alias("path"),
        _told(F.col("attribute"), F.col("raw"), F.col("reason"), F.col("track_order")).alias("error"),
        F.lit("attributes").alias("stage"), F.lit(scan_ts).alias("time"),
    )
