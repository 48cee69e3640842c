"""Row-level rules on probed track attributes (all text) and image facts."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as V
from reelshelf.functions.names import strip_blanks
from reelshelf.functions.numbers import exact_round, truthy_text


def light_level(text: Column) -> Column:
    """First '<n> cd/m2' as int."""
    return truthy_text(F.regexp_extract(text, V.LIGHT_LEVEL_PATTERN, 1)).try_cast("int")


def delay_ms(text: Column) -> Column:
    """First '<n> ms' as double; zero is kept."""
    return truthy_text(F.regexp_extract(text, V.DELAY_PATTERN, 1)).try_cast("double")


def whole_text(number: Column) -> Column:
    """A double cut toward zero, as text; infinities give NULL."""
    return number.try_cast("bigint").cast("string")


def _language_hits(language: Column):
    low = F.lower(language)
    for code, word, prefix, marks in V.LANGUAGE_RULES:
        yield code, reduce(lambda a, b: a | b, [low.contains(m) for m in marks], low.startswith(prefix))


def normalize_lang(language: Column) -> Column:
    """Two-letter code of a raw language tag, or NULL. First rule wins."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, hit in _language_hits(language):
        chain = chain.when(hit, F.lit(code))
    return chain


def language_bit(language: Column) -> Column:
    """The same rules as one bit per language, so that flags fold with a single bit_or."""
    chain = F.when(F.lit(False), F.lit(0))
    for position, (_, hit) in enumerate(_language_hits(language)):
        chain = chain.when(hit, F.lit(1 << position))
    return chain.otherwise(F.lit(0))


def duration_fmt(seconds: Column) -> Column:
    """HH:MM:SS of the whole seconds, wrapping after a day."""
    whole = F.pmod(F.floor(seconds), F.lit(86400))
    hours, minutes, rest = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    texts = [F.lpad(part.cast("int").cast("string"), 2, "0") for part in (hours, minutes, rest)]
    return F.concat(texts[0], F.lit(":"), texts[1], F.lit(":"), texts[2])


def is_4k(width: Column, height: Column) -> Column:
    """Needs both sides non-zero; then either being large is enough."""
    return (
        (F.coalesce(width, F.lit(0)) != 0)
        & (F.coalesce(height, F.lit(0)) != 0)
        & ((width >= V.UHD_MIN_WIDTH) | (height >= V.UHD_MIN_HEIGHT))
    )


def is_dolby_vision(hdr_format: Column) -> Column:
    low = F.lower(F.coalesce(hdr_format, F.lit("")))
    return low.contains("dolby") | low.contains("vision")


def is_hdr(hdr_format: Column, bit_depth: Column) -> Column:
    return (F.coalesce(hdr_format, F.lit("")) != "") | (
        F.coalesce(bit_depth, F.lit(0)) >= V.HDR_MIN_BIT_DEPTH
    )


def is_atmos(commercial_name: Column) -> Column:
    return F.coalesce(F.lower(commercial_name).contains("atmos"), F.lit(False))


def is_dts_x(commercial_name: Column) -> Column:
    low = F.lower(commercial_name)
    return F.coalesce(low.contains("dts:x") | low.contains("dts-x"), F.lit(False))


def is_lossless(compression_mode: Column, audio_format: Column) -> Column:
    return F.coalesce(F.lower(compression_mode).contains("lossless"), F.lit(False)) | F.coalesce(
        F.upper(audio_format).isin(V.LOSSLESS_FORMATS), F.lit(False)
    )


def channel_text(channel_s: Column, channels: Column) -> Column:
    return F.coalesce(truthy_text(channel_s), truthy_text(channels))


def chapter_count(extra: Column) -> Column:
    """Entries of the first hour only; NULL when the track has no map."""
    return F.size(F.filter(F.map_keys(extra), lambda k: k.startswith(V.FIRST_HOUR_PREFIX)))


def megapixels(width: Column, height: Column) -> Column:
    pixels = width.cast("bigint") * height.cast("bigint")
    return exact_round(pixels / F.lit(1000000.0), 2)


def exif_text(exif: Column, tag: str) -> Column:
    return strip_blanks(F.try_element_at(exif, F.lit(tag)))
