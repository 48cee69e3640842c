"""Everything a file's path and name tell: pure column expressions, no UDF."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as V
from reelshelf.functions.numbers import exact_round

_SEPARATORS = r"[/\\]"
# Unicode white space plus the four ASCII separators that Java's class leaves out.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def components(path: Column) -> Column:
    return F.split(path, _SEPARATORS)


def filename(path: Column) -> Column:
    return F.element_at(components(path), -1)


def folder_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(components(path), F.lit(-2)), F.lit(""))


def stem(name: Column) -> Column:
    """Name without its last extension; leading dots never start an extension."""
    return F.regexp_replace(name, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    """Lower-cased last extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def is_allowed(name: Column) -> Column:
    return extension(name).isin(V.ALLOWED_EXTENSIONS)


def extract_year(text: Column, as_of_year: int) -> Column:
    """Last plausible year in the text; years after as_of_year + 2 don't count."""
    years = F.transform(
        F.regexp_extract_all(text, F.lit(V.YEAR_PATTERN), F.lit(1)), lambda y: y.try_cast("int")
    )
    plausible = F.filter(years, lambda y: (y >= V.YEAR_FLOOR) & (y <= as_of_year + V.YEAR_AHEAD))
    return F.try_element_at(plausible, F.lit(-1))


def _season_episode_digits(name: Column) -> Column:
    """[season, episode] of the leftmost hit: one scan of the name, one of the short hit."""
    hit = F.regexp_extract(name, V.SEASON_EPISODE_PATTERN, 0)
    return F.regexp_extract_all(hit, F.lit(r"(?U)(\d+)"), F.lit(1))


def season_number(name: Column) -> Column:
    return F.try_element_at(_season_episode_digits(name), F.lit(1)).try_cast("int")


def episode_number(name: Column) -> Column:
    return F.try_element_at(_season_episode_digits(name), F.lit(2)).try_cast("int")


def clean_title(name: Column) -> Column:
    """Title left over when extension, years, S/E marks, noise and brackets are gone."""
    title = stem(name)
    for pattern, replacement in [
        (V.YEAR_PATTERN, ""),
        (V.SEASON_EPISODE_PATTERN, ""),
        (V.NOISE_WORDS_PATTERN, ""),
        (r"[._-]+", " "),
        (r"\[[^\n]*?\]|\([^\n]*?\)", ""),
        (_BLANKS, " "),
    ]:
        title = F.regexp_replace(title, pattern, replacement)
    return F.trim(title)


def _first_hit(text: Column, labelled_patterns) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, pattern in labelled_patterns:
        chain = chain.when(text.rlike(pattern), F.lit(label))
    return chain


def parsed_resolution(name: Column) -> Column:
    return _first_hit(name, V.RESOLUTION_PATTERNS)


def parsed_source(name: Column) -> Column:
    return _first_hit(name, V.SOURCE_PATTERNS)


def classify(path: Column, name: Column | None = None, ext: Column | None = None) -> Column:
    """struct(media_type, content_language) from extension, folders and name.

    ``array_intersect`` keeps the order of its first argument, so its first
    element is the first rule, in rule order, that any path component meets. The
    rules sit in literal maps, which keeps the expression small. ``name`` and
    ``ext`` save parsing the path again where they are columns already.
    """
    def verdict(media_type, language):
        return F.struct(F.lit(media_type).alias("media_type"), F.lit(language).alias("content_language"))

    name = filename(path) if name is None else name
    ext = extension(name) if ext is None else ext
    rule_keys = F.array(*[F.lit(key) for key, _, _ in V.FOLDER_RULES])
    rules = F.create_map(*[c for key, *values in V.FOLDER_RULES for c in (F.lit(key), verdict(*values))])
    met = F.array_intersect(rule_keys, components(F.lower(path)))
    by_folder = F.try_element_at(rules, F.try_element_at(met, F.lit(1)))
    kinds = [("image", V.IMAGE_EXTENSIONS), ("audio", V.AUDIO_EXTENSIONS)]
    by_kind = F.try_element_at(
        F.create_map(*[c for kind, exts in kinds for e in exts for c in (F.lit(e), F.lit(kind))]), ext
    )
    return (
        F.when(by_kind == "image", verdict("photography", "unknown"))
        .when((by_kind == "audio") & F.lower(path).contains(V.MUSIC_CLIP_MARK), verdict("music_clip", "mixed"))
        .when(by_kind == "audio", verdict("music", "mixed"))
        .otherwise(
            F.coalesce(
                by_folder,
                F.when(name.rlike(V.SEASON_EPISODE_PATTERN), verdict("series", "unknown")),
                verdict("unknown", "unknown"),
            )
        )
    )


def is_series(media_type: Column, season: Column) -> Column:
    return media_type.isin(V.SERIES_TYPES) | season.isNotNull()


def size_units(size: Column) -> dict[str, Column]:
    """Exact binary units of a byte count, to be rounded in a later select."""
    return {"mebibytes": size / F.lit(float(2 ** 20)), "gibibytes": size / F.lit(float(2 ** 30))}


def size_mb(mebibytes: Column) -> Column:
    return exact_round(mebibytes, 2)


def size_gb(gibibytes: Column) -> Column:
    return exact_round(gibibytes, 3)


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 in the session time zone; the fraction shows only when there is one."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
