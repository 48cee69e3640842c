"""Titles from reference tables, as joins.

The lookups run once per distinct search key, not once per file: a title that
a third of all files share is one row there. Only the last join, back to the
files, sees that skew; its right side is unique per key, so AQE can split the
hot partition freely (or broadcast the lookup when it measures it as small).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as V
from reelshelf.functions import names as N
from reelshelf.functions.numbers import parse_float, safe_int, safe_long, truthy_text

_KEY = ["endpoint", "language", "title", "search_year"]
TMDB_COLUMNS = [
    "tmdb_id", "tmdb_title", "tmdb_original_title", "tmdb_rating", "tmdb_vote_count", "tmdb_genres",
    "tmdb_release_date", "tmdb_overview", "tmdb_runtime", "tmdb_production_countries", "tmdb_poster_path",
    "tmdb_enriched",
]


def explode_search(replies: DataFrame) -> DataFrame:
    """Search replies -> one row per candidate; the array's order becomes the rank."""
    return replies.select(
        "endpoint", "language", "query", F.posexplode("results").alias("pos", "hit")
    ).select(
        "endpoint", "language", "query", F.col("hit.year").alias("year"),
        (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("id"),
    )


def enrichable(named: DataFrame) -> DataFrame:
    """Files worth a search: no photos, no music, and some title left."""
    return named.filter(
        ~F.col("media_type").isin(V.UNENRICHED_TYPES) & (F.coalesce(F.col("extracted_title"), F.lit("")) != "")
    )


def with_search_key(named: DataFrame) -> DataFrame:
    """Add endpoint, language, title, search_year. Without a search the texts are ''.

    No NULL in the texts: a join on nullable keys gets IS NOT NULL filters, and
    the optimizer would push those below the name parsing and repeat it there.
    """
    series = N.is_series(F.col("media_type"), F.col("season_number"))
    wanted = ~F.col("media_type").isin(V.UNENRICHED_TYPES) & (F.col("extracted_title") != "")
    marked = named.select("*", wanted.alias("_wanted"), series.alias("_series"))
    return marked.select(
        *named.columns,
        F.when(~F.col("_wanted"), "").when(F.col("_series"), V.ENDPOINT_SERIES)
        .otherwise(V.ENDPOINT_MOVIE).alias("endpoint"),
        F.when(~F.col("_wanted"), "").when(F.col("is_polish_production") == 1, V.LANGUAGE_POLISH)
        .otherwise(V.LANGUAGE_DEFAULT).alias("language"),
        F.coalesce(F.when(F.col("_wanted"), F.col("extracted_title")), F.lit("")).alias("title"),
        F.when(F.col("_wanted") & ~F.col("_series"), F.col("extracted_year")).alias("search_year"),
    )


def distinct_search_keys(keyed: DataFrame) -> DataFrame:
    """Each search once. Files without a search share one empty key, which meets
    no candidate; a filter against it would be pushed below the name parsing."""
    return keyed.select(*_KEY).distinct()


def top_candidates(ref_search: DataFrame) -> DataFrame:
    """First candidate per query and year by rank; combines before the shuffle."""
    return ref_search.groupBy("endpoint", "language", "query", "year").agg(
        F.min(F.struct("rank", "id")).alias("best")
    )


def top_candidates_any_year(best_by_year: DataFrame) -> DataFrame:
    """First candidate per query over all years, from the winners of each year."""
    return best_by_year.groupBy("endpoint", "language", "query").agg(F.min("best").alias("best"))


def resolve_ids(keys: DataFrame, ref_search: DataFrame) -> DataFrame:
    """tmdb_id per search key: with the year where there is one, else without."""
    by_year = top_candidates(ref_search)
    dated = by_year.select(
        "endpoint", "language", F.col("query").alias("title"),
        F.col("year").alias("search_year"), F.col("best.id").alias("dated_id"),
    )
    undated = top_candidates_any_year(by_year).select(
        "endpoint", "language", F.col("query").alias("title"), F.col("best.id").alias("undated_id")
    )
    return (
        keys.join(undated, ["endpoint", "language", "title"], "left")
        .join(dated, _KEY, "left")
        .select(*_KEY, F.coalesce("dated_id", "undated_id").alias("tmdb_id"))
    )


def parsed_reply() -> Column:
    """JSON text -> VARIANT; NULL when the text is no JSON object.

    No schema here: a field of an odd type costs its own column, not the reply.
    """
    bare = F.btrim("json", F.lit(" \t\r\n"))
    return F.when(bare.startswith("{") & bare.endswith("}"), F.try_parse_json("json"))


def parse_details(ref_details: DataFrame) -> DataFrame:
    return ref_details.select("endpoint", "language", "id", parsed_reply().alias("d"))


def _told() -> Column:
    """An empty reply counts as none."""
    return ~F.col("json").rlike(r"^\s*(\{\s*\}|null)?\s*$")


def _text(path: str) -> Column:
    """A field as text, whatever its type; JSON null and a missing field are NULL."""
    return F.try_variant_get(F.col("d"), path, "string")


def _names(array: str, field: str) -> Column:
    """One field of an array's objects, joined; an element without it leaves an empty place, no array is NULL."""
    elements = F.try_variant_get(F.col("d"), f"$.{array}", "array<variant>")
    named = F.transform(elements, lambda e: F.coalesce(F.try_variant_get(e, f"$.{field}", "string"), F.lit("")))
    return F.when(elements.isNotNull(), truthy_text(F.concat_ws(",", named)))


def is_usable_reply() -> Column:
    return F.col("d").isNotNull()


def detail_columns() -> list[Column]:
    """Catalogue columns of a parsed reply ``d``. Empty text falls through to the TV field.

    A whole number or a number that can't be read as one is NULL; only a missing
    runtime (or JSON null) falls through to the first episode's.
    """
    def either(a, b):
        return F.coalesce(truthy_text(_text(f"$.{a}")), _text(f"$.{b}"))

    runtime = _text("$.runtime")
    columns = {
        "tmdb_title": either("title", "name"),
        "tmdb_original_title": either("original_title", "original_name"),
        "tmdb_rating": parse_float(_text("$.vote_average")),
        "tmdb_vote_count": safe_long(_text("$.vote_count")),
        "tmdb_genres": _names("genres", "name"),
        "tmdb_release_date": either("release_date", "first_air_date"),
        "tmdb_overview": _text("$.overview"),
        "tmdb_runtime": safe_int(F.coalesce(runtime, _text("$.episode_run_time[0]"))),
        "tmdb_production_countries": _names("production_countries", "iso_3166_1"),
        "tmdb_poster_path": _text("$.poster_path"),
    }
    return [c.alias(name) for name, c in columns.items()]


def lookup_table(keys: DataFrame, ref_search: DataFrame, ref_details: DataFrame) -> DataFrame:
    """All TMDB columns per search key that found an id, and ``corrupt``.

    Details are reduced to the ids in use first (a broadcast or a runtime filter
    when these are few), so that neither the choice of one reply per id nor the
    parsing sees the others; the choice needs no exchange beyond the join's. A
    missing or corrupt reply leaves the id with tmdb_enriched = 0.
    """
    by_id = ["endpoint", "language", "tmdb_id"]
    found = resolve_ids(keys, ref_search).filter(F.col("tmdb_id").isNotNull())
    replies = ref_details.filter(_told()).withColumnRenamed("id", "tmdb_id").select(*by_id, "json")
    used = replies.join(found.select(*by_id), by_id, "left_semi")
    chosen = found.join(used, by_id, "left").groupBy(*by_id, "title", "search_year").agg(F.max("json").alias("json"))
    parsed = chosen.select(*_KEY, "tmdb_id", "json", parsed_reply().alias("d"))
    return parsed.select(
        *_KEY, "tmdb_id", *detail_columns(), is_usable_reply().cast("int").alias("tmdb_enriched"),
        (F.col("json").isNotNull() & ~is_usable_reply()).alias("corrupt"),
    )


def lookup_of(named: DataFrame, ref_search: DataFrame, ref_details: DataFrame) -> DataFrame:
    """The lookup table for the searches of some files."""
    return lookup_table(distinct_search_keys(with_search_key(named)), ref_search, ref_details)


def _file_key(keyed: DataFrame, *columns: str) -> DataFrame:
    """Files without a search would all hash to one partition; their path as the
    title spreads them. With endpoint "" it meets no lookup row."""
    return keyed.select(
        *columns,
        F.col("endpoint").alias("_endpoint"),
        F.col("language").alias("_language"),
        F.when(F.col("endpoint") == "", F.col("file_path")).otherwise(F.col("title")).alias("_title"),
        F.coalesce("search_year", F.lit(-1)).alias("_year"),
    )


def _lookup_key(lookup: DataFrame, *columns) -> DataFrame:
    return lookup.select(
        F.col("endpoint").alias("_endpoint"), F.col("language").alias("_language"),
        F.col("title").alias("_title"), F.coalesce("search_year", F.lit(-1)).alias("_year"), *columns,
    )


_SAME = ["_endpoint", "_language", "_title", "_year"]


def enrich(named: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join of the TMDB columns to files with name columns; every file stays."""
    left = _file_key(with_search_key(named), *named.columns)
    joined = left.join(_lookup_key(lookup, *TMDB_COLUMNS), _SAME, "left")
    return joined.select(
        *named.columns, *TMDB_COLUMNS[:-1], F.coalesce("tmdb_enriched", F.lit(0)).alias("tmdb_enriched")
    )


def detail_errors(named: DataFrame, lookup: DataFrame, scan_ts: str) -> DataFrame:
    """Error rows (stage tmdb) of files whose detail reply is corrupt; the files stay."""
    bad = lookup.filter("corrupt").select(
        "endpoint", "language", "title", "search_year",
        F.concat(F.lit("corrupt details of id "), F.col("tmdb_id").cast("string")).alias("error"),
    )
    files = _file_key(with_search_key(named), "file_path", "filename")
    return files.join(_lookup_key(bad, "error"), _SAME).select(
        F.col("filename").alias("file"), F.col("file_path").alias("path"), "error",
        F.lit("tmdb").alias("stage"), F.lit(scan_ts).alias("time"),
    )
