"""The file listing: what belongs to the catalogue, once per path, and what is unusable."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import names as N


def filter_extensions(files: DataFrame) -> DataFrame:
    return files.filter(N.is_allowed(N.filename(F.col("file_path"))))


def _problem() -> Column:
    """Why a listing row can't become a catalogue row; NULL when it can."""
    return (
        F.when(F.coalesce(F.col("file_path"), F.lit("")) == "", F.lit("missing path"))
        .when(F.col("size_bytes").isNull(), F.lit("missing size"))
        .when(F.col("size_bytes") < 0, F.lit("negative size"))
        .when(F.col("mtime").isNull(), F.lit("missing modification time"))
    )


def usable_files(files: DataFrame) -> DataFrame:
    return files.filter(_problem().isNull())


def listing_errors(files: DataFrame, scan_ts: str) -> DataFrame:
    """Rows that are dropped from the run, in the shape of the error table."""
    candidate = N.is_allowed(N.filename(F.col("file_path"))) | F.col("file_path").isNull()
    return files.filter(candidate & _problem().isNotNull()).select(
        F.coalesce(N.filename(F.col("file_path")), F.lit("")).alias("file"),
        F.coalesce(F.col("file_path"), F.lit("")).alias("path"),
        _problem().alias("error"),
        F.lit("processing").alias("stage"),
        F.lit(scan_ts).alias("time"),
    )


def distinct_paths(files: DataFrame) -> DataFrame:
    """One row per path. Overlapping roots list a path twice; the newest listing wins.

    ``max`` of a struct combines before the shuffle, so a path listed very often
    sends one row per input partition.
    """
    rest = [c for c in files.columns if c != "file_path"]
    lead = ["mtime", "size_bytes"]
    ranked = lead + [c for c in rest if c not in lead]
    newest = files.groupBy("file_path").agg(F.max(F.struct(*ranked)).alias("row"))
    return newest.select("file_path", *[F.col("row")[c].alias(c) for c in rest])


def file_inventory(files: DataFrame) -> DataFrame:
    """Usable files with an allowed extension, once per path."""
    return distinct_paths(filter_extensions(usable_files(files)))


def name_columns(files: DataFrame, as_of_year: int, scan_ts: str) -> DataFrame:
    """The listing plus everything that path, name and file system tell.

    Narrow steps: the path is split once, later expressions refer to columns.
    """
    path, name = F.col("file_path"), F.col("filename")
    split = files.select("*", N.components(path).alias("components"))
    parts = split.select(
        *files.columns,
        F.element_at("components", -1).alias("filename"),
        F.coalesce(F.try_element_at("components", F.lit(-2)), F.lit("")).alias("folder_name"),
        *[part.alias(alias) for alias, part in N.size_units(F.col("size_bytes")).items()],
    )
    typed = parts.select("*", N.extension(name).alias("extension"))
    placed = typed.select("*", N.classify(path, name, F.col("extension")).alias("folder"))
    created = F.col("ctime") if "ctime" in files.columns else F.lit(None).cast("timestamp")
    return placed.select(
        *[c for c in files.columns if c not in ("source_root", "ctime")],
        "filename", "folder_name", "extension",
        N.filename(F.col("source_root")).alias("source_root"),
        F.col("folder.media_type").alias("media_type"),
        F.col("folder.content_language").alias("folder_language"),
        N.size_mb(F.col("mebibytes")).alias("size_mb"),
        N.size_gb(F.col("gibibytes")).alias("size_gb"),
        N.iso_timestamp(created).alias("created_at_ts"),
        N.iso_timestamp(F.col("mtime")).alias("modified_at_ts"),
        F.lit(scan_ts).alias("scanned_at_ts"),
        F.coalesce(
            N.extract_year(name, as_of_year), N.extract_year(F.col("folder_name"), as_of_year)
        ).alias("extracted_year"),
        N.clean_title(name).alias("extracted_title"),
        N.season_number(name).alias("season_number"),
        N.episode_number(name).alias("episode_number"),
        N.parsed_resolution(name).alias("parsed_resolution"),
        N.parsed_source(name).alias("parsed_source"),
        (F.col("folder.content_language") == "pl").cast("int").alias("is_polish_production"),
    )
