"""The catalogue row: listing, names, titles, tracks, images, score."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf import schemas
from reelshelf.functions import fixed_values as V
from reelshelf.operators import enrichment, images as image_ops, inventory, scoring
from reelshelf.operators.track_errors import range_errors
from reelshelf.operators.track_fold import FOLDED_COLUMNS, fold_by_file


@dataclass(frozen=True)
class Inputs:
    """The tables of one run. ``key`` joins files to tracks and images."""

    files: DataFrame
    tracks: DataFrame
    images: DataFrame
    ref_search: DataFrame | None = None
    ref_details: DataFrame | None = None
    key: str = "file_path"
    track_chunk: object = None
    track_files: DataFrame | None = None  # the files whose tracks are folded, where it isn't all
    lookup: DataFrame | None = None  # enrichment.lookup_of(...), where a run has it already
    named: DataFrame | None = None  # inventory.name_columns(files, ...), where a run has it already

    def of(self, files: DataFrame) -> "Inputs":
        return replace(self, files=files)


_ZERO_WITHOUT_TRACKS = {
    f.name for f in schemas.CATALOG.fields if not f.nullable and f.name in FOLDED_COLUMNS
}


def build_catalog(inputs: Inputs, as_of_year: int, scan_ts: str, enrich: bool = True, unique: bool = False) -> DataFrame:
    """One CATALOG row per usable file.

    Titles are joined while the row is still narrow; after that the listing moves
    once more, by its key, to meet the folded tracks and the images. Pass
    ``unique=True`` for a listing whose paths are known to be unique and usable.
    """
    named = inputs.named
    if named is None:
        listing = inputs.files if unique else inventory.file_inventory(inputs.files)
        named = inventory.name_columns(listing, as_of_year, scan_ts)
    if enrich and inputs.ref_search is not None:
        lookup = inputs.lookup
        if lookup is None:
            # The searches come from the raw listing: they need no unique paths.
            raw = inventory.filter_extensions(inventory.usable_files(inputs.files))
            lookup = enrichment.lookup_of(inventory.name_columns(raw, as_of_year, scan_ts), inputs.ref_search, inputs.ref_details)
        named = enrichment.enrich(named, lookup)
    else:
        nulls = [f for f in schemas.CATALOG.fields if f.name in enrichment.TMDB_COLUMNS[:-1]]
        named = named.select(
            "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in nulls], F.lit(0).alias("tmdb_enriched")
        )

    key = inputs.key
    folded = fold_by_file(inputs.tracks, key, inputs.track_chunk, inputs.track_files)
    # few rows, laid out by key like the folded ones: no further shuffle of these
    folded = folded.join(range_errors(inputs.tracks, key), key, "left")
    folded = folded.select(
        F.col(key).alias("_track_key"), *FOLDED_COLUMNS, "audio_language_code", "attribute_error",
        scoring.quality_score().alias("quality_score"),
    )
    pictures = image_ops.image_columns(inputs.images, key).withColumnRenamed(key, "_image_key")
    is_photo = F.col("media_type") == "photography"
    joined = named.join(folded, (F.col(key) == F.col("_track_key")) & ~is_photo, "left").join(
        pictures, (F.col(key) == F.col("_image_key")) & is_photo, "left"
    )
    return joined.selectExpr(*[_final_column(f) for f in schemas.CATALOG.fields])


def _final_column(field) -> str:
    """SQL text: 130 columns in one call instead of several calls per column."""
    name, kind = field.name, field.dataType.simpleString()
    if name == "content_language":
        value = "coalesce(audio_language_code, folder_language)"
    elif name == "processing_error":
        value = f"CASE WHEN media_type <> 'photography' AND _track_key IS NULL THEN '{V.PROBE_FAILED}' ELSE attribute_error END"
    elif name in _ZERO_WITHOUT_TRACKS:
        value = f"coalesce({name}, 0)"
    else:
        value = name
    return f"CAST({value} AS {kind}) AS {name}"
