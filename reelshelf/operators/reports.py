"""Whole-catalogue reports. All combine before the shuffle; groups are few."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.operators.report_partials import LANGUAGE_FLAGS, QUALITY_FLAGS, bit_rate_bands


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Files and bytes by media type and root, with subtotals (NULL = all)."""
    return catalog.rollup("media_type", "source_root").agg(
        F.count("*").alias("files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.sum(F.col("size_gb").cast("decimal(24,3)")).cast("double").alias("total_gb"),
        F.grouping_id().cast("int").alias("level"),
    )


def quality_breakdown(catalog: DataFrame) -> DataFrame:
    """Per media type: flag counts, bit-rate bands and score quantiles.

    The exact percentile keeps one counter per distinct score; the score has at
    most 21 values, so its buffer doesn't grow with the data.
    """
    bands = bit_rate_bands(F.col("overall_bitrate_kbps"))
    return catalog.groupBy("media_type").agg(
        F.count("*").alias("files"),
        *[F.sum(f).alias(f"{f}_files") for f in QUALITY_FLAGS],
        *[F.count_if(c).alias(name) for name, c in bands.items()],
        F.count("quality_score").alias("scored_files"),
        F.avg("quality_score").alias("avg_score"),
        F.max("quality_score").alias("max_score"),
        *[F.percentile("quality_score", F.lit(q / 100)).alias(f"score_p{q}") for q in (25, 50, 75)],
    )


def language_coverage(catalog: DataFrame) -> DataFrame:
    """Files per media type, language and kind (audio, subtitles), long form.

    Sums the 14 flags first and unpivots the few result rows.
    """
    sums = catalog.groupBy("media_type").agg(
        F.count("*").alias("files"), *[F.sum(flag).alias(flag) for _, _, flag in LANGUAGE_FLAGS]
    )
    entries = F.array(*[
        F.struct(F.lit(code).alias("language"), F.lit(kind).alias("kind"), F.col(flag).alias("covered"))
        for code, kind, flag in LANGUAGE_FLAGS
    ])
    return sums.select("media_type", "files", F.explode(entries).alias("e")).select(
        "media_type", "e.language", "e.kind", "files", F.col("e.covered").alias("covered_files")
    )
