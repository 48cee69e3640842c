"""Incremental runs: what is unchanged, what to redo, what to forget."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.functions.numbers import exact_round


def _reuse(enrichment: bool, force_if_missing: bool) -> Column:
    """Of a hit: keep the stored row unless it still lacks enrichment that is on."""
    if enrichment and force_if_missing:
        return F.coalesce(F.col("tmdb_enriched"), F.lit(0)) != 0
    return F.lit(True)


def lookup(files: DataFrame, state: DataFrame, enrichment: bool = True, force_if_missing: bool = True) -> DataFrame:
    """files plus ``hit`` and ``reuse`` (0/1). Reads only the state's key columns."""
    known = state.select(
        "file_path", F.col("mtime").alias("_mtime"), F.col("size_bytes").alias("_size"), "tmdb_enriched"
    )
    joined = files.join(known, "file_path", "left")
    hit = F.coalesce(
        (F.col("mtime") == F.col("_mtime")) & (F.col("size_bytes") == F.col("_size")), F.lit(False)
    )
    return joined.select(
        *files.columns,
        hit.cast("int").alias("hit"),
        (hit & _reuse(enrichment, force_if_missing)).cast("int").alias("reuse"),
    )


def reusable(files: DataFrame, state: DataFrame, enrichment: bool = True, force_if_missing: bool = True) -> DataFrame:
    """State rows of listed, unchanged files that need no new work."""
    kept = lookup(files, state, enrichment, force_if_missing).filter("reuse = 1").select("file_path")
    return state.join(kept, "file_path", "left_semi").select(*state.columns)


def to_process(files: DataFrame, state: DataFrame, enrichment: bool = True, force_if_missing: bool = True) -> DataFrame:
    """Listed files that have no reusable state row: one join by path, the layout that unique paths already have."""
    return lookup(files, state, enrichment, force_if_missing).filter("reuse = 0").select(*files.columns)


def prune(state: DataFrame, files: DataFrame) -> DataFrame:
    """State without the paths that are no longer listed."""
    return state.join(files.select("file_path"), "file_path", "left_semi")


def deleted(state: DataFrame, files: DataFrame) -> DataFrame:
    """The paths a prune drops."""
    return state.join(files.select("file_path"), "file_path", "left_anti").select("file_path")


def upsert(state: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace stored ones of the same path. ``new`` is unique per path.

    Old rows not replaced, plus the new rows: the wide rows move once and no
    column needs a coalesce.
    """
    untouched = state.join(new.select("file_path"), "file_path", "left_anti")
    return untouched.unionByName(new.select(*state.columns))


def run_statistics(decisions: DataFrame, catalog: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: rows, total GB, hits, misses, hit rate in percent, error rows.

    Three one-row aggregates, stacked and folded once more: no join at all.
    """
    counts = decisions.agg(
        F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses")
    )
    totals = catalog.agg(
        F.count("*").alias("total"),
        # three-digit values: a decimal sum is exact in any order
        F.sum(F.col("size_gb").cast("decimal(24,3)")).alias("size_gb"),
    )
    failed = errors.agg(F.count("*").alias("errors"))
    names = ["total", "size_gb", "hits", "misses", "errors"]
    row = (
        counts.unionByName(totals, allowMissingColumns=True)
        .unionByName(failed, allowMissingColumns=True)
        .agg(*[F.max(n).alias(n) for n in names])
    )
    return _with_rate(row)


def _with_rate(row: DataFrame) -> DataFrame:
    seen = F.col("hits") + F.col("misses")
    rate = exact_round(F.try_divide("hits", seen) * F.lit(100.0), 1)
    return row.select(
        "total", F.coalesce(F.col("size_gb").cast("double"), F.lit(0.0)).alias("size_gb"),
        "hits", "misses", F.coalesce(rate, F.lit(0.0)).alias("rate"), "errors",
    )


def statistics_row(spark: SparkSession, total: int, size_gb: Decimal | None, hits: int, misses: int, errors: int) -> DataFrame:
    """The same row from numbers that the run's writes have counted."""
    counts = {"total": total, "hits": hits, "misses": misses, "errors": errors}
    row = spark.range(1).select(
        *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()],
        F.lit(None if size_gb is None else str(size_gb)).cast("decimal(24,3)").alias("size_gb"),
    )
    return _with_rate(row)
