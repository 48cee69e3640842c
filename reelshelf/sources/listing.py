"""Listing of library folders, level by level in tasks, and what has changed since the last listing.

The folders of a level are a table; tasks list them, and the folders they find are the next level. Hidden names
are listed like others. A folder or file that can't be read, or whose name isn't UTF-8, is an error row. The
driver holds only the roots. Tasks list through the file system they see, so the roots have to be mounted on
all executors; for other stores land a listing table and use ``sources.tables.read_files``.
"""

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf import schemas
from reelshelf.functions import fixed_values as V
from reelshelf.functions import names as N
from reelshelf.operators.inventory import filter_extensions
from reelshelf.session import landed, scratch_dir
from reelshelf.sources.state_table import StateTable

logger = logging.getLogger(__name__)

FOLDERS_PER_TASK = 64
_FOUND = "path string, source_root string, folder boolean, size_bytes long, modified double, changed double, error string"
_NO_TEXT = "name is not UTF-8"


def library_roots(media_root: str) -> list[str]:
    """The known library folders below one media root."""
    return [f"{media_root.rstrip('/')}/{name}" for name in V.ROOT_FOLDERS]


def _local(root: str) -> str:
    if root.startswith("file:"):
        return "/" + root[len("file:") :].lstrip("/")
    if "://" in root:
        raise ValueError(f"tasks can't list {root}: land a listing table and read it with sources.tables.read_files")
    return root


def _row(path: str, root: str, folder: bool = False, size: int = 0, modified: float = 0.0, changed: float = 0.0, error: str | None = None) -> tuple:
    """An entry; one whose name is no text is told by what can be shown of it."""
    try:
        path.encode()
    except UnicodeEncodeError:
        path, error = os.fsencode(path).decode(errors="replace"), _NO_TEXT
    return path, root, folder and error is None, size, modified, changed, error


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    for batch in batches:
        for path, root in zip(batch["path"], batch["source_root"]):
            rows = []
            try:
                with os.scandir(path) as found:
                    for entry in found:
                        try:
                            if entry.is_dir(follow_symlinks=False):
                                rows.append(_row(entry.path, root, True))
                            elif not entry.is_dir():
                                about = entry.stat()
                                rows.append(_row(entry.path, root, False, about.st_size, about.st_mtime, about.st_ctime))
                        except OSError as error:
                            rows.append(_row(entry.path, root, error=error.strerror))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            except OSError as error:
                rows.append(_row(path, root, error=f"folder not listed: {error.strerror}"))
            if rows:
                yield pd.DataFrame(rows, columns=names)


@dataclass(frozen=True)
class Listing:
    files: DataFrame   # FILES, allowed extensions only
    errors: DataFrame  # what couldn't be read, in the shape of ERRORS


def list_roots(spark: SparkSession, roots: list[str]) -> DataFrame:
    """FILES of all roots; a missing root is reported and skipped, what can't be read is left out."""
    return walk_roots(spark, roots, "").files


def walk_roots(spark: SparkSession, roots: list[str], scan_ts: str) -> Listing:
    """Files and error rows of all roots.

    Links to folders are not followed. Each level is written to the scratch folder before the next begins.
    """
    present = []
    for root in roots:
        if os.path.isdir(_local(root)):
            present.append((_local(root).rstrip("/") or "/", root.rstrip("/")))
        else:
            logger.warning("root folder not accessible: %s", root)
    if not present:
        return Listing(spark.createDataFrame([], schemas.FILES), spark.createDataFrame([], schemas.ERRORS))
    out = scratch_dir(spark, "listing")
    level, depth = spark.createDataFrame(present, "path string, source_root string"), 0
    folders = len(present)
    while folders:
        tasks = -(-folders // FOLDERS_PER_TASK)
        level.repartition(tasks).mapInPandas(_entries, _FOUND).write.parquet(f"{out}/level={depth}")
        level = spark.read.parquet(f"{out}/level={depth}").filter("folder").select("path", "source_root")
        folders, depth = level.count(), depth + 1

    def moment(c: str):
        return F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")).cast("timestamp_ntz")

    found = spark.read.parquet(out)
    files = found.filter("NOT folder AND error IS NULL").select(
        F.col("path").alias("file_path"), "source_root", "size_bytes", moment("modified").alias("mtime"), moment("changed").alias("ctime"),
    )
    errors = found.filter("error IS NOT NULL").select(
        N.filename(F.col("path")).alias("file"), "path", "error", F.lit("listing").alias("stage"), F.lit(scan_ts).alias("time"),
    )
    return Listing(filter_extensions(files), errors)


def listing_changes(files: DataFrame, snapshot: StateTable) -> DataFrame:
    """Against the stored listing: new and changed files with deleted NULL, files that are no longer there with deleted true.

    ``snapshot`` is a StateTable with the schema FILES; see ``keep_listing``. One join by path, to which the
    stored listing stays where it is.
    """
    known = snapshot.load().select("file_path", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_known"))
    listed = files.withColumn("_listed", F.lit(True))
    both = listed.join(known, "file_path", "full")
    same = F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    changed = both.filter(F.col("_known").isNull() | F.col("_listed").isNull() | ~same)
    return changed.select(*files.columns, F.when(F.col("_listed").isNull(), F.lit(True)).alias("deleted"))


def landed_changes(files: DataFrame, snapshot: StateTable) -> DataFrame:
    """listing_changes, landed: for a caller that acts on the changes and then keeps them."""
    return landed(listing_changes(files, snapshot), "listing-changes")


def keep_listing(changes: DataFrame, snapshot: StateTable, number: int) -> bool:
    """Bring the stored listing up to date with the landed changes of listing ``number``; False when it is already."""
    gone = changes.filter("deleted").select("file_path")
    return snapshot.append_delta(changes.filter("deleted IS NULL"), f"listing-{number}", gone)
