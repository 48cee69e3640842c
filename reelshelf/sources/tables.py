"""Readers of the input tables, always with an explicit schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reelshelf import schemas
from reelshelf.operators.enrichment import explode_search


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a derived frame to a schema: cast what is there, NULL what is not."""
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A ready-made listing: the way to go for very many files."""
    return _read(spark, path, schemas.FILES, fmt)


def read_tracks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.TRACKS, fmt)


def read_images(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.IMAGES, fmt)


def read_search(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Search replies as candidates with a rank."""
    return explode_search(_read(spark, path, schemas.REF_SEARCH_REPLIES, fmt))


def read_details(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.REF_DETAILS, fmt)
