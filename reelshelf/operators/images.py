"""Image facts from decoded sizes and EXIF tags."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import attributes as A

IMAGE_COLUMNS = [
    "image_width", "image_height", "image_megapixels", "camera_make", "camera_model", "date_taken",
]


def image_columns(images: DataFrame, key: str = "file_path") -> DataFrame:
    """IMAGES -> catalogue columns, one row per key; of several rows of a key the greatest, column by column."""
    facts = images.select(
        key,
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
        A.megapixels(F.col("width"), F.col("height")).alias("image_megapixels"),
        A.exif_text(F.col("exif"), "Make").alias("camera_make"),
        A.exif_text(F.col("exif"), "Model").alias("camera_model"),
        A.exif_text(F.col("exif"), "DateTimeOriginal").alias("date_taken"),
    )
    best = facts.groupBy(key).agg(F.max(F.struct(*IMAGE_COLUMNS)).alias("best"))
    return best.select(key, *[F.col("best")[c].alias(c) for c in IMAGE_COLUMNS])
