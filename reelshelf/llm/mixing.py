"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights, and target by size is a source's repetition
rate. A document is emitted floor(rate) times, plus once more with the remaining fraction as probability;
that draw comes from a hash of the seed and the document, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.llm.runtime import SPACE_CLASS, landed

_SLACK = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def draw(seed: int) -> Column:
    """A number from 0 to below 1 for the document: 52 bits of a digest of seed, id and text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source (null last) source_size and target: `share` times all sizes dealt out by weight, at most `most` times a source's size.

    sizes: source, size. What a full source can't take goes to the others by weight, until none is above.
    The table has a row per source; each round sends three sums of it to the driver.
    """
    of_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    table = landed(of_source.select("source", "source_size", weight.alias("weight")), "source-weights")
    full = F.col("source_size") * float(most)
    level = 0.0
    while True:
        taken = F.col("weight") * F.lit(level) >= full * (1 - _SLACK)
        everything, fixed, open_weight = table.agg(
            F.sum("source_size"), F.sum(F.when(taken, full)), F.sum(F.when(~taken, F.col("weight")))
        ).first()
        left = share * (everything or 0) - (fixed or 0.0)
        higher = left / open_weight if open_weight and left > 0 else level
        if higher <= level * (1 + _SLACK):
            break
        level = higher
    return table.select("source", "source_size", F.least(full, F.col("weight") * F.lit(level)).alias("target"))


def _planned(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """docs with __size, __source_size, __target and __copies."""
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns), word_count(F.col("text")).alias("__size"), draw(seed).alias("__draw"))
    targets = source_targets(own.select("source", F.col("__size").alias("size")), weights, share, most)
    targets = targets.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("__draw") < rate - F.floor(rate)).cast("int")
    joined = own.join(targets, F.col("source").eqNullSafe(F.col("__of")))
    return joined.withColumn("__copies", copies.cast("long"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """doc_id, size (words), source_size, target (of the source), copies, taken (words the mix takes of the row).

    A null text has size 0, a null source is the last one, an empty table gives no rows. Repeated rows
    share the draw. A source without words has target 0. Other columns are not read.
    """
    planned = _planned(docs.select("doc_id", "source", "text"), weights, share, most, seed)
    names = {"__size": "size", "__source_size": "source_size", "__target": "target", "__copies": "copies"}
    taken = F.col("__size") * F.col("__copies")
    return planned.select("doc_id", *(F.col(k).alias(v) for k, v in names.items()), taken.alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """The rows of docs as often as mix_plan says (not at all, once, or more); the columns stay, whatever they are called."""
    planned = _planned(docs, weights, share, most, seed)
    return planned.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
