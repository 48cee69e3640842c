"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash. A bucket that holds more bytes than a shard
may is split on one more bit, the others stay; a shard is a bucket that fits. Sizes are summed once at a
depth a little beyond the expected one, and only buckets still too large there are looked at with more bits.
Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.llm.runtime import landed

BITS = 60
#: Bits beyond the expected depth that one pass sums at.
MORE_BITS = 4


def document_hash() -> Column:
    """60 bits of a digest of id and text; the id keeps copies of a text apart."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _leading(h: Column, depth) -> Column:
    """The leading bits as a number; the depth may be a column."""
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """leaf_depth, leaf (leading bits), and of the bucket that holds it depth, bucket, shard_bytes, shard_docs.

    sizes: h, bytes. A bucket whose rows all have one hash can't be split and is a shard whatever its size.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    expected = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))))
    depth = min(BITS, expected + MORE_BITS)
    above, low, found, rest = 0, max(0, expected - MORE_BITS), None, sizes
    while True:
        leaves = rest.groupBy(_leading(F.col("h"), F.lit(depth)).alias("bucket")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("first"), F.max("h").alias("last")
        )
        leaves = landed(leaves, "leaves")
        best = _least_depth(leaves, depth, low, limit)
        if above < low:
            # leaves are looked at in the depths around the expected one; the few buckets above these stand for all their leaves
            tops = _summed(leaves.withColumn("bucket", _up("bucket", depth - low)).withColumn("depth", F.lit(low)), "bucket").drop("depth")
            higher = _least_depth(landed(tops, "leaves"), low, above, limit).filter(F.col("b.depth") < low).select(F.col("leaf").alias("top"), F.col("b").alias("a"))
            best = leaves.select(F.col("bucket").alias("leaf")).join(best, "leaf", "left").join(higher, _up("leaf", depth - low) == F.col("top"), "left")
            best = best.select("leaf", F.coalesce("a", "b").alias("b")).filter("b IS NOT NULL")
        placed = landed(best.select(F.lit(depth).alias("leaf_depth"), "leaf", "b.*"), "directory")
        found = placed if found is None else found.union(placed)
        open_leaves = landed(leaves.select(F.col("bucket").alias("leaf")).join(placed, "leaf", "left_anti"), "open-leaves")
        if depth == BITS or not open_leaves.limit(1).count():
            return found
        rest = rest.join(open_leaves, _leading(F.col("h"), F.lit(depth)) == F.col("leaf"), "left_semi")
        above = low = depth + 1
        depth = min(BITS, depth + 2 * MORE_BITS)


def _up(bucket: str, bits) -> Column:
    """The bucket so many bits higher up."""
    return F.call_function("shiftright", F.col(bucket), F.lit(bits) if isinstance(bits, int) else bits)


def _summed(buckets: DataFrame, *by: str) -> DataFrame:
    sums = [F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last")]
    return buckets.groupBy("depth", *by).agg(*sums)


def _least_depth(leaves: DataFrame, depth: int, low: int, limit: int) -> DataFrame:
    """leaf and b (depth, bucket, shard_bytes, shard_docs): of the buckets that hold it, from low to depth bits, the largest that is a shard."""
    each = leaves.withColumnRenamed("bucket", "leaf").withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(depth))))
    each = each.withColumn("bucket", _up("leaf", F.lit(depth) - F.col("depth")))
    fits = (F.col("bytes") <= limit) | (F.col("first") == F.col("last")) | (F.col("depth") == BITS)
    shards = _summed(each, "bucket").filter(fits).select("depth", "bucket", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    joined = each.select("leaf", "depth", "bucket").join(shards, ["depth", "bucket"])
    return joined.groupBy("leaf").agg(F.min_by(F.struct("depth", "bucket", "shard_bytes", "shard_docs"), "depth").alias("b"))


def shard_plan(docs: DataFrame, limit: int) -> DataFrame:
    """docs with __shard (leading bits as text, empty for one shard), __depth, __bytes, __shard_bytes, __shard_docs."""
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns), document_hash().alias("__h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("__bytes"))
    buckets = directory(own.select(F.col("__h").alias("h"), F.col("__bytes").alias("bytes")), limit)
    depths = [row[0] for row in buckets.select("leaf_depth").distinct().collect()]  # one for each round
    out = None
    for depth in depths:
        part = buckets.filter(F.col("leaf_depth") == depth).drop("leaf_depth")
        part = part.select("leaf", F.col("depth").alias("__depth"), F.col("bucket").alias("__bucket"), F.col("shard_bytes").alias("__shard_bytes"), F.col("shard_docs").alias("__shard_docs"))
        joined = own.join(part, _leading(F.col("__h"), F.lit(depth)) == F.col("leaf")).drop("leaf", "__h")
        out = joined if out is None else out.union(joined)
    if out is None:
        out = own.drop("__h").select("*", F.lit(0).alias("__depth"), F.lit(0).cast("long").alias("__bucket"), F.lit(0).cast("long").alias("__shard_bytes"), F.lit(0).cast("long").alias("__shard_docs"))
    bits = F.when(F.col("__depth") == 0, "").otherwise(F.lpad(F.bin("__bucket"), F.col("__depth"), F.lit("0")))
    return out.withColumn("__shard", bits).drop("__bucket")


def shard_table(docs: DataFrame, limit: int) -> DataFrame:
    """Per row doc_id, n_bytes, shard, depth, shard_bytes, shard_docs.

    The bytes of a text are those of its UTF-8 form, a null text has none. Shards have at most limit bytes,
    except where one document, or rows equal in id and text, exceed it alone. An empty table gives no rows;
    other columns are not read.
    """
    names = {"__bytes": "n_bytes", "__shard": "shard", "__depth": "depth", "__shard_bytes": "shard_bytes", "__shard_docs": "shard_docs"}
    return shard_plan(docs.select("doc_id", "text"), limit).select("doc_id", *(F.col(k).alias(v) for k, v in names.items()))


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """docs as Parquet in a folder shard=<bits> for each shard, dealt out so that one task writes a shard."""
    plan = shard_plan(docs, limit).withColumn("shard", F.concat(F.lit("s"), "__shard"))
    plan = plan.drop("__shard", "__depth", "__bytes", "__shard_bytes", "__shard_docs")
    plan.repartition("shard").write.partitionBy("shard").parquet(path)
