"""N-gram Jaccard join by a token-group matrix.

Texts are sets of word shingles; two link at a similarity of 80 % or more. In any common order, a linked pair
shares shingles among the first quarter of either set: of a text with n shingles at least n / 25 (a fifth of
n can miss in the other set, so a quarter less a fifth is left over, a twentieth of the smaller set). Only that
quarter is indexed (hash order, with shingles that a sample shows in many texts last), and what shares too little
of it goes no further. The join has two rounds:

1. Partition. Each text is compared with one text of those it shares an index entry with: the one with
   which it shares most, among the smallest ids of the entries. Links found here give groups of similar texts.
2. Matrix. Groups are cut into blocks of bounded size; each block stores the union of its texts' shingles,
   and the index says which blocks a text of another group must be held against. The overlap with the union
   bounds that with any text inside; only blocks where the bound suffices are opened, text by text.

Links in one group need no second look, since they would join what is already joined; every pair of texts of
different groups that can link is bounded or compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.llm.components import components
from reelshelf.llm.runtime import Landing, landed, python_ready
from reelshelf.llm.shingles import mixed, shingle_sets, slices

#: Similarity of 80 %: 5 * overlap >= 4 * union.
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 20  # of a block's texts together; a longer text has a block of its own
SAMPLE = 16  # one text in so many shows which shingles are frequent
FREQUENT_IN_SAMPLE = 4
FREQUENT_MOST = 100_000  # entries of the list that goes to all tasks; the order changes speed only, not results

_NULL_ID = -(1 << 63) + 1  # can be negated


def _enough(overlap: Column, a: Column, b: Column) -> Column:
    return 5 * overlap >= 4 * (a + b - overlap)


def _set_hashes(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    count = np.diff(begins)
    out = np.zeros(len(count), np.uint64)
    if len(shingles):
        full = count > 0
        out[full] = np.add.reduceat(mixed(shingles ^ np.uint64(0x5BE0CD19137E2179)), begins[:-1][full])
    return mixed(out + count.astype(np.uint64))


_ROWS = "kind string, token long, id long, sig long, sig2 long, n int"


def _set_rows(frequent: np.ndarray):
    """One pass over the texts: of each text a row of kind set (size and two hashes of its set), and its index entries."""
    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            shingles, begins = shingle_sets(batch.column("text"))
            count = np.diff(begins)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            same, other = _set_hashes(shingles, begins), _set_hashes(mixed(shingles), begins)
            yield _row_batch("set", np.zeros(len(ids), np.uint64), ids, same, other, count)
            order = np.lexsort((ids, same))
            chosen = np.zeros(len(count), bool)
            chosen[order[np.append(True, same[order][1:] != same[order][:-1])[: len(order)]]] = True  # of equal sets in a batch the smallest id
            text = np.repeat(np.arange(len(count)), count)
            late = np.zeros(len(shingles), bool)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
                late = frequent[at] == shingles
            order = np.lexsort((shingles, late, text))
            rank = np.arange(len(text)) - begins[text]
            keep = (rank < count[text] // 4 + 1) & chosen[text]
            token, text = shingles[order][keep], text[keep]
            yield _row_batch("entry", token, ids[text], same[text], np.zeros(len(text), np.uint64), count[text])

    return rows


def _row_batch(kind: str, token, ids, sig, sig2, n) -> pa.RecordBatch:
    kinds = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(ids), np.int8)), pa.array([kind])).cast(pa.string())
    columns = [kinds, pa.array(token.view(np.int64)), pa.array(ids), pa.array(sig.view(np.int64)), pa.array(sig2.view(np.int64)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROWS.split(", ")])


def _tokens(batches):
    for batch in (part for whole in batches for part in slices(whole)):
        shingles, _ = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64))], names=["token"])


def _sets(batches):
    for batch in (part for whole in batches for part in slices(whole)):
        shingles, begins = shingle_sets(batch.column("text"))
        sets = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(shingles.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), sets], names=["id", "tokens"])


def _frequent(texts: DataFrame) -> np.ndarray:
    """Shingles that many different texts of the sample have, at most FREQUENT_MOST, sorted."""
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    seen = sample.mapInArrow(_tokens, "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT_IN_SAMPLE)
    rows = seen.orderBy(F.desc("count"), "token").limit(FREQUENT_MOST).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint64))


def _least_shared(n: Column) -> Column:
    """Index entries that a text of n shingles has in common with each text it links with: at least n / 25 + 1 / 4.

    A set of m has m // 4 + 1 entries and m // 5 at most that miss in the other set; that leaves m / 20 + 1 / 4
    or more, for the smaller set of the two, which has at least 4 / 5 of n.
    """
    return F.ceil((4 * n + 25) / 100)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").filter(_enough(overlap, F.size("ta"), F.size("tb"))).select("a", "b")


def _like_sizes(a: Column, b: Column) -> Column:
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def _narrowed(index: DataFrame, land: Landing) -> DataFrame:
    """Entries that more than one text has, of texts with enough of them; least is an entry's smallest id.

    What is shared is landed first: then both sides of the join are plain shuffles, of which Spark splits a hot token's.
    """
    least = index.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most")
    shared = land(least.select("token", "least"), "shared-tokens")
    found = land(index.join(shared, "token"), "shared-index")
    likely = found.groupBy("id", "n").count().filter(F.col("count") >= _least_shared(F.col("n"))).select("id").distinct()
    entries = land(found.join(likely, "id", "left_semi"), "index")
    land.drop(shared, found)
    return entries


def similar_groups(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (the smallest doc_id reachable over links).

    A null or empty text has no shingles and no links. Rows with one doc_id are one node, with the links of
    all of them; a null doc_id is a node too, the smallest, and shows as null. Repeated rows give equal rows,
    an empty table none; other columns are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), "text")
    land = Landing(spark)
    rows = land(texts.mapInArrow(_set_rows(_frequent(texts)), _ROWS), "sets-and-entries")
    signed = land(rows.filter("kind = 'set'").select("id", F.col("n").cast("long").alias("n"), "sig", "sig2"), "set-signatures")

    # equal sets: everyone hangs on the smallest id; a side that is landed first lets Spark split a hot set's rows
    first = signed.filter("n > 0").groupBy("sig", "sig2").agg(F.min("id").alias("b"), F.count("*").alias("k")).filter("k > 1")
    equal = signed.filter("n > 0").join(land(first, "repeated-sets"), ["sig", "sig2"]).filter("id != b")
    equal = land(equal.select(F.col("id").alias("a"), "b", "sig").distinct(), "equal-sets")

    index = rows.filter("kind = 'entry'").select("token", "id", "sig", "n")
    once = _narrowed(index, land)
    # once more, without equal sets and what has gone with the first pass; an id's other texts stay
    copies = equal.select(F.col("a").alias("id"), "sig")
    entries = _narrowed(once.drop("least").join(copies, ["id", "sig"], "left_anti").drop("sig"), land)
    land.drop(rows, once)
    needed_sizes = entries.groupBy("id").agg(F.max("n").alias("n"))
    needed = needed_sizes.select("id")
    sets = land(texts.join(needed, "id").mapInArrow(_sets, "id long, tokens array<long>"), "token-sets")

    # round 1: each text and the one of the least ids with which it shares most entries
    votes = entries.filter("id != least").groupBy("id", "n", "least").count().filter(F.col("count") >= _least_shared(F.col("n")))
    best = votes.groupBy("id").agg(F.max(F.struct("count", -F.col("least"))).alias("best"))
    best = best.select(F.col("id").alias("a"), (-F.col("best").getField("col2")).alias("b"))
    near = land(_linked(best, sets), "near-links")
    groups = land(components(near), "near-groups") if near.limit(1).count() else near.select(F.col("a").alias("node"), F.col("b").alias("component"))

    # round 2: the matrix of index entries and blocks of groups
    weight = needed_sizes.withColumnRenamed("id", "node")
    sizes = groups.join(weight, "node").groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    sizes = sizes.select("component", "texts", blocks.alias("blocks"))
    member = groups.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("group"), "texts", "blocks")
    placed = entries.join(member, "id", "left").select(
        "token", "id", "n", F.coalesce("group", "id").alias("group"), F.coalesce("texts", F.lit(1)).alias("texts"), F.coalesce("blocks", F.lit(1)).alias("blocks"),
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = land(placed.withColumn("block", block).drop("blocks"), "matrix")
    cells = placed.groupBy("token", F.col("group").alias("other"), F.col("block").alias("other_block")).agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.first("texts").alias("other_texts")
    )
    # of two groups, the texts of the smaller one ask the blocks of the larger one
    asks = F.struct("texts", "group") < F.struct(F.col("other_texts").alias("texts"), F.col("other").alias("group"))
    fits = (5 * F.col("n") >= 4 * F.col("n_min")) & (5 * F.col("n_max") >= 4 * F.col("n"))
    asked = placed.join(cells, "token").filter(asks & fits).groupBy("id", "n", "other", "other_block").agg(F.count("*").alias("common"))
    asked = land(asked.filter(F.col("common") >= _least_shared(F.col("n"))).select("id", "other", "other_block"), "asked")

    blocks = asked.select("other", "other_block").distinct()
    inside = placed.select("id", "n", F.col("group").alias("other"), F.col("block").alias("other_block")).distinct()
    unions = (
        inside.join(blocks, ["other", "other_block"]).join(sets, "id").groupBy("other", "other_block")
        .agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"), F.min("n").alias("n_min"))
    )
    n, most = F.size("tokens"), F.size(F.array_intersect("tokens", "union"))
    # a text of n shingles needs 4/9 of n and the other's size, and 4/5 of its own size, in common
    open_blocks = asked.join(sets, "id").join(unions, ["other", "other_block"]).filter((5 * most >= 4 * n) & (9 * most >= 4 * (n + F.col("n_min"))))
    opened = land(open_blocks.select("id", "other", "other_block"), "open-blocks")
    ask = placed.join(opened, "id").select("token", F.col("id").alias("a"), F.col("n").alias("na"), "other", "other_block")
    within = placed.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("group").alias("other"), F.col("block").alias("other_block"))
    pairs = ask.join(within, ["token", "other", "other_block"]).filter(_like_sizes(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    far = _linked(pairs, sets)

    links = land(equal.select("a", "b").union(near).union(far), "all-links")
    found = components(links)
    signed = landed(signed.select("id", "n"), "set-sizes")
    land.drop()
    joined = signed.join(found, signed.id == found.node, "left")
    show = lambda c: F.when(c != _NULL_ID, c).cast(kind)
    return joined.select(show(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), show(F.coalesce("component", "id")).alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group one row of docs, with all its columns: that with the group's smallest doc_id; where this has several rows, the text of the least digest.

    A doc_id is one document, as in similar_groups. Texts without shingles, null or empty, are groups of their
    own (but for their doc_id), a null doc_id is one, too. An empty table gives no rows.
    """
    groups = similar_groups(docs.select("doc_id", "text"))
    gone = landed(groups.filter("NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    left = docs.join(gone, docs.doc_id.eqNullSafe(gone["__gone"]), "left_anti")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        digest = F.struct(F.col("text").isNull(), F.xxhash64("text"))
        first = landed(left.groupBy(F.col("doc_id").alias("__of")).agg(F.min(digest).alias("__least")), "first-texts")
        left = left.withColumn("__text", digest)
        left = left.join(first, left.doc_id.eqNullSafe(first["__of"]) & (left["__text"] == first["__least"]), "left_semi")
        left = left.dropDuplicates(["doc_id"]).drop("__text")
    return left
