"""The prefix trie of conversations, from ternary search trees over dictionary-encoded turns.

Turns (role and text) get numbers from a dictionary; a conversation is the sequence of its turns' numbers. Sequences
are sorted by range into shards, and a shard is gone through in blocks of bounded size. A block's sequences go
into a ternary search tree: at every turn a binary tree by number, below each number the tree of the next turn.
The middle sequence is put in first, then the middles of both halves, which keeps the binary trees
balanced. An iterative walk then adds up members, leaves and savings.

What a block can't know alone is the nodes on the paths of its first and its last sequence, which a neighbour
may have as well. These boundary nodes go on, in order, to a merge with those of the next blocks, until a single run
of blocks is left. A merge holds one path at a time; nodes that leave it for good are done.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.llm.runtime import landed, python_ready

#: Fixed values of the rebuilding: conversations of one hundred share a beginning of up to five turns.
FAMILY, BEGINNINGS = 100, 6

#: Turns and conversations of a block.
BLOCK_TURNS = 50_000
#: Shards whose boundary nodes one task merges.
MERGED = 64

_NODES = (
    "kind string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, turn long, size long, leftmost boolean, shard long, seq long, ids string"
)
_FIELDS = [x.split()[0] for x in _NODES.split(", ")]
_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([pa.field(name, _TYPES[kind]) for name, kind in (x.split() for x in _NODES.split(", "))])
_NOBODY = hashlib.sha256(b"").hexdigest()


def _key(parent: bytes, turn: int) -> bytes:
    return hashlib.blake2b(parent + turn.to_bytes(8, "big", signed=True), digest_size=16).digest()


ROOT_KEY = bytes(16)


class TernaryTree:
    """Sequences of numbers; each node holds a number, the members below it, its smallest member, and who ends there."""

    def __init__(self):
        self.turn: list[int] = []
        self.size: list[int] = []
        self.less: list[int] = []
        self.more: list[int] = []
        self.next: list[int] = []
        self.n: list[int] = []
        self.least: list[int] = []
        self.ends: list[list[int] | None] = []
        self.top = -1

    def _node(self, turn: int, size: int) -> int:
        self.turn.append(turn)
        self.size.append(size)
        for links in (self.less, self.more, self.next):
            links.append(-1)
        self.n.append(0)
        self.least.append(1 << 63)
        self.ends.append(None)
        return len(self.turn) - 1

    def put(self, turns: list[int], sizes: list[int], members: list[int]) -> None:
        """A sequence of one turn or more, and its members in ascending order."""
        links, at = None, 0
        for turn, size in zip(turns, sizes):
            node = self.top if links is None else links[at]
            while node >= 0 and self.turn[node] != turn:
                links, at = (self.less if turn < self.turn[node] else self.more), node
                node = links[at]
            if node < 0:
                node = self._node(turn, size)
                if links is None:
                    self.top = node
                else:
                    links[at] = node
            self.n[node] += len(members)
            self.least[node] = min(self.least[node], members[0])
            links, at = self.next, node
        self.ends[at] = members

    def put_sorted(self, sequences: list[tuple[list[int], list[int], list[int]]]) -> None:
        """The middle one first, then the middles of both halves."""
        ranges = [(0, len(sequences))]
        while ranges:
            begin, end = ranges.pop()
            if begin < end:
                middle = (begin + end) // 2
                self.put(*sequences[middle])
                ranges += [(begin, middle), (middle + 1, end)]

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, depth, its parent's place in this list or -1), parents before children, siblings by number."""
        found: list[tuple[int, int, int]] = []
        stack = [(self.top, 1, -1, False)] if self.top >= 0 else []
        while stack:
            node, depth, parent, passed = stack.pop()
            if not passed:
                if self.more[node] >= 0:
                    stack.append((self.more[node], depth, parent, False))
                stack.append((node, depth, parent, True))
                if self.less[node] >= 0:
                    stack.append((self.less[node], depth, parent, False))
            else:
                found.append((node, depth, parent))
                if self.next[node] >= 0:
                    stack.append((self.next[node], depth + 1, len(found) - 1, False))
        return found


def _digest(members: list[int] | None) -> str:
    return hashlib.sha256(",".join(map(str, members)).encode()).hexdigest() if members else _NOBODY


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(name) for row in rows], kind) for name, kind in zip(_FIELDS, _SCHEMA.types)], schema=_SCHEMA)


def block_nodes(sequences: list[tuple[list[int], list[int], list[int]]], shard: int, number: int) -> tuple[list[dict], list[dict]]:
    """The finished rows of a block, and its boundary nodes with what they have in this block, parents before children.

    sequences: (turns, sizes, members), sorted and different. Of the root and of nodes on the first and the last sequence's path only parts are known.
    """
    tree = TernaryTree()
    nobody = [x for x in sequences if not x[0]]
    tree.put_sorted([x for x in sequences if x[0]])
    walk = tree.walk()
    count = len(walk)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    firsts, lasts = sequences[0][0], sequences[-1][0]
    on_first, on_last = [False] * count, [False] * count
    for i, (node, depth, parent) in enumerate(walk):
        above = parent < 0
        on_first[i] = (above or on_first[parent]) and depth <= len(firsts) and firsts[depth - 1] == tree.turn[node]
        on_last[i] = (above or on_last[parent]) and depth <= len(lasts) and lasts[depth - 1] == tree.turn[node]
    shared = [a or b for a, b in zip(on_first, on_last)]
    root = {"children": 0, "leaves": 0, "saved": 0}
    for i in range(count - 1, -1, -1):
        node, _, parent = walk[i]
        if shared[i]:
            continue
        if not children[i]:
            leaves[i] = 1
        saved[i] += (tree.n[node] - 1) * tree.size[node]
        if parent < 0:
            root["children"] += 1
            root["leaves"] += leaves[i]
            root["saved"] += saved[i]
        else:
            children[parent] += 1
            leaves[parent] += leaves[i]
            saved[parent] += saved[i]
    done, border = [], []
    members = nobody[0][2] if nobody else None
    everyone = sum(len(x[2]) for x in sequences)
    border.append({
        "kind": "border", "key": ROOT_KEY, "conv_id": min(x[2][0] for x in sequences), "depth": 0, "n_convs": everyone, "n_children": root["children"],
        "n_leaves": root["leaves"], "saved_tokens": root["saved"], "turn": 0, "size": 0, "leftmost": True, "shard": shard,
    })
    lists = [(ROOT_KEY, members)] if members else []
    keys: dict[int, bytes] = {-1: ROOT_KEY}
    for i, (node, depth, parent) in enumerate(walk):
        row = {
            "conv_id": tree.least[node], "depth": depth, "n_convs": tree.n[node], "n_children": children[i], "n_leaves": leaves[i], "saved_tokens": saved[i],
        }
        if shared[i]:
            keys[i] = _key(keys[parent], tree.turn[node])
            border.append(row | {
                "kind": "border", "key": keys[i], "parent_key": keys[parent], "turn": tree.turn[node], "size": tree.size[node], "leftmost": on_first[i], "shard": shard,
            })
            if tree.ends[node]:
                lists.append((keys[i], tree.ends[node]))
        else:
            row |= {"kind": "done", "ends_sha256": _digest(tree.ends[node])}
            if parent < 0 or shared[parent]:
                row["parent_key"] = keys[parent]
            else:
                row["parent_conv_id"] = tree.least[walk[parent][0]]
            done.append(row)
    done += [{"kind": "ends", "key": key, "shard": shard, "seq": number, "ids": ",".join(map(str, ids))} for key, ids in lists]
    return done, border


class Merge:
    """Boundary nodes of neighbouring blocks, taken in order."""

    def __init__(self, last: bool = False):
        """last: no neighbours are left on either side."""
        self.last, self.path, self.kept, self.done, self.begun = last, [], [], [], False

    def _leave(self, depth: int) -> None:
        """Nodes from the depth on leave the path, lowest first."""
        while len(self.path) > depth:
            node = self.path.pop()
            if node["leftmost"] and not self.last:
                continue  # the block before may have it, too
            node["gone"] = True
            row = {k: node[k] for k in ("key", "parent_key", "conv_id", "depth", "n_convs", "n_children")} | {
                "kind": "merged", "n_leaves": node["n_leaves"] + (node["n_children"] == 0), "saved_tokens": node["saved_tokens"] + (node["n_convs"] - 1) * node["size"],
            }
            self.done.append(row)
            if self.path:
                above = self.path[-1]
                above["n_children"] += 1
                above["n_leaves"] += row["n_leaves"]
                above["saved_tokens"] += row["saved_tokens"]

    def take(self, row: dict) -> None:
        """The next node; the nodes of a block come parents first, in order."""
        depth = row["depth"]
        if len(self.path) > depth and self.path[depth]["key"] == row["key"]:
            node = self.path[depth]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += row[name]
            if depth == 0:
                self.begun = True  # a further block: its first path is not the whole run's
            return
        self._leave(depth)
        node = dict(row, parent_key=row.get("parent_key"), gone=False)
        node["leftmost"] = row["leftmost"] and not self.begun
        self.path.append(node)
        self.kept.append(node)

    def finished(self) -> list[dict]:
        """What is done so far."""
        rows, self.done = self.done, []
        self.kept = [x for x in self.kept if not x["gone"]]
        return rows

    def rest(self, shard: int) -> list[dict]:
        """After the last node: everything, or the boundary nodes of the whole run in order."""
        if self.last:
            self._leave(0)
            return self.finished()
        border = [x for x in self.kept if not x["gone"]]
        return [x | {"kind": "border", "shard": shard, "seq": i} for i, x in enumerate(border)]


def _blocks(batches, block_turns: int):
    """Sorted sequences with their members, cut into blocks; a sequence with very many members may go over several."""
    block, turns_in_block = [], 0
    for batch in batches:
        for conv_id, turns, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "sizes"))):
            if turns_in_block >= block_turns:
                yield block
                block, turns_in_block = [], 0
            if block and block[-1][0] == turns:
                block[-1][2].append(conv_id)
                turns_in_block += 1
            else:
                block.append((turns, sizes, [conv_id]))
                turns_in_block += 1 + len(turns)
    if block:
        yield block


def _shard_rows(block_turns: int):
    def rows(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        merge = Merge()
        for number, block in enumerate(_blocks(batches, block_turns)):
            done, border = block_nodes(block, shard, number)
            for row in border:
                merge.take(row)
            yield _rows(done + merge.finished())
        yield _rows(merge.rest(shard))

    return rows


def _merged(last: bool):
    def rows(batches):
        merge, group = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["group"] != group:
                    if merge:
                        found += merge.finished() + merge.rest(group)
                    merge, group = Merge(last), row["group"]
                merge.take(row)
            yield _rows(found + merge.finished())
        if merge:
            yield _rows(merge.rest(group))

    return rows


def _list_digests(batches):
    """Pieces of lists in order: one digest a key. Holds a piece at a time."""
    key, digest = None, None
    for batch in batches:
        keys, digests = [], []
        for of, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if of != key:
                if digest:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = of, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "digest"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "digest"])


def encoded_turns(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn's number, code points of its text) in order. rows: conv_id, turn, role, text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    own = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has_turn"), "turn",
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.length(text).cast("long").alias("size"),
    )
    own = landed(own, "turns")
    numbers = landed(own.select("h1", "h2").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-numbers")
    # pre-ordered by digest among equal turn numbers, so that the order doesn't hang on the dictionary's
    one = F.struct("has_turn", "turn", "h1", "h2", "id", "size")
    turns = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))
    return own.join(numbers, ["h1", "h2"]).groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations with their first h turns taken from the first conversation of their hundred."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % BEGINNINGS).cast("int")
    heads = conversations.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, BEGINNINGS - 1).alias("head"))
    joined = conversations.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    none = F.array().cast(conversations.schema["turns"].dataType)
    begin = F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)
    return joined.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def trie_nodes(conversations: DataFrame, block_turns: int = BLOCK_TURNS, together: int = MERGED) -> DataFrame:
    """Per trie node conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. conversations: conv_id (different ones), turns as encoded_turns gives them."""
    spark = conversations.sparkSession
    python_ready(spark)
    flat = conversations.select("conv_id", F.transform("turns", lambda x: x["id"]).alias("turns"), F.transform("turns", lambda x: x["size"]).alias("sizes"))
    flat = landed(flat, "sequences")
    dealt = flat.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    found = landed(dealt.mapInArrow(_shard_rows(block_turns), _NODES), "trie-nodes", by=["kind"])
    done, ends = found.filter("kind = 'done'"), found.filter("kind = 'ends'")
    merged, border = found.filter("kind = 'merged'"), found.filter("kind = 'border'")
    groups = border.agg(F.max("shard")).first()[0]
    while groups is not None:
        groups //= together
        own = border.withColumn("group", F.floor(F.col("shard") / together).cast("long"))
        dealt = own.repartition("group").sortWithinPartitions("group", "shard", "seq")
        further = landed(dealt.mapInArrow(_merged(groups == 0), _NODES), "trie-nodes", by=["kind"])
        merged = merged.unionByName(further.filter("kind = 'merged'"))
        border = further.filter("kind = 'border'")
        if groups == 0:
            break
    digests = ends.repartition("key").sortWithinPartitions("key", "shard", "seq").mapInArrow(_list_digests, "key binary, digest string")
    parts = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = merged.select("key", "parent_key", *parts).join(digests, "key", "left")
    shared = landed(shared.withColumn("ends_sha256", F.coalesce("digest", F.lit(_NOBODY))).drop("digest"), "boundary-nodes")
    above = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_ = done.filter("parent_key IS NOT NULL").select("parent_key", *parts, "ends_sha256").unionByName(shared.drop("key"))
    named = open_.join(above, "parent_key", "left").withColumnRenamed("found", "parent_conv_id")
    return done.filter("parent_key IS NULL").select(*columns).unionByName(named.select(*columns))


def prefix_trie(rows: DataFrame, block_turns: int = BLOCK_TURNS, together: int = MERGED) -> DataFrame:
    """The trie of the rebuilt conversations, a row a node.

    rows: conv_id, turn, role, text. A null role or text is empty, a null turn comes first, turns of equal number
    are ordered by a digest of role and text; rows that repeat are turns of their own. Rows without a conv_id belong
    to no conversation. An empty table gives no rows; other columns are not read.
    """
    return trie_nodes(landed(rebuilt(encoded_turns(rows)), "rebuilt"), block_turns, together)
