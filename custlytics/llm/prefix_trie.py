"""A trie of conversation prefixes: how many conversations share each beginning, and what lies below it.

A prefix is known by 128 bits, the exclusive or of a hash of each of its turns together with the turn's
position; a prefix without its last turn is found by taking that turn's hash out again. One aggregate
enumerates the distinct prefixes and counts the conversations of each.

What lies below a node is summed over shards. A node belongs to the smallest conversation that has it. Of each
conversation that owns a node, one shard gets the whole path from the root, so that every shard holds a
whole (if thin) trie: a minimal perfect hash gives each distinct prefix of the shard a slot, a slot keeps its
128 bits and every look-up is compared with them, and counts lie in flat arrays by slot. The array of parent
slots carries sums upwards, deepest nodes first. The sums of a node over all shards are its sums in the whole
trie, as each owned node is in one shard with all its ancestors. No key gathers rows: a prefix that
a third of all conversations share is a slot in every shard.

Paths longer than ``BAND`` turns are cut into bands of that many turns, each with a shard of its own; what lies
in the deeper bands of a path is added to the band's last node beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from custlytics.llm.common import mixed
from custlytics.operators import ordered
from custlytics.session import checkpointed

#: Rows of paths that a shard gets on average.
SHARD_ROWS = 500_000
#: Turns of a path that one shard gets, and of which hashes are run together in one task.
BAND = 4096
#: A parent of more nodes than this, and than one in ``MOST_CROWDED`` of all rows, is crowded.
MANY_CHILDREN, MOST_CROWDED = 500, 10_000
#: Characters of a list of ids that travel as one row.
LIST_CHARACTERS = 1 << 16
#: Slots tried per key and level of the minimal perfect hash.
_LOOSENESS = 2

SUMS = "p1 bigint, p2 bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
NO_IDS = hashlib.sha256(b"").hexdigest()


class MinimalPerfectHash:
    """Numbers distinct 64-bit keys from 0 without gaps. A key takes a place of the first level where no other
    key falls on it; its number is the count of taken places before. Keys not given get any number, or -1."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        taken = 0
        while len(keys):
            places = self._places(keys, len(self.levels), _LOOSENESS * len(keys))
            once = np.bincount(places, minlength=_LOOSENESS * len(keys)) == 1
            self.levels.append((np.where(once, np.cumsum(once) - 1 + taken, -1), len(once)))
            taken += int(once.sum())
            keys = keys[~once[places]]

    @staticmethod
    def _places(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)) % np.uint64(n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        numbers = np.full(len(keys), -1, np.int64)
        open_keys = np.arange(len(keys))
        for level, (slots, n) in enumerate(self.levels):
            numbers[open_keys] = slots[self._places(keys[open_keys], level, n)]
            open_keys = open_keys[numbers[open_keys] < 0]
        return numbers


class NodeTable:
    """Slots of the distinct (p1, p2), each verified against all 128 bits."""

    def __init__(self, p1: np.ndarray, p2: np.ndarray):
        distinct = np.unique(np.stack([p1, p2], axis=1), axis=0)
        self.salt = 0
        while True:
            keys = self._keys(distinct[:, 0], distinct[:, 1])
            if len(np.unique(keys)) == len(keys):
                break
            self.salt += 1
        self.hash = MinimalPerfectHash(keys)
        self.p1, self.p2 = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slots = self.hash(keys)
        self.p1[slots], self.p2[slots] = distinct[:, 0], distinct[:, 1]

    def _keys(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        return mixed(p1.view(np.uint64) + np.uint64(self.salt)) ^ p2.view(np.uint64)

    def slots(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        found = self.hash(self._keys(p1, p2))
        if (found < 0).any() or (self.p1[found] != p1).any() or (self.p2[found] != p2).any():
            raise KeyError("a prefix that is not in this shard")
        return found


def shard_sums(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(p1, p2, children, leaves, saved) by slot, of a shard's paths."""
    table = NodeTable(rows["p1"], rows["p2"])
    slots, n = table.slots(rows["p1"], rows["p2"]), len(table.p1)
    depth, parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    depth[slots] = rows["depth"]
    inner = rows["up"]  # the parent is in the same band
    parent[slots[inner]] = table.slots(rows["q1"][inner], rows["q2"][inner])
    children, leaves, saved = (np.zeros(n, np.int64) for _ in range(3))
    np.add.at(children, parent[slots[inner & rows["owned"]]], 1)
    for sums, name in ((children, "children"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(sums, slots, rows[name])
    deepest_first = np.argsort(-depth, kind="stable")
    deepest_first = deepest_first[parent[deepest_first] >= 0]
    for level in np.split(deepest_first, np.flatnonzero(np.diff(depth[deepest_first])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    return table.p1, table.p2, children, leaves, saved


def _shard_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = {name: pa.chunked_array([b.column(name) for b in held]).to_numpy() for name in held[0].schema.names}
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in shard_sums(rows)], names=[c.split()[0] for c in SUMS.split(", ")])


def numbered_turns(conversations: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """(conv_id, pos, t1, t2, words): turns numbered from 1 by ``turn`` (null first), each by two hashes of (role,
    text) and its number of words ``[^\\x20\\x09-\\x0D]+``.

    Null role and text are empty. Turns of one number go by role and then by hash. Rows of null conv_id
    belong to no conversation and are left out."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    numbered = ordered.ordered_columns(slim, ["conv_id"], ["turn", "role", "t1", "t2"], running={"pos": "row_number"}, max_group_rows=max_group_rows)
    return numbered.select("conv_id", "pos", "t1", "t2", "words")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, t1, t2, words, length) of numbered turns, with a row of depth 0 for each conversation."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "t1", "t2", "words")]
    whole = turns.join(lengths, "conv_id").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "words", "length")
    return whole.union(lengths.select("conv_id", *none, "length"))


def shared_head_paths(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """:func:`paths` of conversations rebuilt to share beginnings: the first h turns of conversation c are those of
    conversation c - c % ``every`` (all, if it has fewer; none, if there is none), h the CRC-32 of the decimal c
    modulo ``most``; c's own turns after its first h follow, if any. A conversation may be left without turns."""
    head = F.when(F.col("pos") < most, F.struct("pos", "t1", "t2", "words"))
    each = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(head)).alias("head"))
    each = each.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    donors = each.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), "head")
    each = each.drop("head").withColumn("donor", F.col("conv_id") - F.col("conv_id") % every).join(donors, "donor", "left")
    each = each.withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h").cast("int"))).otherwise(F.array()))
    taken = F.size("head").cast("bigint")
    each = each.withColumn("taken", taken).withColumn("length", taken + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.join(each.select("conv_id", "h", "taken", "length"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "words", "length")
    zero = F.lit(0).cast("bigint")
    root = F.struct(zero.alias("pos"), zero.alias("t1"), zero.alias("t2"), zero.alias("words"))
    begin = each.select("conv_id", F.explode(F.concat(F.array(root), "head")).alias("x"), "length")
    return own.union(begin.select("conv_id", "x.pos", "x.t1", "x.t2", "x.words", "length"))


def _hashed(path_rows: DataFrame, band: int) -> DataFrame:
    """Adds the 128 bits (p1, p2) of each prefix and (q1, q2) of the prefix without its last turn."""
    zero = F.lit(0).cast("bigint")
    m1 = F.when(F.col("depth") > 0, F.xxhash64("depth", "t1", "t2")).otherwise(zero)
    m2 = F.when(F.col("depth") > 0, F.xxhash64(F.lit(2), "t2", "t1", "depth")).otherwise(zero)
    rows = path_rows.select("conv_id", "depth", "words", "length", m1.alias("m1"), m2.alias("m2"), F.floor(F.col("depth") / band).alias("part"))
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"p1": F.bit_xor("m1").over(upto), "p2": F.bit_xor("m2").over(upto)})
    # What the parts before hold; conversations of one part have none.
    parts = path_rows.filter(F.col("length") >= band).select("conv_id", F.floor(F.col("depth") / band).alias("part"), m1.alias("m1"), m2.alias("m2"))
    parts = parts.groupBy("conv_id", "part").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "part", F.bit_xor("m1").over(before).alias("c1"), F.bit_xor("m2").over(before).alias("c2"))
    rows = rows.join(carried.filter("part > 0"), ["conv_id", "part"], "left")
    p1, p2 = (F.col(f"p{k}").bitwiseXOR(F.coalesce(f"c{k}", zero)) for k in (1, 2))
    return rows.select(
        "conv_id", "depth", "words", "length", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("m1")).alias("q1"), p2.bitwiseXOR(F.col("m2")).alias("q2")
    )


def _shard_rows(rows: DataFrame, nodes: DataFrame, owners: DataFrame, band: int) -> DataFrame:
    """The paths of owning conversations: their own nodes with what they count, and the nodes above without."""
    zero = F.lit(0).cast("bigint")
    own = nodes.select("conv_id", "depth", "p1", "p2", "q1", "q2", F.lit(True).alias("owned"), "leaf", "saved")
    above = rows.join(owners.select("conv_id", "top"), "conv_id").filter("depth < top")
    above = above.select("conv_id", "depth", "p1", "p2", "q1", "q2", F.lit(False).alias("owned"), zero.alias("leaf"), zero.alias("saved"))
    whole = own.union(above).withColumn("band", F.greatest(F.floor((F.col("depth") - 1) / band), F.lit(0)))
    # Sums of a path's deeper bands, for the last node of each band.
    deep = whole.filter(F.col("depth") > band).groupBy("conv_id", "band")
    first = F.col("owned") & (F.col("depth") == F.col("band") * band + 1)
    deep = deep.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved_below"), F.max(first.cast("bigint")).alias("children"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = deep.select(
        "conv_id", (F.col("band") * band).alias("depth"), "children", F.sum("leaves").over(below).alias("leaves"), F.sum("saved_below").over(below).alias("saved_below")
    )
    plain = whole.select("*", zero.alias("children"), zero.alias("leaves"), zero.alias("saved_below"))
    at_edge = (F.col("depth") % band == 0) & (F.col("depth") > 0)
    edges = whole.filter(at_edge).join(deep, ["conv_id", "depth"], "left").select(*whole.columns, *[F.coalesce(c, zero).alias(c) for c in ("children", "leaves", "saved_below")])
    up = (F.col("depth") == 1) | ((F.col("depth") > 0) & ((F.col("depth") - 1) % band != 0))
    return plain.filter(~at_edge).union(edges).select(
        "conv_id", "band", "depth", "p1", "p2", "q1", "q2", "owned", up.alias("up"), "children",
        (F.col("leaf") + F.col("leaves")).alias("leaves"), (F.col("saved") + F.col("saved_below")).alias("saved"),
    )


def _id_lists(ends: DataFrame, n: int) -> DataFrame:
    """(p1, p2, ends_sha256): the hash of each node's ids, ascending and comma-joined.

    Ids are sorted and joined to stretches in ranges, so that a node of very many ids is written by many tasks;
    the hash itself can only be run from the first byte to the last, and streams over the stretches."""
    columns = ["p1", "p2", "conv_id"]
    laid_out = ends.select(*columns).repartitionByRange(n, *columns).sortWithinPartitions(*columns)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, ids = (batch.column(c).to_numpy() for c in columns)
            cuts = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
            step = LIST_CHARACTERS // 21
            starts = np.unique(np.concatenate([np.arange(0, len(ids), step), cuts])) if len(ids) else cuts
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])] if len(ids) else []
            yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in (p1, p2, ids)), pa.array(texts, pa.string())], names=[*columns, "ids"])

    stretches = laid_out.mapInArrow(joined, "p1 bigint, p2 bigint, conv_id bigint, ids string")
    stretches = stretches.repartition(n, "p1", "p2").sortWithinPartitions(*columns)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if (p1, p2) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _lists(done)
        if key is not None:
            yield _lists([(*key, state.hexdigest())])

    return stretches.mapInArrow(hashed, "p1 bigint, p2 bigint, ends_sha256 string")


def _lists(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["p1", "p2", "ends_sha256"])


def _with_parents(tops: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """(p1, p2, parent): the smallest conversation of the parent of each given node.

    Parents of more than ``many`` of them, such as the root, would send their children to one task; there are
    at most ``MOST_CROWDED`` of these, and they are broadcast."""
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    crowded = tops.groupBy("q1", "q2").agg(F.count("*").alias("n")).filter(F.col("n") > many).drop("n")
    crowded = F.broadcast(checkpointed(above.join(crowded, ["q1", "q2"])))
    few = tops.join(crowded, ["q1", "q2"], "left_anti").join(above, ["q1", "q2"])
    return tops.join(crowded, ["q1", "q2"]).unionByName(few).select("p1", "p2", "parent")


def trie(path_rows: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """The nodes of the trie of ``path_rows`` (:func:`paths`): (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).

    Each distinct sequence of a conversation's first ``depth`` turns is a node, the root (depth 0) among them.
    (conv_id, depth) names a node: conv_id is the smallest conversation that begins with it;
    ``parent_conv_id`` names its parent in the same way (root: null). ``n_convs`` conversations begin with it,
    ``n_children`` nodes follow it, ``n_leaves`` nodes without children are in its subtree (itself
    included); ``saved_tokens`` sums (n_convs - 1) times the words of the last turn over its subtree;
    ``ends_sha256`` is the SHA-256 of the ids of conversations that end with it, ascending, comma-joined.

    No conversations give no rows, not even a root. Turns are compared by 128-bit hashes.
    """
    rows = checkpointed(_hashed(path_rows, band))
    nodes = rows.groupBy("p1", "p2").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "words", "q1", "q2")],
        F.max("length").alias("longest"),
    )
    leaf = (F.col("longest") == F.col("depth")).cast("bigint").alias("leaf")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    nodes = checkpointed(nodes.select("p1", "p2", "q1", "q2", "conv_id", "depth", "n_convs", leaf, saved))
    top = F.min_by(F.struct("p1", "p2", "q1", "q2"), "depth").alias("node")
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), top)

    n_rows = rows.count()
    n = max(-(-n_rows // shard_rows), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = _shard_rows(rows, nodes, owners, band).repartition(n, "conv_id", "band").drop("conv_id", "band")
    sums = dealt.mapInArrow(_shard_task, SUMS).groupBy("p1", "p2").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])

    # Below its first own node a conversation owns the parents too.
    tops = owners.filter("top > 0").select("node.p1", "node.p2", "node.q1", "node.q2")
    tops = _with_parents(tops, nodes, max(MANY_CHILDREN, n_rows // MOST_CROWDED))
    ends = _id_lists(rows.filter("depth = length"), n)
    whole = nodes.join(sums, ["p1", "p2"]).join(tops, ["p1", "p2"], "left").join(ends, ["p1", "p2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    return whole.select(
        "conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """:func:`trie` of whole conversations (conv_id, turn, role, text) as they are.

    Null role and text are empty, null turns come first; rows of null conv_id are left out; repeated rows are
    repeated turns; an empty table gives no rows; other columns are not read."""
    return trie(paths(numbered_turns(conversations, max_group_rows)))


def shared_head_trie(conversations: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """:func:`trie` of conversations rebuilt by :func:`shared_head_paths`; odd rows as in :func:`conversation_trie`."""
    return trie(shared_head_paths(numbered_turns(conversations, max_group_rows)))
