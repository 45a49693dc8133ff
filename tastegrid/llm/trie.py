"""A prefix trie over conversations: range splitters, the skeleton of their paths, and sorted shards."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import groups, keep

#: Bytes of a turn's digest; a path is the digests of its turns in a row, and sorts like the path.
DIGEST = 16
#: Conversations are put together from their own turns and the beginning of the first of five.
FAMILY, MOST_SHARED = 5, 8


@dataclass(frozen=True)
class TrieConfig:
    """Sizes of shards and samples; the result does not depend on any of them."""

    shard_turns: int = 2_048
    most_shards: int = 1 << 16
    samples_per_shard: int = 32
    most_samples: int = 1 << 18
    #: Turns of all sampled paths together that reach the driver; longer paths are cut, and then separate less finely.
    most_sampled_turns: int = 1 << 22


def turn_digest(role: Column, text: Column) -> Column:
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * DIGEST))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest``; a null role or text is empty. Rows without ``conv_id`` are no
    conversation's and are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", turn_digest(F.col("role"), F.col("text")))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of every rebuilt conversation: the digests of its turns in a row and the bytes of each text.

    Conversation c begins with the first h turns of c - c % 5 and goes on with its own behind its first h, where h is the
    crc32 of c modulo 9. Turns ascend by ``turn``, null first, and by digest where that is equal. Only digests are
    shuffled, once, by family.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = turns(conversations).select(base.alias("base"), "conv_id", F.struct("turn", "digest", F.octet_length("text").alias("size")).alias("t"))
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, MOST_SHARED)), ignorenulls=True)
    own = own.withColumn("head", first.over(Window.partitionBy("base")))
    shared = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    own = own.withColumn("h", shared)
    beginning = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("own", 1, 0))
    whole = F.concat(beginning, F.slice("own", F.col("h") + 1, F.size("own")))
    path = F.unhex(F.array_join(F.transform("whole", lambda t: F.hex(t["digest"])), ""))
    return own.select("conv_id", whole.alias("whole")).select("conv_id", path.alias("path"), F.transform("whole", lambda t: t["size"]).alias("sizes"))


# Splitters -----------------------------------------------------------------------------------------------------------

_FIRST = -(1 << 63)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths begin alike."""
    n = min(len(a), len(b)) // DIGEST
    for k in range(n):
        if a[k * DIGEST : (k + 1) * DIGEST] != b[k * DIGEST : (k + 1) * DIGEST]:
            return k
    return n


def choose_splitters(sample: list[tuple[bytes, bool, int, list[int]]], shards: int) -> list[tuple[bytes, int, list[int]]]:
    """Up to ``shards - 1`` keys ``(path, conv_id)`` with the turns' sizes that divide the sorted sample evenly.

    A splitter is the shortest beginning that tells a sampled path from the one before it; among equal paths it is the
    whole path and the conversation's id, so that many copies are divided as well.
    """
    sample = sorted(sample, key=lambda s: (s[0], s[2]))
    found: dict[tuple[bytes, int], list[int]] = {}
    for k in range(1, shards):
        i = k * len(sample) // shards
        if not 0 < i < len(sample):
            continue
        (before, *_), (path, cut, conv, sizes) = sample[i - 1], sample[i]
        if path != before:
            length = shared_turns(before, path) + 1
            found[(path[: length * DIGEST], _FIRST)] = sizes[:length]
        else:
            found[(path, _FIRST if cut else conv)] = sizes
    return [(path, conv, sizes) for (path, conv), sizes in sorted(found.items())]


class Skeleton:
    """The trie of the splitters' paths: ``depth``, ``parent``, ``size`` (bytes of the last text) and ``turn`` of each node
    from the root, number 0; ``ways``: the nodes along each splitter's path, from depth 1."""

    def __init__(self, splitters: list[tuple[bytes, int, list[int]]]):
        self.keys = [(path, conv) for path, conv, _ in splitters]
        self.depth, self.parent, self.size, self.turn = [0], [-1], [0], [None]
        self.ways: list[list[int]] = []
        before, way = b"", []
        for path, _, sizes in splitters:
            way = way[: shared_turns(before, path)]
            for k in range(len(way), len(path) // DIGEST):
                self.parent.append(way[-1] if way else 0)
                self.depth.append(k + 1)
                self.size.append(sizes[k])
                self.turn.append(path[k * DIGEST : (k + 1) * DIGEST])
                way = [*way, len(self.depth) - 1]
            self.ways.append(way)
            before = path
        self.children = [0] * len(self.depth)
        self.below = list(self.size)
        for node in range(len(self.depth) - 1, 0, -1):
            self.children[self.parent[node]] += 1
            self.below[self.parent[node]] += self.below[node]

    def nodes(self, spark: SparkSession) -> DataFrame:
        names = ["skeleton", "depth", "parent_skeleton", "skeleton_children", "bytes_below", "turn"]
        columns = [pa.array(c, pa.int64()) for c in (range(len(self.depth)), self.depth, self.parent, self.children, self.below)]
        return spark.createDataFrame(pa.table([*columns, pa.array(self.turn, pa.binary())], names=names))

    def above_ends(self, spark: SparkSession) -> DataFrame:
        """``skeleton, ancestor``: the skeleton's childless nodes with all above them and themselves."""
        pairs = {(way[-1] if way else 0, a) for way in self.ways for a in (0, *way) if not self.children[way[-1] if way else 0]}
        if not self.ways:
            pairs = {(0, 0)}
        ends, above = zip(*sorted(pairs)) if pairs else ((), ())
        return spark.createDataFrame(pa.table([pa.array(ends, pa.int64()), pa.array(above, pa.int64())], names=["skeleton", "ancestor"]))


def sample_splitters(paths: DataFrame, config: TrieConfig) -> Skeleton | None:
    """Splitters from a sample of bounded size that grows with the number of shards; None of an empty table."""
    counts = paths.agg(F.count("*").alias("convs"), F.coalesce(F.sum(F.size("sizes")), F.lit(0)).alias("turns")).head()
    if not counts["convs"]:
        return None
    shards = max(1, min(config.most_shards, -(-(counts["convs"] + counts["turns"]) // config.shard_turns)))
    wanted = min(config.most_samples, config.samples_per_shard * shards)
    longest = max(16, config.most_sampled_turns // wanted)
    taken = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(wanted)
    taken = taken.select(F.substring("path", 1, longest * DIGEST).alias("path"), (F.size("sizes") > longest).alias("cut"), "conv_id", F.slice("sizes", 1, longest).alias("sizes"))
    return Skeleton(choose_splitters([(bytes(r.path), r.cut, r.conv_id, r.sizes) for r in taken.collect()], shards))


# Shards --------------------------------------------------------------------------------------------------------------

_PART = "skeleton long, shard int, conv_id long, depth long, parent_conv_id long, parent_skeleton long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, turn binary"


def _first_difference(row: np.ndarray, depth: np.ndarray, same: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per row the number of leading cells for which ``same`` holds."""
    out = lengths.copy()
    differs = ~same
    np.minimum.at(out, row[differs], depth[differs])
    return out


def shard_nodes(shard: int, paths: list[bytes], convs: np.ndarray, sizes: np.ndarray, borders: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
    """All nodes of a sorted shard: final rows of those within it, and the shard's part of the skeleton's.

    Cells ``(conversation, depth)`` are laid out by depth; a node is the run of cells from one that its conversation does
    not share with the one before. Sums over subtrees go up depth by depth.
    """
    data = np.frombuffer(b"".join(paths), dtype=np.uint64).reshape(-1, 2)
    lengths = np.array([len(p) // DIGEST for p in paths], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(lengths)])
    row = np.repeat(np.arange(len(paths)), lengths)
    depth = np.arange(len(row)) - offset[row]
    # What each conversation shares with the one before it, and with the splitters beside the shard.
    above = np.where(row > 0, row - 1, 0)
    twin = offset[above] + depth
    comparable = (row > 0) & (depth < lengths[above])
    same = comparable.copy()
    same[comparable] = (data[np.flatnonzero(comparable)] == data[twin[comparable]]).all(axis=1)
    shared = _first_difference(row, depth, same, lengths)
    order = np.argsort(depth, kind="stable")
    fresh = (depth >= shared[row])[order]
    start = np.flatnonzero(fresh)
    node = np.empty(len(row), dtype=np.int64)
    node[order] = np.cumsum(fresh) - 1
    first = order[start]
    k = len(start)
    level = depth[first] + 1
    parent = np.where(level > 1, node[first - 1], -1) if k else np.zeros(0, dtype=np.int64)
    n_convs = np.diff(np.append(start, len(order)))
    lowest = np.minimum.reduceat(convs[row[order]], start) if k else np.zeros(0, dtype=np.int64)
    skeleton = np.full(k, -1, dtype=np.int64)
    for path, way in borders:
        border = np.frombuffer(path, dtype=np.uint64).reshape(-1, 2)
        inside = depth < len(border)
        alike = inside.copy()
        alike[inside] = (data[np.flatnonzero(inside)] == border[depth[inside]]).all(axis=1)
        begins = _first_difference(row, depth, alike, lengths)
        on = level <= begins[row[first]]
        skeleton[on] = np.array(way, dtype=np.int64)[level[on] - 1]
    local = skeleton < 0
    children = np.bincount(parent[local & (parent >= 0)], minlength=k) if k else np.zeros(0, dtype=np.int64)
    leaves = (local & (children == 0)).astype(np.int64)
    saved = np.where(local, n_convs - 1, n_convs) * sizes[first]
    bounds = np.searchsorted(level, np.arange(1, (level[-1] if k else 0) + 2))
    for d in range(len(bounds) - 2, 0, -1):
        part = slice(bounds[d], bounds[d + 1])
        np.add.at(leaves, parent[part], leaves[part])
        np.add.at(saved, parent[part], saved[part])
    # Members that end in a node stand next to each other, by id.
    end = np.full(len(paths), -1, dtype=np.int64)
    end[lengths > 0] = node[offset[1:][lengths > 0] - 1]
    cuts = np.flatnonzero(np.diff(end)) + 1
    ends: dict[int, str] = {int(end[a]): ",".join(map(str, convs[a:b].tolist())) for a, b in zip([0, *cuts], [*cuts, len(paths)])}
    written = [_hash(ends.get(i, "")) if own else ends.get(i, "") for i, own in enumerate(local.tolist())]
    top = bounds[1] if k else 0
    parent_skeleton = np.where(parent >= 0, skeleton[parent], 0) if k else parent
    on_skeleton = np.append(~local, True)
    number = np.append(skeleton, 0)
    columns = {
        "skeleton": pa.array(number, mask=~on_skeleton),
        "shard": pa.array(np.full(k + 1, shard, dtype=np.int32)),
        "conv_id": pa.array(np.append(lowest, convs.min())),
        "depth": pa.array(np.append(level, 0)),
        "parent_conv_id": pa.array(np.append(lowest[parent] if k else parent, 0), mask=np.append((parent_skeleton >= 0) | ~local, True)),
        "parent_skeleton": pa.array(np.append(parent_skeleton, 0), mask=np.append((parent_skeleton < 0) | ~local, True)),
        "n_convs": pa.array(np.append(n_convs, len(paths))),
        "n_children": pa.array(np.append(children, local[:top].sum())),
        "n_leaves": pa.array(np.append(leaves, leaves[:top].sum())),
        "saved_tokens": pa.array(np.append(saved, saved[:top].sum())),
        "ends": pa.array([*written, ends.get(-1, "")], pa.string()),
        "turn": pa.array([*_cells(data, first), None], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _cells(data: np.ndarray, chosen: np.ndarray) -> list[bytes]:
    whole = np.ascontiguousarray(data[chosen]).tobytes()
    return [whole[i : i + DIGEST] for i in range(0, len(whole), DIGEST)]


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _joined_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the stretches of ids of each skeleton node, in order, without holding them together."""
    held, digest = None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for number, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
            if number != held:
                if digest:
                    done.append((held, digest.hexdigest()))
                held, digest = number, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if digest:
        done.append((held, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["skeleton", "ends_sha256"])


NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(paths: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """All nodes of the trie over ``paths`` (``conv_id, path, sizes``): :data:`NODE_COLUMNS` and ``turn``, the digest of a
    node's last turn, null at the root.

    A bounded sample gives splitters ``(path, conv_id)`` that divide the sorted conversations into even shards, copies of
    one conversation included. A node whose members lie on both sides of a splitter begins the splitter's path; the trie
    of these paths, the skeleton, is broadcast. A sorted shard finishes all its other nodes by itself and gives its part of
    the skeleton's, which are added up. A turn count of one conversation is not split: its path, 16 bytes a turn, and
    sizes are one row. No conversations give no nodes, not even a root.
    """
    spark = paths.sparkSession
    paths = keep(paths, "trie-paths")
    skeleton = sample_splitters(paths, config)
    if skeleton is None:
        return spark.createDataFrame([], _PART).withColumn("ends_sha256", F.col("ends")).select(*NODE_COLUMNS, "turn")
    shared = spark.sparkContext.broadcast((skeleton.keys, skeleton.ways))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _ = shared.value
        for batch in batches:
            rows = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect_right(keys, row) for row in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ways = shared.value
        for table in groups(batches, ["shard"]):
            shard = table.column("shard")[0].as_py()
            # The splitters on either side: no other skeleton node has members in the shard.
            borders = [(keys[i][0], ways[i]) for i in (shard - 1, shard) if 0 <= i < len(keys)]
            sizes = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            convs = table.column("conv_id").to_numpy()
            yield shard_nodes(shard, table.column("path").to_pylist(), convs, sizes, borders)

    dealt = paths.mapInArrow(deal, "conv_id long, path binary, sizes array<int>, shard int")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = keep(dealt.mapInArrow(finish, _PART), "trie-parts")

    partial = parts.filter("skeleton IS NOT NULL")
    sums = partial.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = partial.filter("ends <> ''").select("skeleton", "shard", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "shard")
    ends = ends.mapInArrow(_joined_hashes, "skeleton long, ends_sha256 string")
    # One row per skeleton node: as many as the sampled turns at most.
    reduced = skeleton.nodes(spark).join(sums, "skeleton").withColumn("n_children", F.col("n_children") + F.col("skeleton_children"))
    childless = reduced.filter("n_children = 0").select("skeleton").join(skeleton.above_ends(spark), "skeleton")
    childless = childless.groupBy(F.col("ancestor").alias("skeleton")).agg(F.count("*").alias("ends_below"))
    reduced = reduced.join(childless, "skeleton", "left").join(ends, "skeleton", "left")
    heads = sums.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("head"))
    spine = reduced.join(heads, "parent_skeleton", "left").select(
        "conv_id",
        "depth",
        F.col("head").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.coalesce("ends_below", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("bytes_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_hash(""))).alias("ends_sha256"),
        "turn",
    )
    inner = parts.filter("skeleton IS NULL").join(F.broadcast(heads), "parent_skeleton", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "head")).withColumn("ends_sha256", F.col("ends"))
    return inner.select(*NODE_COLUMNS, "turn").unionByName(spine.select(*NODE_COLUMNS, "turn"))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with ``role`` and ``text`` of their last turn, null at the root."""
    texts = turns(conversations).groupBy(F.col("digest").alias("turn")).agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    return nodes.join(texts, "turn", "left").select(*nodes.columns, "role", "text")


def prefix_trie(conversations: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """The nodes of the trie over all rebuilt conversations: :data:`NODE_COLUMNS`."""
    return trie(rebuilt_paths(conversations), config).select(*NODE_COLUMNS)
