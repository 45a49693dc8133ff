"""Near-duplicate documents by b-bit MinHash: banded minima give candidates, packed low bits estimate, full sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import Words, components, fresh, groups, keep, lean, mix, slices


@dataclass(frozen=True)
class MinHashConfig:
    #: Words per shingle, and the similarity in percent from which two documents are linked.
    words: int = 5
    percent: int = 80
    #: Two documents at the threshold share no band with probability (1 - 0.8 ** rows) ** bands, about 1e-7.
    bands: int = 40
    rows: int = 5
    #: Low bits kept of each minimum.
    bits: int = 2
    #: Standard errors of the estimate below the threshold down to which pairs are still looked at.
    errors: float = 5.0
    #: Members of a bucket, and shingles of a group, that one task handles together.
    bucket_rows: int = 4096
    group_shingles: int = 2_000_000
    seed: int = 41


class Signer:
    """The hash family: ``bands * rows`` permutations of 32-bit shingle hashes."""

    def __init__(self, config: MinHashConfig):
        rng = np.random.Generator(np.random.PCG64(config.seed))
        count = config.bands * config.rows
        self.config, self.count = config, count
        self.factor = rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 2**32, count, dtype=np.uint32)
        self.band = rng.integers(0, 2**63, config.bands, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.count, 0xFFFFFFFF, dtype=np.uint32)
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(values), 256):
            np.minimum(low, (values[a : a + 256, None] * self.factor + self.shift).min(axis=0), out=low)
        return low

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A key for each band of each row of minima."""
        parts = minima.reshape(len(minima), self.config.bands, self.config.rows).astype(np.uint64)
        key = np.broadcast_to(self.band, parts.shape[:2]).copy()
        for r in range(self.config.rows):
            key = mix(key ^ parts[:, :, r])
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of all minima, after a mixing step, packed into 64-bit words."""
        config, per = self.config, 64 // self.config.bits
        bits = mix(minima.astype(np.uint64)) & np.uint64((1 << config.bits) - 1)
        width = -(-self.count // per) * per
        bits = np.pad(bits, ((0, 0), (0, width - self.count))).reshape(len(minima), -1, per)
        return np.bitwise_or.reduce(bits << (np.arange(per, dtype=np.uint64) * np.uint64(config.bits)), axis=2)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the kept low bits' groups differ between signatures."""
        x = a ^ b
        some, step = x, 1
        for step in range(1, self.config.bits):
            some = some | (x >> np.uint64(step))
        lowest = np.uint64(sum(1 << k for k in range(0, 64, self.config.bits)))
        return np.bitwise_count(some & lowest).sum(axis=-1)

    def similarity(self, differing: np.ndarray) -> np.ndarray:
        """Estimated similarity: equal low bits also come from collisions, one in ``2 ** bits`` of unequal minima."""
        chance = 2.0**-self.config.bits
        return (1 - differing / self.count - chance) / (1 - chance)

    def most_differing(self) -> int:
        """The most differing groups with which a pair at the threshold is still looked at."""
        chance = 2.0**-self.config.bits
        p = (1 - self.config.percent / 100) * (1 - chance)
        return int(np.ceil(self.count * p + self.config.errors * np.sqrt(self.count * p * (1 - p))))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ASCII capitals made small, the whole sequence if it is shorter."""
    words = Words(column, lower=True)
    h, out = words.hash, []
    long = np.zeros(0, dtype=np.uint64)
    if len(h) >= width:
        long = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            long = mix(long ^ h[k : len(h) - width + 1 + k])
    for a, b in zip(words.bounds, words.bounds[1:]):
        if b - a >= width:
            out.append(np.unique(long[a : b - width + 1]))
        elif b > a:
            one = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                one = mix(one ^ h[k])
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that name a set; documents with the same set are one class."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def is_linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = overlap(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


# The steps -----------------------------------------------------------------------------------------------------------


def signatures(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """``id, h, set, n, packed, bands`` per row of ``docs (id, h, text)``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(config)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), config.words)
            low = np.stack([signer.minima(s) for s in sets])
            packed, keys = signer.packed(low), signer.keys(low)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * config.bands, pa.int32()), pa.array(keys.ravel()))
            columns = [
                batch.column("id"),
                batch.column("h"),
                pa.array([set_name(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p.tobytes() for p in packed], pa.binary()),
                bands,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "set", "n", "packed", "bands"])

    return docs.mapInArrow(lean(sign), "id long, h long, set binary, n long, packed binary, bands array<long>")


def _forest(packed: np.ndarray, sizes: np.ndarray, signer: Signer, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the members whose estimates reach down to the margin and whose sizes allow a link."""
    percent = signer.config.percent
    open_ = np.arange(len(packed))
    links = []
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            at = front.pop()
            small, large = np.minimum(sizes[open_], sizes[at]), np.maximum(sizes[open_], sizes[at])
            near = (signer.differing(packed[open_], packed[at]) <= most) & (100 * small >= percent * large)
            if near.any():
                links += [(int(at), int(k)) for k in open_[near]]
                front += list(open_[near])
                open_ = open_[~near]
    return links


def _dealt(members: DataFrame, task: str, weight: str, limit: int) -> DataFrame:
    """``members`` with ``large`` and ``part``: a task whose weights add up to more than ``limit`` is dealt over parts by a
    hash. Sixteen of its members go to every part, so that what is linked with one of them is connected across parts."""
    total = members.groupBy(task).agg(F.sum(weight).alias("total"))
    rows = members.join(total, task).withColumn("parts", F.ceil(F.col("total") / limit).cast("int"))
    draw = F.pmod(F.xxhash64("node"), F.lit(16))
    shared = rows.filter("parts > 1").groupBy(task, draw.alias("draw")).agg(F.min("node").alias("node"))
    rows = rows.join(shared.select(task, "node", F.lit(True).alias("everywhere")), [task, "node"], "left")
    own = F.pmod(F.xxhash64("node", task), "parts").cast("int")
    part = F.when(F.col("everywhere"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    return rows.withColumn("part", F.explode(part)).withColumn("large", F.col("parts") > 1).drop("total", "parts", "everywhere")


def _unsettled(members: DataFrame, links: DataFrame, task: str, weight: str, limit: int, name: str) -> DataFrame:
    """The members of large tasks whose parts have not come together, in blocks: every pair of which one is outside the
    task's main component meets in one."""
    so_far = components(links, name)
    rows = members.join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = rows.groupBy(task, "component").agg(F.sum(weight).alias("w"))
    main = sums.groupBy(task).agg(F.count("*").alias("c"), F.max_by("component", F.struct("w", "component")).alias("main"), F.sum("w").alias("total"), F.max("w").alias("most"))
    rows = rows.join(main.filter("c > 1"), task)
    p, q = (F.greatest(F.lit(1), F.ceil(w * 2 / limit)).cast("int") for w in (F.col("total"), F.col("total") - F.col("most")))
    rows = rows.withColumns({"p": p, "q": q})
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), "q").cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), "p").cast("int")
    as_any = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: k * F.col("p") + j)
    as_rest = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda k: i * F.col("p") + k)
    blocks = F.when(F.col("component") == F.col("main"), as_any).otherwise(F.array_union(as_any, as_rest))
    return rows.withColumn("part", F.explode(blocks))


def candidate_links(classes: DataFrame, config: MinHashConfig) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that connect all members of a bucket whose estimates are near enough."""
    bands = classes.select(F.explode("bands").alias("task"), "node")
    # Buckets of one member are most of all and end here, as pairs of numbers.
    shared = bands.groupBy("task").agg(F.count("*").alias("m")).filter("m > 1").select("task", "m")
    members = keep(bands.join(shared, "task"), "minhash-members")
    facts = classes.select("node", "n", "packed")
    one = F.lit(1).alias("one")
    small = members.filter(F.col("m") <= config.bucket_rows).select("task", "node", F.lit(0).alias("part"))
    crowd = members.filter(F.col("m") > config.bucket_rows).select("task", "node", one)
    dealt = _dealt(crowd, "task", "one", config.bucket_rows).select("task", "node", "part")
    links = keep(_forests(small.union(dealt).join(facts, "node"), config), "minhash-candidates")
    if crowd.isEmpty():
        return links
    again = _unsettled(crowd, links, "task", "one", config.bucket_rows, "minhash-crowd")
    return links.union(_forests(again.select("task", "node", "part").join(facts, "node"), config))


def _forests(members: DataFrame, config: MinHashConfig) -> DataFrame:
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(config)
        most = signer.most_differing()
        found: set[tuple[int, int]] = set()
        for bucket in groups(batches, ["task", "part"]):
            if bucket.num_rows < 2:
                continue
            node = bucket.column("node").to_numpy()
            packed = np.stack([np.frombuffer(x, dtype=np.uint64) for x in bucket.column("packed").to_pylist()])
            order = np.argsort(node, kind="stable")
            node = node[order]
            for i, j in _forest(packed[order], bucket.column("n").to_numpy()[order], signer, most):
                found.add((int(node[i]), int(node[j])))
            if len(found) >= 100_000:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    dealt = members.repartition("task", "part").sortWithinPartitions("task", "part")
    return dealt.mapInArrow(lean(forest), "a long, b long").distinct()


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _confirmed(table: pa.Table, config: MinHashConfig, signer: Signer, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of all true links within a group: full sets decide."""
    node, sets = table.column("node").to_numpy(), []
    for batch in slices(table.select(["text"]).combine_chunks().to_batches(), "text"):
        sets += shingle_sets(batch.column("text"), config.words)
    packed = np.stack([np.frombuffer(x, dtype=np.uint64) for x in table.column("packed").to_pylist()])
    right = np.array([set_name(s) == name for s, name in zip(sets, table.column("set").to_pylist())])
    places = np.flatnonzero(right)
    _, first = np.unique(node[places], return_index=True)
    open_ = places[first]
    size = np.array([len(s) for s in sets])
    links = []
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            at = front.pop()
            small, large = np.minimum(size[open_], size[at]), np.maximum(size[open_], size[at])
            maybe = (signer.differing(packed[open_], packed[at]) <= most) & (100 * small >= config.percent * large)
            linked = np.zeros(len(open_), dtype=bool)
            for k in np.flatnonzero(maybe):
                linked[k] = is_linked(sets[at], sets[open_[k]], config.percent)
            if linked.any():
                links += [(int(node[at]), int(node[k])) for k in open_[linked]]
                front += list(open_[linked])
                open_ = open_[~linked]
    return links


def confirm(members: DataFrame, config: MinHashConfig) -> DataFrame:
    """True links ``(a, b, large)`` that connect each part of ``members`` as all true links within it do."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(config)
        most = signer.most_differing()
        for group in groups(batches, ["task", "part"]):
            if group.num_rows > 1:
                pairs = _pairs(set(_confirmed(group, config, signer, most)))
                large = pa.array(np.full(pairs.num_rows, group.column("large")[0].as_py()), pa.bool_())
                yield pa.RecordBatch.from_arrays([*pairs.columns, large], names=["a", "b", "large"])

    chosen = members.select("task", "part", "node", "set", "packed", "text", "large")
    dealt = chosen.repartition("task", "part").sortWithinPartitions("task", "part")
    return dealt.mapInArrow(lean(decide), "a long, b long, large boolean")


def _heavy(group: DataFrame, config: MinHashConfig) -> DataFrame:
    return group.groupBy("task").agg(F.sum("n").alias("w")).filter(F.col("w") > config.group_shingles).select("task")


def duplicate_facts(docs: DataFrame, config: MinHashConfig = MinHashConfig(), text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``id, h, n_shingles, component, component_id, kept`` for every row of ``docs``: ``h`` is the hash of the text,
    ``component`` numbers the components of documents with words (the number has no meaning beyond this result).

    Documents with the same shingle set are one class, and only classes go on. Minima of ``bands * rows`` hash functions
    make band keys; within a bucket, packed low bits estimate similarity, and a spanning forest of the near enough members
    is all that leaves it. Its components bring the texts of possible near copies together, where the full sets decide.
    Buckets and groups too large for one task are dealt over several that share some members. Members that this does not
    bring together with most of their group then meet all others of it, block by block, so no link is lost.

    ``component_id`` is the smallest id in the component, ``kept`` whether the row has it. Null and wordless texts have
    empty sets and are linked with nothing. A null id has no part in the smallest id; a component of null ids only has
    a null ``component_id``, and its rows are kept. Rows with equal ids are rows of their own, but of one component if
    their sets are linked. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    signed = keep(signatures(rows, config), "minhash-signed")
    first = F.min(F.struct("id", "h")).alias("rep")
    by_set = signed.filter("n > 0").groupBy("set")
    classes = by_set.agg(F.min("id").alias("low"), first, F.first("n").alias("n"), F.first("packed").alias("packed"), F.first("bands").alias("bands"))
    # Numbered as written, so the numbers hold in every later read.
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    weak = components(candidate_links(classes, config), "minhash-weak")
    group = classes.drop("bands").join(weak.withColumnRenamed("component", "task"), "node")
    wanted = group.select(F.col("rep.id").alias("rid"), F.col("rep.h").alias("rh"), "node", "set", "packed", "n", "task")
    texts = rows.join(wanted, F.col("h").eqNullSafe(F.col("rh")) & F.col("id").eqNullSafe(F.col("rid")))
    group = keep(texts.select("task", "node", "set", "packed", "n", "text"), "minhash-group")
    dealt = _dealt(group, "task", "n", config.group_shingles)
    links = keep(confirm(dealt, config).select("a", "b", "large"), "minhash-links")
    large = links.filter("large")
    links = links.select("a", "b")
    if not large.isEmpty():
        crowd = group.join(_heavy(group, config), "task", "left_semi")
        again = _unsettled(crowd, links, "task", "n", config.group_shingles, "minhash-first")
        links = links.union(keep(confirm(again.withColumn("large", F.lit(True)), config), "minhash-more-links").select("a", "b"))
    final = components(links, "minhash-final")
    labelled = classes.select("node", "set", "low").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    names = labelled.join(lowest, "component").select("set", "component", "component_id")
    facts = signed.select("id", "h", F.when(F.col("n") > 0, F.col("set")).alias("set"), "n").join(names, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    facts = facts.select("id", "h", F.col("n").alias("n_shingles"), "component", component)
    return facts.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig(), text: str = "text", id_: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with the ``n_shingles, component_id, kept`` of :func:`duplicate_facts`.

    Columns of the input with these names are replaced.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    facts = duplicate_facts(docs, config, text, id_).drop("component").distinct()
    return _beside(docs, facts, text, id_, "left").select(*docs.columns, "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, config: MinHashConfig = MinHashConfig(), text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row of each component, with all columns: that of the smallest id, then the smallest text hash.

    Rows equal in id and text are copies as well, and one of them stays. Rows without words are copies of none; all stay.
    """
    facts = duplicate_facts(docs, config, text, id_)
    best = facts.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("h"))).alias("b"))
    winners = best.select(F.col("b.id").alias("id"), F.col("b.h").alias("h"), F.lit(False).alias("wordless"))
    empty = facts.filter("component IS NULL").select("id", "h", F.lit(True).alias("wordless")).distinct()
    chosen = _beside(docs, winners.union(empty), text, id_, "inner")
    names = [fresh(["k", "h", "one"], f"c{i}") for i in range(len(docs.columns))]
    flat = chosen.toDF(*names, "k", "h", "wordless")
    single = flat.filter(~F.col("wordless")).groupBy("k", "h").agg(F.first(F.struct(*names)).alias("one")).select("one.*")
    return single.union(flat.filter("wordless").select(*names)).toDF(*docs.columns)


def _beside(docs: DataFrame, facts: DataFrame, text: str, id_: str, how: str) -> DataFrame:
    """``docs`` joined with facts of the same id and text."""
    key, hash_ = fresh(docs.columns, "fact_id"), fresh(docs.columns, "fact_hash")
    facts = facts.withColumnsRenamed({"id": key, "h": hash_})
    facts = facts.select(key, hash_, *[c for c in facts.columns if c not in (key, hash_)])
    return docs.join(facts, F.col(id_).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(hash_)), how)


def near_duplicate_digest(docs: DataFrame, config: MinHashConfig = MinHashConfig(words=4)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    return duplicate_facts(docs.select("doc_id", "text"), config).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
