"""A Merkle manifest of a dataset: leaves, nodes and proofs from lag and lead windows, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import keep
from tastegrid.operators.numbering import numbered

#: What a document's leaf is the hash of, in this order, and how many nodes make a parent.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
_HEX = 64
_STEP = "array<struct<slot:int,siblings:string>>"


@dataclass(frozen=True)
class Manifest:
    """The hash tree: a subtree per group, and the trunk over the groups' subroots.

    ``leaves``: ``id, tree, pos, n, hash, altered``; ``tree`` names the group, ``pos`` counts from 0, ``n`` is the number
    of leaves of the tree, ``altered`` the hash of the tampered record, null where nothing is tampered with.
    ``levels``: of each level of the subtrees the nodes with their siblings, ``tree, pos, n, hash, slot, siblings``, from
    the leaves on; ``subroots``: ``tree, source, pos, n, hash`` in the trunk's order; ``trunk``: its levels.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    trunk: list[DataFrame]
    root: str | None


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two records are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes`` with ``run``, ``slot`` and ``siblings``, the hashes of the run's other nodes from left to right.

    The neighbours stand at fixed offsets: lag and lead columns, of which a node takes those that its slot and the length
    of its run leave inside the run. A window is one run, so that no group is larger than ``arity`` rows.
    """
    placed = nodes.withColumn("run", F.expr(f"pos div {arity}")).withColumn("slot", (F.col("pos") % arity).cast("int"))
    along = Window.partitionBy("tree", "run").orderBy("pos")
    length = F.least(F.lit(arity), F.col("n") - F.col("run") * arity)
    before = [F.when(F.col("slot") >= k, F.lag("hash", k).over(along)) for k in range(arity - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < length, F.lead("hash", k).over(along)) for k in range(1, arity)]
    return placed.withColumn("siblings", F.concat_ws("", *before, *after))


def parents(seen: DataFrame, arity: int = ARITY) -> DataFrame:
    """First children hash their run; the only node of a finished tree stays as it is."""
    first = seen.filter("slot = 0")
    hash_ = F.when(F.col("n") > 1, F.sha2(F.concat("hash", "siblings"), 256)).otherwise(F.col("hash"))
    return first.select("tree", F.expr(f"pos div {arity}").alias("pos"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), hash_.alias("hash"))


def climb(nodes: DataFrame, name: str, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``nodes`` (``tree, pos, n, hash``), with siblings, and the top of each tree.

    The loop runs as often as the largest tree is high; the one number that the driver asks for is that tree's size. Levels
    from the second on, a sixteenth of the rows before, are kept.
    """
    largest = nodes.agg(F.max("n")).head()[0] or 0
    levels: list[DataFrame] = []
    while largest > 1:
        seen = with_siblings(nodes, arity).select("tree", "pos", "n", "hash", "run", "slot", "siblings")
        if levels:
            seen = keep(seen, f"{name}-level-{len(levels)}")
        levels.append(seen)
        nodes = parents(seen, arity)
        largest = -(-largest // arity)
        if len(levels) == 1:
            # The leaves' siblings are not written; their parents are.
            nodes = keep(nodes, f"{name}-parents")
    return levels, nodes


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "source",
    id_: str = "doc_id",
    tampered: tuple[Column, str, Column] | None = None,
    arity: int = ARITY,
) -> Manifest:
    """The hash tree over all rows of ``docs``.

    A group's leaves ascend by ``id_`` (null first); rows equal in it by their leaf, so the tree does not depend on the
    input's order, and equal rows are leaves of their own. Groups ascend by their value in UTF-8 bytes, null first. Null
    fields are written ``-``, empty texts ``0:``; other columns, whatever their names, take no part. An empty table has
    no root. ``tampered`` gives a condition, a field and the value that a tampered record would have there.

    Documents are read once and only their hashes are shuffled; places come from sorted ranges (``numbered``), so that a
    group with most of the rows is spread over tasks.
    """
    values = [F.col(f) for f in fields]
    altered = F.lit(None).cast("string")
    if tampered:
        where, which, value = tampered
        changed = record_hash([value if f == which else F.col(f) for f in fields])
        altered = F.when(where, F.when(F.col(which).isNull(), record_hash(values)).otherwise(changed))
    leaves = docs.select(F.col(id_).alias("id"), field(F.col(group)).alias("tree"), record_hash(values).alias("hash"), altered.alias("altered"))
    leaves = keep(numbered(leaves, ["tree"], ["id", "hash"], "pos", "n"), "merkle-leaves")
    levels, tops = climb(leaves.select("tree", "pos", "n", "hash"), "merkle-subtree", arity)
    source = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    ordered = tops.select(F.lit("").alias("all"), source.alias("source"), F.col("tree").alias("member"), "hash")
    subroots = keep(numbered(ordered, ["all"], ["source"], "pos", "n"), "merkle-subroots")
    trunk, top = climb(subroots.select(F.lit("").alias("tree"), "pos", "n", "hash"), "merkle-trunk", arity)
    found = top.head()
    subroots = subroots.withColumnRenamed("member", "tree").select("tree", "source", "pos", "n", "hash")
    return Manifest(leaves, levels, subroots, trunk, found["hash"] if found else None)


def _own_step() -> Column:
    step = F.array(F.struct(F.col("slot").alias("slot"), F.col("siblings").alias("siblings")))
    return F.when(F.col("n") > 1, step).otherwise(F.array().cast(_STEP))


def _descend(levels: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Proofs of the lowest level's nodes: each node's own step, then its parent's proof. ``above``: ``tree, pos, proof``
    and ``carried`` columns of the tops."""
    for seen in reversed(levels):
        parent = above.select("tree", F.col("pos").alias("run"), F.col("proof").alias("beyond"), *carried)
        joined = seen.join(parent, ["tree", "run"])
        above = joined.select("tree", "pos", F.concat(_own_step(), "beyond").alias("proof"), *carried)
    return above


def proofs(tree: Manifest) -> DataFrame:
    """``id, leaf, altered, subroot, proof`` of every leaf; ``proof`` is ``array<struct<slot, siblings>>`` from the leaf to
    the root. Each level joins its parents by run: proofs of the upper levels are shared until the leaves take them, and
    the leaves are shuffled once, by run, for their siblings and for the join."""
    nothing = F.array().cast(_STEP)
    if tree.trunk:
        summit = tree.subroots.select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("pos"), nothing.alias("proof")).distinct()
        placed = _descend(tree.trunk, summit, []).select("pos", "proof")
    else:
        placed = tree.subroots.select("pos", nothing.alias("proof"))
    tops = tree.subroots.select("tree", F.col("pos").alias("at"), F.col("hash").alias("subroot"))
    tops = tops.join(placed.withColumnRenamed("pos", "at"), "at").select("tree", F.lit(0).cast("long").alias("pos"), "proof", "subroot")
    leaves = tree.leaves
    if not tree.levels:
        return leaves.join(tops.drop("pos"), "tree").select("id", F.col("hash").alias("leaf"), "altered", "subroot", "proof")
    above = _descend(tree.levels[1:], tops, ["subroot"])
    seen = with_siblings(leaves.select("tree", "pos", "n", "hash", "id", "altered"))
    joined = seen.join(above.select("tree", F.col("pos").alias("run"), F.col("proof").alias("beyond"), "subroot"), ["tree", "run"])
    return joined.select("id", F.col("hash").alias("leaf"), "altered", "subroot", F.concat(_own_step(), "beyond").alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof amount to."""

    def parent(acc: Column, step: Column) -> Column:
        cut = step["slot"] * _HEX
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), cut), acc, F.substring(step["siblings"], cut + 1, F.length(step["siblings"]))), 256)

    return F.aggregate(proof, leaf, parent)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merkle_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    Documents whose crc32 of the written ``doc_id`` 5 divides are tampered with: their texts' A-Z become small. A null
    ``doc_id`` has no written form and is left alone.
    """
    tampering = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tree = manifest(docs, tampered=(tampering, "text", lower_ascii(F.col("text"))))
    rows = proofs(tree)
    folded = fold(F.coalesce("altered", "leaf"), F.col("proof"))
    rows = rows.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(tree.root).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform("proof", lambda s: s["siblings"]), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
