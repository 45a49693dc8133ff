import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tastegrid.llm.merkle import FIELDS, fold, manifest, merkle_digest, proofs
from tests.helpers import tuples


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels_over(hashes, arity=16):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def way(levels, i, arity=16):
    steps = []
    for nodes in levels[:-1]:
        first = i // arity * arity
        run = nodes[first : first + arity]
        steps.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= arity
    return steps


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, digest(*[written(row[f]) for f in FIELDS]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda t: t[:3])
        trees[source] = levels_over([t[2] for t in groups[source]])
    trunk = levels_over([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(groups[source]):
            steps = way(trees[source], i) + way(trunk, k)
            now = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None:
                now = digest(*[written(lowered(row[f]) if f == "text" else row[f]) for f in FIELDS])
            for slot, others in steps:
                now = digest(*others[:slot], now, *others[slot:])
            proof = digest(*[h for _, others in steps for h in others])
            out.append((row["doc_id"], leaf, trees[source][-1][0], trunk[-1][0], proof, now, now == trunk[-1][0]))
    return sorted(out, key=lambda row: [(v is None, str(v)) for v in row])


def as_dicts(df):
    return [r.asDict() for r in df.select(*FIELDS).collect()]


def test_against_a_tree_built_node_by_node(docs):
    rng = random.Random(3)
    sources = [None, "", "a", "é", "z", "Z", "-", "0:"] + [f"s{k}" for k in range(30)]
    # One source has 16 * 16 + 1 leaves, so that runs of one node stand on two levels.
    values = [(k, f"Text {k} É", "en", "hot") for k in range(257)]
    values += [(1000 + k, rng.choice([None, "", "ABC", "abc", "É Ü"]), rng.choice([None, "en"]), rng.choice(sources)) for k in range(200)]
    df = docs(*values)
    got = merkle_digest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert tuples(got) == brute(as_dicts(df))
    assert {r.verified for r in got.collect()} == {True, False}


def test_odd_rows(oddities):
    assert tuples(merkle_digest(oddities)) == brute(as_dicts(oddities.select(*oddities.columns[:5])))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 32])
def test_small_trees(docs, n):
    df = docs(*[(k, f"T{k}", "en", "a") for k in range(n)])
    assert tuples(merkle_digest(df)) == brute(as_dicts(df))


def test_empty_table(docs):
    assert merkle_digest(docs((1, "x")).limit(0)).collect() == []
    assert manifest(docs((1, "x")).limit(0)).root is None


def test_input_order_and_partitions_do_not_matter(docs):
    df = docs(*[(k // 2, f"t{k % 3}", "en", f"s{k % 5}") for k in range(120)])
    assert tuples(merkle_digest(df)) == tuples(merkle_digest(df.orderBy(F.rand(5)).repartition(7)))


def test_every_leaf_folds_to_the_root(docs):
    tree = manifest(docs(*[(k, f"t{k}", "en", f"s{k % 3}") for k in range(100)]))
    folded = proofs(tree).select(fold(F.col("leaf"), F.col("proof")).alias("r")).distinct().collect()
    assert [r.r for r in folded] == [tree.root]
