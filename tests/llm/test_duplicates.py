import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tastegrid.llm.common import components
from tastegrid.llm.embedding import RangeJoinConfig, range_join
from tastegrid.llm.minhash import MinHashConfig, Signer, deduplicate, near_duplicate_digest, near_duplicates, shingle_sets


def roots(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def brute_components(texts, width):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return roots(sets, links), {i: len(s) for i, s in sets.items()}


def corpus(rng, groups, copies):
    """Groups of texts that drift away from each other word by word, so that links are close to the threshold."""
    out = {}
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(400)}"
            if rng.random() < 0.5:
                base = text
            out[len(out) * 3 + 5] = " ".join(text).title() if rng.random() < 0.2 else "  ".join(text)
    return out


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 8, "group_shingles": 300}])
def test_components_against_all_pairs(docs, limits):
    texts = corpus(random.Random(11), 40, 14)
    want, sizes = brute_components(texts, 4)
    rows = near_duplicate_digest(docs(*texts.items()), MinHashConfig(words=4, **limits)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in rows)


def test_estimates_come_near_the_similarity():
    signer = Signer(MinHashConfig())
    rng = np.random.Generator(np.random.PCG64(2))
    for share in (0.0, 0.3, 0.8, 1.0):
        a = rng.integers(0, 2**63, 600, dtype=np.uint64)
        n = round(2 * share * 600 / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 600 - n, dtype=np.uint64)])
        packed = signer.packed(np.stack([signer.minima(a), signer.minima(b)]))
        assert abs(signer.similarity(signer.differing(packed[0], packed[1])) - share) < 0.17


def test_shingles_do_not_cross_texts():
    sets = shingle_sets(pa.array(["a b c d", None, "e f", "a b c d", "f e", "A B c d e"]), 4)
    assert [len(s) for s in sets] == [1, 0, 1, 1, 1, 2]
    assert sets[0] == sets[3] and sets[2] != sets[4] and sets[0][0] in sets[5]


def test_odd_rows(oddities, docs):
    rows = near_duplicates(oddities).collect()
    assert len(rows) == oddities.count()
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in rows if not (r.text or "").strip())
    left = deduplicate(oddities)
    assert left.columns == oddities.columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in left.collect()) == sorted(
        [*((str(r.doc_id), len(r.text or "")) for r in set(oddities.collect()))]
    )
    for result in (near_duplicates(docs().limit(0)), deduplicate(docs().limit(0)), near_duplicate_digest(docs().limit(0))):
        assert result.count() == 0


def test_one_of_each_group_stays(docs):
    text = " ".join(f"w{k}" for k in range(60))
    table = docs((9, text), (4, text + " end"), (4, text), (None, text.upper()), (7, "something else with other words in it"), (None, "no id at all but words"))
    assert sorted((r.doc_id or 0, r.text[:9]) for r in deduplicate(table).collect()) == [(0, "no id at "), (4, "w0 w1 w2 "), (7, "something")]


def test_components_of_a_graph(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    want = roots({x for p in pairs for x in p}, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("limits", [{}, {"cell_rows": 12, "block_rows": 9}])
def test_links_of_vectors_against_all_pairs(spark, limits):
    rng = np.random.Generator(np.random.PCG64(6))
    centres = rng.normal(size=(9, 6))
    rows = []
    for i in range(260):
        v = centres[rng.integers(9)] + rng.normal(size=6) * rng.choice([0.0, 0.15, 0.4])
        rows.append((i * 2 + 1, [float(x) for x in v * rng.choice([1.0, 1e30, 1e-30])], int(rng.integers(2))))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in range_join(table, RangeJoinConfig(**limits)).collect()}
    linked = []
    for a, v, x in rows:
        for b, w, y in rows:
            v_, w_ = np.array(v), np.array(w)
            if a < b and x == y and (v_ / np.abs(v_).max()) @ (w_ / np.abs(w_).max()) >= 0.93 * np.linalg.norm(v_ / np.abs(v_).max()) * np.linalg.norm(w_ / np.abs(w_).max()):
                linked.append((a, b))
    want, count = roots([r[0] for r in rows], linked), defaultdict(int)
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_links == count[i] and r.kept == (want[i] == i) for i, r in got.items())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "x"),
        (2, [2.0, 0.0], 1, "x"),
        (2, [1.0, 0.0], 1, "x"),
        (None, [3.0, 0.0], 1, "x"),
        (3, [1.0, 0.0], None, "x"),
        (4, [1.0, 0.0], 2, "x"),
        (5, None, 1, "x"),
        (6, [], 1, "x"),
        (7, [0.0, 0.0], 1, "x"),
        (8, [1.0, None], 1, "x"),
        (9, [1.0, nan], 1, "x"),
        (10, [inf, 0.0], 1, "x"),
        (11, [1.0, 0.0, 0.0], 1, "x"),
        (None, None, None, "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in range_join(table).collect())
    alone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    want = [("1", 3, "1", True), ("2", 3, "1", False), ("2", 3, "1", False), ("None", 3, "1", False), ("None", 0, "None", True)]
    assert got == sorted([*alone, *want])
    assert range_join(table.limit(0)).count() == 0
