import collections
import random
import zlib

import pytest

from tastegrid.llm.mixture import MixConfig, mix, mixed_rows, sainte_lague, source_mix, water_fill
from tastegrid.llm.sharding import ShuffleConfig, external_shuffle, shuffled_shards


def test_shards_hold_all_rows_and_differ_by_one_row_at_most(spark, docs):
    table = docs(*[(i % 90, f"text {i % 7} " * (i % 5)) for i in range(203)])
    got = shuffled_shards(table, ShuffleConfig(bucket_bytes=400)).collect()
    want = collections.Counter((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in table.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_shuffle_depends_on_the_seed_and_moves_rows(docs):
    table = docs(*[(i, f"t{i}") for i in range(200)])

    def order(seed):
        rows = external_shuffle(table, ShuffleConfig(seed=seed, bucket_bytes=200)).collect()
        return [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]

    assert order(1) == order(1) != order(2)
    assert order(1) != sorted(order(1))


def test_shuffle_of_odd_rows_and_of_none(oddities, docs):
    rows = external_shuffle(oddities)
    assert rows.count() == oddities.count() and set(rows.columns) >= {"shard", "slot", "text"}
    assert external_shuffle(docs().limit(0)).count() == 0


def brute_sainte_lague(votes, seats, most):
    quota = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if quota[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        quota[max(open_, key=lambda i: (votes[i] / (2 * quota[i] + 1), -i))] += 1
    return quota


def test_highest_quotients(docs):
    rng = random.Random(3)
    for _ in range(200):
        votes = [rng.choice([0.0, rng.random() * 50, 7.0]) for _ in range(rng.randrange(1, 8))]
        most = [rng.randrange(0, 60) for _ in votes]
        seats = rng.randrange(0, 80)
        assert sainte_lague(votes, seats, most) == brute_sainte_lague(votes, seats, most), (votes, seats, most)


def test_targets_stop_at_twice_a_source(docs):
    target = water_fill({"a": 10, "b": 1000, None: 500, "c": 0}, MixConfig())
    assert target["a"] == 20 and target["c"] == 0 and abs(sum(target.values()) - 1.5 * 1510) < 1e-9
    assert target[None] == 1000 and target["b"] == 1.5 * 1510 - 1020


@pytest.mark.parametrize("shard_words", [400, 4_000_000])
def test_mix_comes_near_its_targets(docs, shard_words):
    rng = random.Random(5)
    table = docs(*[(i, "w " * rng.randrange(0, 90), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)])
    config = MixConfig(block_words=8, shard_words=shard_words)
    rows = mix(table, config).collect()
    assert len(rows) == 300
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r["size"] == len(r.text.split())
        by[r.source][0] += r["size"]
        by[r.source][1] = r.target
        by[r.source][2] += r.taken
    assert all(r.source_size == by[r.source][0] for r in rows)
    for size, target, taken in by.values():
        assert abs(taken - target) <= max(16, 0.06 * target)
    again = {(r.doc_id, r.taken) for r in mix(table.repartition(7), config).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixed_rows_hold_the_words_taken(docs):
    table = docs(*[(i, " ".join(f"w{i}x{k}" for k in range(30 + i)), "en", "ab"[i % 2]) for i in range(40)])
    config = MixConfig(block_words=7)
    mixed = mix(table, config)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    words = collections.defaultdict(list)
    for r in mixed_rows(mixed, config).collect():
        words[r.doc_id] += r.text.split()
    assert {k: len(v) for k, v in words.items()} == {k: n for k, n in taken.items() if n}
    assert all(max(collections.Counter(v).values()) <= 2 for v in words.values())


def test_mix_of_odd_rows_and_of_none(oddities, docs):
    rows = mix(oddities).collect()
    assert len(rows) == oddities.count() and all(r.taken == 0 for r in rows if not (r.text or "").split())
    assert mixed_rows(mix(oddities)).columns == [c for c in oddities.columns if c not in ("size", "target", "taken")]
    assert source_mix(docs().limit(0)).count() == 0
