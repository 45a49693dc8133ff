import hashlib
import random
import zlib

import pytest

from tastegrid.llm.trie import NODE_COLUMNS, TrieConfig, prefix_trie, rebuilt_paths, trie, with_turns
from tests.helpers import tuples

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = [(t[3], t[4]) for t in own.get(c - c % 5, [])[:h] + turns[h:]]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, nodes = {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        found = [key]
        for node in found:
            found += children.get(node, [])
        return found

    for key, ids in members.items():
        under = below(key)
        ends = sorted(c for c in ids if len(convs[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        hashed = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        head = min(members[key[:-1]]) if key else None
        leaves = sum(k not in children for k in under)
        nodes.append((min(ids), len(key), head, len(ids), len(children.get(key, [])), leaves, saved, hashed))
    return sorted(nodes, key=lambda row: [(v is None, str(v)) for v in row])


def some_conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        length = rng.randrange(1, 9)
        for t in range(length):
            text = f"hot {t}" if kind < 0.4 else rng.choice(["a", "bé", "c", "longer text"]) if kind < 0.8 else f"{c} {t}"
            rows.append((c * rng.choice([1, 1, 1, 2]), t, rng.choice(["user", "user", None]) if kind > 0.5 else "user", text))
    return rows


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 8192), (2, 40), (3, 12), (4, 3)])
def test_against_sets_of_prefixes(rows, seed, shard_turns):
    values = some_conversations(seed)
    df = rows(SCHEMA, *values)
    got = prefix_trie(df, TrieConfig(shard_turns=shard_turns))
    assert got.columns == list(NODE_COLUMNS)
    assert tuples(got) == brute(values)


def test_many_copies_are_divided_and_cut_paths_change_nothing(rows):
    values = [(c, t, "user", f"same {t}") for c in range(0, 300, 5) for t in range(9)]
    values += [(c, t, "user", f"same {t}" if t < 7 else f"{c}") for c in range(2, 200, 5) for t in range(10)]
    df = rows(SCHEMA, *values)
    for config in (TrieConfig(shard_turns=30), TrieConfig(shard_turns=30, most_sampled_turns=1), TrieConfig(shard_turns=30, most_shards=3, most_samples=7)):
        assert tuples(prefix_trie(df, config)) == brute(values)


def test_odd_rows(rows):
    values = [
        (0, None, None, None),
        (0, 1, "user", "x"),
        (0, 1, "user", "x"),
        (0, 1, "user", "w"),
        (1, 0, "user", ""),
        (None, 0, "user", "nobody's"),
        (4, 0, "user", "y" * 200_000),
        (7, 0, "a", "b"),
        (8, 5, None, "b"),
        (8, None, "1:", "b"),
        (11, 0, "user", "lonely"),
    ]
    values += [(20, t, "user", f"turn {t % 50}") for t in range(150)]
    df = rows(SCHEMA, *values)
    extra = df.selectExpr("*", "1 AS path", "'x' AS sizes", "2 AS shard", "3 AS depth", "4 AS digest", "5 AS base", "6 AS h")
    for shard_turns in (8192, 5):
        assert tuples(prefix_trie(extra, TrieConfig(shard_turns=shard_turns))) == brute(values)


def test_a_long_conversation_is_a_path(rows):
    got = prefix_trie(rows(SCHEMA, *[(20, t, "user", "ab") for t in range(5000)]), TrieConfig(shard_turns=500))
    assert tuples(got.selectExpr("count(*)", "max(depth)", "sum(n_children)", "min(n_leaves)", "max(n_leaves)", "sum(saved_tokens)")) == [(5001, 5000, 5000, 1, 1, 0)]


def test_turnless_conversations_are_members_of_the_root(rows):
    # 7 has fewer own turns than it leaves out, and nothing to take from 5.
    assert zlib.crc32(b"7") % 9 >= 1
    got = tuples(prefix_trie(rows(SCHEMA, (7, 0, "u", "x"))))
    assert got == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_no_conversations(rows):
    assert prefix_trie(rows(SCHEMA, (None, 0, "u", "x"))).collect() == []


def test_last_turns(rows):
    values = some_conversations(9, 30)
    df = rows(SCHEMA, *values)
    nodes = with_turns(trie(rebuilt_paths(df), TrieConfig(shard_turns=20)), df)
    convs = rebuilt(values)
    for r in nodes.collect():
        assert (r.role, r.text) == (convs[r.conv_id][r.depth - 1] if r.depth else (None, None))
