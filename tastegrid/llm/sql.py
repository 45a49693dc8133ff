"""DuckDB SQL of the queries that SQL can express: both near-duplicate joins, pair by pair."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach(id, root) AS (
    SELECT a, a FROM both_ways UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.id),
  lowest AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE
  texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
  sets AS (
    SELECT doc_id, CASE
      WHEN len(words) = 0 THEN []::VARCHAR[]
      WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
    FROM texts),
  one_by_one AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
  shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM one_by_one x JOIN one_by_one y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
  links AS (
    SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * k >= 80 * (len(x.shingles) + len(y.shingles) - k)),
{_REACH}
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id,
       doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN lowest ON id = doc_id
"""

VECTOR_LINKS = f"""
WITH RECURSIVE
  vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
    ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.93e0),
{_REACH},
  counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN lowest ON id = vec_id LEFT JOIN counts ON a = vec_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: each byte enters the register, which then takes eight steps."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ord({text}[i]), 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) // 2, 3988292384) ELSE xor(c, x) // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, x: {step}), 4294967295::BIGINT)"


def _field(name: str) -> str:
    return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"


_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RECORD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_TAMPERED = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _field(_SMALL)


def _tree(name: str, leaves: str, levels: int) -> tuple[str, str]:
    """CTEs of the levels over ``leaves`` (``tree, pos, hash``) and the text of the proofs' steps for ``leaves``' places."""
    parts = [f"{name}_0 AS (SELECT tree, pos, hash, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(levels):
        parts.append(
            f"{name}_runs_{k} AS (SELECT tree, pos // 16 AS run, list(hash ORDER BY pos) AS members, max(n) AS n FROM {name}_{k} GROUP BY ALL)"
        )
        parts.append(
            f"{name}_{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(members, '')) ELSE members[1] END AS hash,"
            f" (n + 15) // 16 AS n FROM {name}_runs_{k})"
        )
    return ",\n  ".join(parts), f"{name}_{levels}"


def _siblings(name: str, levels: int, at: str, tree: str) -> tuple[str, str]:
    """Joins that bring the runs above a place, and the list of ``(slot, members of the run)`` from them."""
    joins, steps = [], []
    for k in range(levels):
        joins.append(f"JOIN {name}_runs_{k} AS {name}{k} ON {name}{k}.tree = {tree} AND {name}{k}.run = {at} // {16 ** (k + 1)}")
        steps.append(f"CASE WHEN {name}{k}.n > 1 THEN [{{'slot': {at} // {16 ** k} % 16, 'members': {name}{k}.members}}] ELSE [] END")
    return "\n    ".join(joins), "list_concat(" + ", ".join([*steps, "[]"]) + ")"


_LEVELS, _TRUNK = 6, 4
_SUBTREES, _TOPS = _tree("subtree", "leaves", _LEVELS)
_TRUNKS, _TOP = _tree("trunk", "heads", _TRUNK)
_SUBTREE_JOINS, _SUBTREE_STEPS = _siblings("subtree", _LEVELS, "l.pos", "l.tree")
_TRUNK_JOINS, _TRUNK_STEPS = _siblings("trunk", _TRUNK, "h.pos", "0")
_OTHERS = "array_to_string(list_concat(s.members[:s.slot], s.members[s.slot + 2:]), '')"
_FOLD = "sha256(array_to_string(list_concat(a.members[:a.slot], [h], a.members[a.slot + 2:]), ''))"

#: Six levels of a subtree and four of the trunk: as many leaves a source as 16 to the sixth, 16 to the fourth sources.
MERKLE = f"""
WITH
  records AS (
    SELECT doc_id, source, {_field("source")} AS tree, sha256({_RECORD}) AS hash,
           CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_TAMPERED}) END AS altered
    FROM documents),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos FROM records),
  {_SUBTREES},
  sources AS (SELECT DISTINCT tree, source FROM records),
  heads AS (
    SELECT 0 AS tree, sources.tree AS member, hash, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos
    FROM {_TOPS} JOIN sources ON sources.tree = {_TOPS}.tree),
  {_TRUNKS},
  ways AS (
    SELECT l.doc_id, l.hash AS leaf, h.hash AS subroot, top.hash AS root, coalesce(l.altered, l.hash) AS start,
           list_concat({_SUBTREE_STEPS}, {_TRUNK_STEPS}) AS steps
    FROM leaves l
    {_SUBTREE_JOINS}
    JOIN heads h ON h.member = l.tree
    {_TRUNK_JOINS}
    CROSS JOIN {_TOP} top),
  folded AS (
    SELECT * EXCLUDE (start, steps), sha256(array_to_string(list_transform(steps, lambda s: {_OTHERS}), '')) AS proof_sha256,
           list_reduce(list_prepend({{'slot': 0, 'members': [start]}}, steps),
                       lambda acc, a: {{'slot': 0, 'members': [{_FOLD.replace('[h]', '[acc.members[1]]')}]}}).members[1] AS folded_root
    FROM ways)
SELECT *, folded_root = root AS verified FROM folded
"""

#: Paths are written as hex digests of the turns in a row; every node is the smallest member of each of its beginnings.
PREFIX_TRIE = f"""
WITH
  turns AS (
    SELECT conv_id, turn, coalesce(text, '') AS body, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS digest
    FROM conversations WHERE conv_id IS NOT NULL),
  own AS (
    SELECT conv_id, list({{'digest': digest, 'size': strlen(body)}} ORDER BY turn NULLS FIRST, digest) AS turns,
           {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h
    FROM turns GROUP BY conv_id),
  rebuilt AS (
    SELECT own.conv_id, list_concat(coalesce(base.turns, [])[1:own.h], own.turns[own.h + 1:]) AS turns
    FROM own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 5),
  written AS (SELECT conv_id, turns, array_to_string(list_transform(turns, lambda t: t.digest), '') AS path FROM rebuilt),
  cells AS (SELECT conv_id, path, turns, unnest(range(0, len(turns) + 1)) AS depth FROM written),
  nodes AS (
    SELECT left(path, 32 * depth) AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(max(turns[depth].size), 0) AS size,
           coalesce(string_agg(CASE WHEN depth = len(turns) THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
    FROM cells GROUP BY ALL),
  children AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
  counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
  upward AS (SELECT key, depth, n_convs, size, n_children, unnest(range(0, depth + 1)) AS a FROM counted),
  sums AS (
    SELECT left(key, 32 * a) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
    FROM upward GROUP BY 1)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums USING (key) LEFT JOIN counted p ON c.depth > 0 AND p.key = left(c.key, 32 * (c.depth - 1)) AND p.depth = c.depth - 1
"""

_LETTERS = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_KEY_WORDS = "|".join("".join(_LETTERS.get(c, c) for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_QUOTE = "[\"'']?"
_SECRET_KINDS = [
    ("assign", rf"({_KEY_WORDS}){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("private_key", "-----BEGIN ([A-Z0-9]+ ){0,4}PRIVATE KEY-----", 0, 1),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"\bAIza[A-Za-z0-9_-]{35}\b", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("url_login", r"://[^\s/:@]+:[^\s/:@]+@", 0, 1),
]


def _secret_spans(kind: int) -> str:
    """Matches and the stretches between them; the lengths before a match add up to its place."""
    _, pattern, group, least = _SECRET_KINDS[kind]
    hits, gaps = f"regexp_extract_all(body, '{pattern}')", f"string_split_regex(body, '{pattern}')"
    before = "list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0)"
    value = f"length(regexp_extract(hits[i], '{pattern}', {group}))"
    spans = f"list_transform(range(1, len(hits) + 1), lambda i: {{'start': CAST({before} AS BIGINT), 'kind': {kind}, 'stop': CAST({before} + length(hits[i]) AS BIGINT), 'fits': {value} >= {least}}})"
    return f"SELECT n, list_filter({spans}, lambda s: s.fits) AS spans FROM (SELECT n, {hits} AS hits, {gaps} AS gaps FROM texts)"


_ALL_SPANS = " UNION ALL ".join(_secret_spans(k) for k in range(len(_SECRET_KINDS)))
_KINDS = "[" + ", ".join(f"'{k}'" for k, *_ in _SECRET_KINDS) + "]"
_WRITTEN = f"list_transform(SPANS, lambda s: {_KINDS}[s.kind + 1] || ':' || s.start || ':' || s.stop)"

#: Pattern by pattern; the word borders of the further kinds differ from the operator's only beside letters that are not ASCII.
SECRETS = f"""
WITH
  texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents),
  found AS ({_ALL_SPANS}),
  joined AS (SELECT n, list_sort(flatten(list(spans))) AS spans FROM found GROUP BY n),
  split AS (SELECT *, list_filter(spans, lambda s: s.kind < 3) AS base FROM joined JOIN texts USING (n))
SELECT doc_id, CAST(len(list_filter(base, lambda s: s.kind = 0)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(base, lambda s: s.kind = 1)) AS BIGINT) AS n_access, CAST(len(list_filter(base, lambda s: s.kind = 2)) AS BIGINT) AS n_hex,
       sha256(array_to_string({_WRITTEN.replace("SPANS", "base")}, ',')) AS base_sha256,
       array_to_string({_WRITTEN.replace("SPANS", "spans")}, ',') AS spans
FROM split
"""
