import random
import re
from collections import Counter

import pyarrow as pa

from tastegrid.llm.common import Words
from tastegrid.llm.repetition import RepetitionConfig, measure, repetition_digest, repetition_rules


def brute(text, least=8):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    twice = {k for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    spans, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            spans.update(range(i, i + best))
            longest = max(longest, best)
    return [n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(twice), len(spans), longest]


def test_measures_against_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b c d e", "a " * 50, "x", "same line here\nsame line here\n\n\n", "é#$ |<>"]
    texts += ["".join(rng.choice(["a", "b", "cé"]) + rng.choice([" ", " ", "\n", "\t#"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    found = measure(pa.array(texts))
    for i, text in enumerate(texts):
        assert [int(found[c][i]) for c in list(found)[:7]] == brute(text), text


def test_verdict(docs):
    plain = " ".join(f"word{k}" for k in range(200))
    passage = " ".join(f"again{k}" for k in range(40))
    table = docs((1, plain), (2, "too short"), (3, "spam spam " * 30), (4, plain + " " + passage + " between " + passage), (5, passage + " and " + passage))
    rows = {r.doc_id: r for r in repetition_digest(table).collect()}
    assert [rows[k].base_failed for k in range(1, 6)] == [False, True, True, True, True] and rows[1].kept and not rows[2].kept
    strict = {r.doc_id: r for r in repetition_digest(table, RepetitionConfig(repeat_percent=100, most_covered=0.25)).collect()}
    assert strict[4].n_covered_words == 80 and strict[4].longest_repeat == 40 and not strict[4].base_failed and not strict[4].kept


def test_odd_rows_and_none(oddities, docs):
    rows = repetition_rules(oddities).collect()
    assert len(rows) == oddities.count() and all(not r.kept and r.n_words == 0 for r in rows if not (r.text or "").strip())
    assert repetition_rules(docs().limit(0)).count() == 0


def test_words_of_batches():
    texts = ["Hello  World\n a", None, "", " x", "x y", "été hello", "z" * 10_000 + " q"]
    words = Words(pa.array(texts), lower=True)
    want = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
    assert [words.of(i).decode() for i in range(len(words.start))] == want
    assert len({(w, int(h)) for w, h in zip(want, words.hash)}) == len(set(want)) == len(set(map(int, words.hash)))
