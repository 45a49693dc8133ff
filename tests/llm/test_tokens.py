import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tastegrid.llm.bpe import Automaton, WordBpe, encode, token_digest, unsure_letters

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as file:
        return WordBpe(json.load(file), unsure_letters())


def same(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids, text
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def brute_bpe(symbols, merges):
    """Apply the earliest merge, leftmost first, until none applies."""
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    symbols = list(symbols)
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if found is None:
            return symbols
        i = found[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_automaton_of_random_merges():
    rng = random.Random(8)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(1, 14)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            # A merge as training makes it: its pair stands next to each other in some text so far, and is new.
            joined = "".join(pair)
            if joined not in tokens and brute_bpe(joined, merges) == list(pair):
                merges.append(pair)
                tokens.append(joined)
        automaton = Automaton("abc", merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            assert automaton.path(word) == brute_bpe(word, merges), (merges, word)
            assert automaton._long_path(word, "") == automaton.path(word)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_as_the_library_does(coder, library, text):
    # Marks that Python's Unicode does not order yet are normalized by the library alone.
    same(coder, library, text)


@pytest.mark.parametrize(
    "text",
    ["", "I'LL say it's <|endoftext|>DONE<|startoftext|><|endoftext|>", "ΣΑΣ İstanbul ǅ", "été", "a" * 5000, "!" * 1000, "hello" * 60, "Ⅷ ² १", "x y z\u0085w\x1cv"],
)
def test_special_texts(coder, library, text):
    same(coder, library, text)


def test_documents(spark, small_dir, library):
    import hashlib

    table = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = {r.doc_id: r for r in token_digest(table).collect()}
    for r in table.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_none(oddities, docs):
    rows = encode(oddities).collect()
    assert len(rows) == oddities.count() and all(r.token_ids == [] and r.decoded == "" for r in rows if not (r.text or "").strip())
    assert encode(docs().limit(0)).count() == 0
