"""The pipeline against brute-force versions of its stages, and its stages on odd tables."""

from collections import Counter, defaultdict

import public_tokenizers
from test_duplicates import brute_components
from test_personal_data import brute
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from tastegrid.llm import mixture, toxicity
from tastegrid.llm.common import documents, keep
from tastegrid.llm.queries import QUERIES


def test_stages_in_order(spark, small_dir):
    docs = documents(spark, small_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    given = {r.doc_id: r for r in docs.collect()}
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    texts = {i: given[i].text for i in given.keys() - rejected}
    roots, _ = brute_components(texts, 5)
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    names = "[EMAIL] [IP] [CARD] [PHONE]".split()

    def redacted(text):
        out, at = "", 0
        for a, k, b in brute(text):
            out += text[at:a] + names[k] if a >= at else ""
            at = max(at, b)
        return out + text[at:]

    texts = {i: t and redacted(t) for i, t in texts.items()}
    sizes = Counter()
    for i, t in texts.items():
        sizes[given[i].source] += len((t or "").split())
    target = mixture.water_fill(dict(sizes), mixture.MixConfig())
    rows = pipeline.run(spark, small_dir).collect()
    words = defaultdict(Counter)
    by_source = Counter()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        words[r.doc_id].update(r.text.split())
        by_source[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.token_ids == library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(r.token_ids)
    for i, found in words.items():
        whole = Counter(texts[i].split())
        assert all(n <= 2 * whole[w] for w, n in found.items())
    for source, words_taken in by_source.items():
        assert abs(words_taken - target[source]) <= 128 + 0.02 * target[source]


def test_stages_on_odd_rows_and_none(spark, oddities, docs, small_dir):
    empty = docs().limit(0)
    for name, stage in pipeline.STAGES:
        out = keep(stage(spark, oddities, small_dir), f"odd-{name}")
        assert set(pipeline.COLUMNS) <= set(out.columns) and out.count() > 0
        if name != "tokens":
            assert tuple(out.columns) == pipeline.COLUMNS
        assert stage(spark, empty, small_dir).count() == 0


def test_registration():
    assert len([n for n in QUERIES if n.startswith("op")]) == 13
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "source_mix", "tokens"]


def test_queries_against_sql(spark, duck, small_dir):
    for name, sql in contract.oracle_sql().items():
        if name in QUERIES:
            result = duck.execute(sql)
            columns = [c[0] for c in result.description]
            assert sorted(map(tuple, QUERIES[name](spark, small_dir).select(*columns).collect())) == sorted(result.fetchall()), name
