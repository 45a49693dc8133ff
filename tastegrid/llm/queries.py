"""The registered queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import functools

from tastegrid.llm.bpe import token_digest
from tastegrid.llm.common import bounded_batches, documents
from tastegrid.llm.embedding import range_join
from tastegrid.llm.language import language_digest
from tastegrid.llm.lattice import score
from tastegrid.llm.merkle import merkle_digest
from tastegrid.llm.minhash import near_duplicate_digest
from tastegrid.llm.mixture import source_mix
from tastegrid.llm.pii import pii_digest
from tastegrid.llm.repetition import repetition_digest
from tastegrid.llm.secrets import secret_digest
from tastegrid.llm.sharding import shuffled_shards
from tastegrid.llm.sql import MERKLE, NEAR_DUPLICATES, PREFIX_TRIE, SECRETS, VECTOR_LINKS
from tastegrid.llm.toxicity import toxicity_digest
from tastegrid.llm.trie import prefix_trie


def op1_minhash_near_duplicates(spark, sf_dir):
    return near_duplicate_digest(documents(spark, sf_dir))


def op2_external_shuffle(spark, sf_dir):
    return shuffled_shards(documents(spark, sf_dir))


def op3_metric_range_join(spark, sf_dir):
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_pii_bootstrap(spark, sf_dir):
    return pii_digest(documents(spark, sf_dir))


def op5_bpe_automaton(spark, sf_dir):
    return token_digest(documents(spark, sf_dir))


def op6_lattice_likelihood(spark, sf_dir):
    return score(documents(spark, sf_dir).select("doc_id", "text"))


def op7_language_hierarchy(spark, sf_dir):
    return language_digest(documents(spark, sf_dir))


def op8_toxicity_automaton(spark, sf_dir):
    return toxicity_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_source_mix(spark, sf_dir):
    return source_mix(documents(spark, sf_dir))


def op10_suffix_repetition(spark, sf_dir):
    return repetition_digest(documents(spark, sf_dir))


def op11_splitter_skeleton(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_blob_ledger(spark, sf_dir):
    return secret_digest(documents(spark, sf_dir))


def op13_merkle_manifest(spark, sf_dir):
    return merkle_digest(documents(spark, sf_dir))


def _bounded(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    query.__name__: _bounded(query)
    for query in (
        op1_minhash_near_duplicates,
        op2_external_shuffle,
        op3_metric_range_join,
        op4_pii_bootstrap,
        op5_bpe_automaton,
        op6_lattice_likelihood,
        op7_language_hierarchy,
        op8_toxicity_automaton,
        op9_source_mix,
        op10_suffix_repetition,
        op11_splitter_skeleton,
        op12_blob_ledger,
        op13_merkle_manifest,
    )
}
SQL = {
    "op1_minhash_near_duplicates": NEAR_DUPLICATES,
    "op3_metric_range_join": VECTOR_LINKS,
    "op11_splitter_skeleton": PREFIX_TRIE,
    "op12_blob_ledger": SECRETS,
    "op13_merkle_manifest": MERKLE,
}
