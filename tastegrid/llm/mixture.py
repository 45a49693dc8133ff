"""Mixing sources to target weights: equal-token blocks apportioned by highest quotients, chosen by seed."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import WORD, fresh


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    epochs: int = 2
    block_words: int = 64
    shard_words: int = 4_000_000
    seed: int = 29
    #: Sources are summarised on the driver; more than this many are an error.
    most_sources: int = 100_000


def word_count(text: str = "text"):
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: dict, config: MixConfig) -> dict:
    """Target words per source: shares by weight, at most ``epochs`` times a source's size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: config.weights[i % len(config.weights)] for i, s in enumerate(order)}
    left, open_, target = config.share * sum(sizes.values()), list(order), {s: 0.0 for s in order}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > config.epochs * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = float(config.epochs * sizes[s])
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in set(over)]
    return target


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Integer quotas: each next seat goes to the highest ``votes / (2 * quota + 1)``, the first of equals, up to ``most``.

    Seats below a quotient that surely has fewer takers than seats are given at once, the rest one by one.
    """
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    low, high = 0.0, max(votes, default=0.0) + 1.0

    def taken(level: float) -> list[int]:
        return [min(m, int((v / level + 1) / 2)) if v > 0 else 0 for v, m in zip(votes, most)]

    for _ in range(200):
        level = (low + high) / 2
        if level <= 0 or sum(taken(level)) > seats:
            low = level
        else:
            high = level
    quota = taken(high)
    heap = [(-v / (2 * q + 1), i) for i, (v, q, m) in enumerate(zip(votes, quota, most)) if v > 0 and q < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(quota)):
        _, i = heapq.heappop(heap)
        quota[i] += 1
        if quota[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * quota[i] + 1), i))
    return quota


def _quotas(epochs: int):
    def apportion(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("rank", kind="stable")
        votes = list(cells["cell_target"] * cells["blocks"] / cells["cell_words"])
        most = [epochs * int(b) for b in cells["blocks"]]
        cells["quota"] = sainte_lague(votes, round(sum(votes)), most)
        return cells[["shard", "rank", "cell_words", "blocks", "quota"]]

    return apportion


def mix(docs: DataFrame, config: MixConfig = MixConfig(), text: str = "text", source: str = "source", id_: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, taken`` and the place of the row's words in its stream.

    Documents are dealt over shards of about ``shard_words`` words by a seeded hash of id and text. Within a shard each
    source is a stream of words in seeded order, cut into blocks of about ``block_words`` (equal up to one word).
    Per shard, blocks are apportioned to sources by highest quotients, each source's votes being the blocks that its
    target asks for there; a source of quota ``q`` and ``n`` blocks takes every block ``q div n`` times and
    ``q mod n`` of them, chosen by systematic selection over the seeded order, once more. ``taken`` counts the words of
    a row in chosen blocks, repeats counted.

    Further columns: ``mix_offset`` (the row's first word in its stream), ``mix_words``, ``mix_blocks``, ``mix_quota``
    (words, blocks and quota of the stream); :func:`mixed_rows` reads them. Columns of these names are replaced.
    Null or wordless texts have size 0, take nothing and stay in the table with ``taken`` 0. A null source is a source of
    its own, the last in order. A null id is an id like others. Rows equal in id, text and source lie side by side in
    their stream, each with its own words. An empty table gives no rows. The result depends on rows and seed only.
    """
    added = ("size", "source_size", "target", "taken", "mix_offset", "mix_words", "mix_blocks", "mix_quota")
    docs = docs.drop(*added)
    used = [*docs.columns, *added]
    shard, rank, order, name = (fresh(used, c) for c in ("mix_shard", "mix_rank", "mix_order", "mix_source"))
    spark = docs.sparkSession
    sized = docs.withColumn("size", word_count(text))
    found = sized.groupBy(F.col(source).alias("s")).agg(F.sum("size").alias("n")).limit(config.most_sources + 1).collect()
    if len(found) > config.most_sources:
        raise ValueError(f"more than {config.most_sources} sources")
    sizes = {r["s"]: r["n"] for r in found}
    target = water_fill(sizes, config)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    shards = max(1, -(-sum(sizes.values()) // config.shard_words))
    facts = spark.createDataFrame(
        [(s, i, sizes[s], target[s]) for i, s in enumerate(names)], f"{name} string, {rank} int, source_size long, target double"
    )
    # One row per source: most_sources bounds it.
    placed = sized.join(F.broadcast(facts), F.col(source).eqNullSafe(F.col(name))).drop(name)
    placed = placed.withColumn(order, F.xxhash64(F.lit(config.seed), F.col(id_), F.col(text)))
    # Rows without words take nothing and are spread by their place; that place decides nothing else.
    placed = placed.withColumn(shard, F.when(F.col("size") > 0, F.pmod(F.col(order), F.lit(shards))).otherwise(-1 - F.monotonically_increasing_id() % 1024))
    cells = (
        placed.filter(F.col("size") > 0)
        .groupBy(F.col(shard).alias("shard"), F.col(rank).alias("rank"))
        .agg(F.sum("size").alias("cell_words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
        .withColumn("cell_target", F.col("target") * F.col("cell_words") / F.col("source_size"))
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("cell_words") / config.block_words)).cast("long"))
        .drop("target", "source_size")
    )
    quotas = cells.groupBy("shard").applyInPandas(_quotas(config.epochs), "shard long, rank int, cell_words long, blocks long, quota long")
    quotas = quotas.select(
        F.col("shard").alias(shard),
        F.col("rank").alias(rank),
        F.col("cell_words").alias("mix_words"),
        F.col("blocks").alias("mix_blocks"),
        F.col("quota").alias("mix_quota"),
    )
    stream = Window.partitionBy(shard, rank).orderBy(order, id_)
    offset = F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    streams = placed.withColumn("mix_offset", offset).join(quotas, [shard, rank], "left")
    start = F.col("mix_offset")
    taken = _words_before(start + F.col("size"), config.seed) - _words_before(start, config.seed)
    taken = F.when(F.col("mix_blocks").isNull(), F.lit(0)).otherwise(taken).cast("long")
    return streams.withColumn("taken", taken).select(*docs.columns, *added)


def _block(x):
    """Block of word ``x``: the first ``words mod blocks`` blocks are one word longer than the others."""
    short, longer = F.expr("mix_words div mix_blocks"), F.col("mix_words") % F.col("mix_blocks")
    head = longer * (short + 1)
    return F.when(x < head, F.floor(x / (short + 1))).otherwise(longer + F.floor((x - head) / short)).cast("long")


def _chosen_before(j, seed: int):
    """How many of the blocks before ``j`` are taken once more: systematic selection from a seeded start."""
    start = F.pmod(F.xxhash64(F.lit(seed), "mix_words", "mix_blocks", "mix_quota"), F.col("mix_blocks"))
    return F.floor((j * (F.col("mix_quota") % F.col("mix_blocks")) + start) / F.col("mix_blocks")).cast("long")


def _words_before(x, seed: int):
    """Words that the mix takes of the stream's first ``x`` words."""
    short, longer = F.expr("mix_words div mix_blocks"), F.col("mix_words") % F.col("mix_blocks")
    j = _block(x)
    begin = j * short + F.least(j, longer)
    whole = _chosen_before(j, seed) * short + _chosen_before(F.least(j, longer), seed)
    part = (_chosen_before(j + 1, seed) - _chosen_before(j, seed)) * (x - begin)
    return F.expr("mix_quota div mix_blocks") * x + whole + part


def mixed_rows(mixed: DataFrame, config: MixConfig = MixConfig(), text: str = "text") -> DataFrame:
    """The mixture itself: one row per pass over a row of :func:`mix` and the words which that pass takes.

    A row taken whole keeps its text as it is; of a row taken in part the chosen words follow each other with single
    blanks. Rows of which nothing is taken are left out. Columns are those of the input without the mix's own.
    """
    added = ("size", "source_size", "target", "taken", "mix_offset", "mix_words", "mix_blocks", "mix_quota")
    turn = fresh(mixed.columns, "turn")
    once = F.expr("mix_quota div mix_blocks")
    rows = mixed.filter("taken > 0").withColumn(turn, F.explode(F.sequence(F.lit(1), F.lit(config.epochs))))
    part = F.col("taken") - once * F.col("size")
    rows = rows.filter((F.col(turn) <= once) | ((F.col(turn) == once + 1) & (part > 0)))

    def is_chosen(_, i):
        j = _block(F.col("mix_offset") + i)
        return _chosen_before(j + 1, config.seed) > _chosen_before(j, config.seed)

    words = F.filter(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), is_chosen)
    whole = (F.col(turn) <= once) | (part == F.col("size"))
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(words, " ")))
    return rows.drop(*added, turn)


def source_mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Digest of the mixture: ``doc_id, size, source_size, target, taken``."""
    return mix(docs.select("doc_id", "text", "source"), config).select("doc_id", "size", "source_size", "target", "taken")
