"""Language-model scoring by a subword lattice: the marginal probability of a text over all its segmentations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import Words, keep, slices


@dataclass(frozen=True)
class LatticeConfig:
    #: Text held together as one block: its distinct words are looked up once.
    block_bytes: int = 24 << 20
    #: Rounds of expectation and maximisation over the training words.
    rounds: int = 2
    #: Weight of the vocabulary's own scores against the counts of the training words.
    prior_tokens: float = 10_000.0
    #: Pieces of more bytes are left out; None: none are.
    longest_piece: int | None = None


# The vocabulary ------------------------------------------------------------------------------------------------------


@dataclass
class Pieces:
    """Subwords as bytes, a blank standing for the word's beginning, with natural log probabilities."""

    names: list[bytes]
    logs: np.ndarray
    end: float

    def __post_init__(self):
        self.longest = max(map(len, self.names))
        keys = _keys(self.names)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.place = {name: k for k, name in enumerate(self.names)}


_SALT = np.uint64(0x9E3779B97F4A7C15)


def _extend(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hash of a string that is one byte longer."""
    key = (key ^ (byte.astype(np.uint64) + np.uint64(1))) * _SALT
    return key ^ (key >> np.uint64(29))


def _keys(names: list[bytes]) -> np.ndarray:
    out = np.zeros(len(names), dtype=np.uint64)
    for k, name in enumerate(names):
        key = np.zeros(1, dtype=np.uint64)
        for byte in name:
            key = _extend(key, np.array([byte]))
        out[k] = key[0]
    if len(np.unique(out)) != len(out):
        raise ValueError("two pieces have one key")
    return out


def read_pieces(path: str | None = None, longest: int | None = None) -> Pieces:
    """Pieces of a sentencepiece model and their scores, turned into a distribution.

    The scores of the public vocabulary are ranks; rank ``r`` weighs ``1 / (r + 2.7)``. Pieces for single bytes make every
    text possible. Pieces with a blank inside never stand in a word and are left out, as are those longer than ``longest`` bytes
    if that is given.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    weight: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        name = model.id_to_piece(i).replace("▁", " ").encode()
        if (longest is None or len(name) <= longest) and b" " not in name[1:]:
            weight[name] = weight.get(name, 0.0) + 1 / (2.7 - min(0.0, model.get_score(i)))
    least = min(w for w in weight.values() if w > 0)
    names = sorted(weight)
    p = np.array([weight[n] or least / 10 for n in names])
    p = p / p.sum() * 0.99
    return Pieces(names, np.log(p), float(np.log(0.01)))


# The lattice ---------------------------------------------------------------------------------------------------------


class Lattice:
    """Lattices of many words at once: which piece, if any, each stretch of each word is."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        size = np.array([len(w) + 1 for w in words])
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        most = int(self.size[0])
        self.letters = np.zeros((len(words), most), dtype=np.uint8)
        for row, k in enumerate(self.order):
            self.letters[row, : size[k]] = np.frombuffer(b" " + words[k], dtype=np.uint8)
        self.pieces = pieces
        # Rows with at least n letters come first: how many they are.
        self.rows = [int(np.searchsorted(-self.size, -n, side="right")) for n in range(most + 1)]
        #: arcs[i][l - 1]: for the rows that reach place i, the piece of length l that ends there, or -1.
        self.arcs: list[list[np.ndarray]] = [[] for _ in range(most + 1)]
        for j in range(most):
            key = np.zeros(self.rows[j + 1], dtype=np.uint64)
            for i in range(j + 1, min(most, j + pieces.longest) + 1):
                key = _extend(key[: self.rows[i]], self.letters[: self.rows[i], i - 1])
                at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
                self.arcs[i].append(np.where(pieces.keys[at] == key, pieces.order[at], -1).astype(np.int32))
        for found in self.arcs:
            found.reverse()  # entered by growing start, read by growing length

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of all segmentations of each beginning, and of each whole word in the order given."""
        most = len(self.rows) - 1
        logs = np.append(self.pieces.logs, -np.inf)
        total = np.full((len(self.size), most + 1), -np.inf)
        total[:, 0] = 0.0
        for i in range(1, most + 1):
            n = self.rows[i]
            ways = np.stack([total[:n, i - 1 - k] + logs[arc] for k, arc in enumerate(self.arcs[i])])
            high = ways.max(axis=0)
            total[:n, i] = high + np.log(np.exp(ways - high).sum(axis=0))
        whole = np.empty(len(self.size))
        whole[self.order] = total[np.arange(len(self.size)), self.size]
        return total, whole

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` times each word."""
        total, _ = self.forward()
        most = len(self.rows) - 1
        logs = np.append(self.pieces.logs, -np.inf)
        weight = counts[self.order]
        rest = np.full((len(self.size), most + 1), -np.inf)
        rest[np.arange(len(self.size)), self.size] = 0.0
        whole = total[np.arange(len(self.size)), self.size]
        used = np.zeros(len(self.pieces.logs) + 1)
        for i in range(most, 0, -1):
            n = self.rows[i]
            for k, arc in enumerate(self.arcs[i]):
                step = logs[arc] + rest[:n, i]
                live = np.flatnonzero(step > -np.inf)
                j = i - 1 - k
                p = np.exp(total[live, j] + step[live] - whole[live]) * weight[live]
                used += np.bincount(arc[live], weights=p, minlength=len(used))
                rest[live, j] = np.logaddexp(rest[live, j], step[live])
        return used[:-1]


#: From so many bytes on a word is walked alone, step by step, in memory of its own length.
LONG = 256


def _arcs_into(word: bytes, i: int, pieces: Pieces) -> list[tuple[int, int]]:
    """Starts and pieces of the stretches of ``word`` that end at ``i``."""
    found = ((j, pieces.place.get(word[j:i])) for j in range(max(0, i - pieces.longest), i))
    return [(j, k) for j, k in found if k is not None]


def _long_forward(word: bytes, pieces: Pieces) -> list[float]:
    total = [0.0]
    for i in range(1, len(word) + 1):
        ways = [total[j] + pieces.logs[k] for j, k in _arcs_into(word, i, pieces)]
        high = max(ways)
        total.append(high + math.log(sum(math.exp(w - high) for w in ways)))
    return total


def _long_expected(word: bytes, pieces: Pieces) -> np.ndarray:
    total, used = _long_forward(word, pieces), np.zeros(len(pieces.names))
    # The share of all segmentations' probability that passes each place, from the end backwards.
    share = [0.0] * len(word) + [1.0]
    for i in range(len(word), 0, -1):
        for j, k in _arcs_into(word, i, pieces) if share[i] else ():
            p = share[i] * math.exp(total[j] + pieces.logs[k] - total[i])
            used[k] += p
            share[j] += p
    return used


def word_logs(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Log probability of each word, over all its segmentations."""
    out = np.empty(len(words))
    for some in _in_lengths(words):
        if len(words[some[0]]) >= LONG:
            out[some] = [_long_forward(b" " + words[k], pieces)[-1] for k in some]
        else:
            out[some] = Lattice([words[k] for k in some], pieces).forward()[1]
    return out


def expected_uses(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece in ``counts`` times each word."""
    used = np.zeros(len(pieces.names))
    for some in _in_lengths(words):
        if len(words[some[0]]) >= LONG:
            for k in some:
                used += counts[k] * _long_expected(b" " + words[k], pieces)
        else:
            used += Lattice([words[k] for k in some], pieces).expected(counts[some])
    return used


def _in_lengths(words: list[bytes], most: int = 20_000, cells: int = 400_000) -> Iterator[np.ndarray]:
    """Places of words of like length, few enough to bound the lattice's memory."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        b = a + max(1, min(most, int(cells // (size[order[a]] + 1))))
        while b - a > 1 and (b - a) * (size[order[min(b, len(order)) - 1]] + 1) > 2 * cells:
            b = a + (b - a) // 2
        b = min(b, max(a + 1, int(np.searchsorted(size[order], LONG)))) if size[order[a]] < LONG else b
        yield order[a:b]
        a = b


# The corpus ----------------------------------------------------------------------------------------------------------


def held_out(id_: str):
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 7 == 2, F.lit(False))


_BLOCK = "block long, doc_id long, held_out boolean, tokens array<int>, words array<binary>, counts array<long>"


def word_blocks(docs: DataFrame, config: LatticeConfig) -> DataFrame:
    """Blocks of documents: a row per document with its words as places in the block's list of distinct words, and a row
    per block with that list and how often each occurs in the block's training documents."""
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))

    def block_of(number: int, parts: list[tuple[pa.RecordBatch, Words]]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([w.hash for _, w in parts])
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        train = np.concatenate([~np.repeat(b.column("held_out").to_numpy(zero_copy_only=False), np.diff(w.bounds)) for b, w in parts])
        counts = np.bincount(place[train], minlength=len(first))
        edges = np.cumsum([0, *(len(w.hash) for _, w in parts)])
        part = np.searchsorted(edges, first, side="right") - 1
        names = [parts[p][1].of(k - edges[p]) for p, k in zip(part, first)]
        yield _rows(number, [None], [None], None, None, pa.array([names], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())))
        for (batch, words), at in zip(parts, edges):
            tokens = pa.ListArray.from_arrays(pa.array(words.bounds, pa.int32()), pa.array(place[at : at + len(words.hash)], pa.int32()))
            yield _rows(number, batch.column("doc_id"), batch.column("held_out"), tokens, batch.num_rows, None, None)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, parts = TaskContext.get().partitionId() << 24, 0, []
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            parts.append((batch.drop_columns("text"), words))
            size += len(words.data)
            if size >= config.block_bytes:
                yield from block_of(number, parts)
                number, size, parts = number + 1, 0, []
        if parts:
            yield from block_of(number, parts)

    return rows.mapInArrow(blocks, _BLOCK)


def _rows(number, doc_id, held, tokens, n, words, counts) -> pa.RecordBatch:
    n = n or 1
    none = pa.nulls
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, number), pa.int64()),
            pa.array(doc_id, pa.int64()) if isinstance(doc_id, list) else doc_id,
            pa.array(held, pa.bool_()) if isinstance(held, list) else held,
            tokens if tokens is not None else none(n, pa.list_(pa.int32())),
            words if words is not None else none(n, pa.list_(pa.binary())),
            counts if counts is not None else none(n, pa.list_(pa.int64())),
        ],
        names=["block", "doc_id", "held_out", "tokens", "words", "counts"],
    )


def learn(words: DataFrame, end_tokens: int, pieces: Pieces, config: LatticeConfig) -> Pieces:
    """Fit the pieces' probabilities to the training words, starting from the vocabulary's own scores.

    Executors sum the expected uses of each piece over their words; one number per piece reaches the driver.
    """
    prior = np.append(np.exp(pieces.logs), np.exp(pieces.end))
    for _ in range(config.rounds):

        def expect(batches: Iterator[pa.RecordBatch], now: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            used = np.zeros(len(now.names))
            for batch in batches:
                names, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False).astype(float)
                used += expected_uses(names, counts, now)
            some = np.flatnonzero(used)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int32()), "n": used[some]})

        sums = words.filter("c > 0").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        used = np.zeros(len(pieces.names) + 1)
        for r in sums:
            used[r["piece"]] = r["n"]
        used[-1] = end_tokens
        p = used + config.prior_tokens * prior
        p = p / p.sum()
        pieces = Pieces(pieces.names, np.log(p[:-1]), float(np.log(p[-1])))
    return pieces


def score(docs: DataFrame, config: LatticeConfig = LatticeConfig(), path: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    A text is its words and one end. ``score`` is its log10 probability under the subword unigram model: the sum over its
    words of the probability of all segmentations into pieces, by a forward recursion in logs, plus the end's.
    ``base_score`` is the add-one word unigram's. Both are learned from the documents that are not held out.

    Documents are read once into blocks; each block's distinct words meet the corpus-wide counts in one shuffle, words
    are scored once for the whole corpus, and the results go back to the blocks, whose size is bounded. A frequent word
    is one row per block. Null and empty texts have the end as their only token; rows with null id are training rows;
    repeated rows count each. An empty table gives no rows. Further columns of ``docs`` are not read.
    """
    blocks = keep(word_blocks(docs, config), "lm-blocks")
    listed = blocks.filter("words IS NOT NULL").select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    listed = listed.select("block", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = keep(listed.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    texts = blocks.filter("words IS NULL").select("block", "doc_id", "held_out", "tokens")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).head()
    ends = texts.filter(~F.col("held_out")).count()
    train, kinds = totals["n"] + ends, totals["v"] + (ends > 0)
    pieces = learn(counts, ends, read_pieces(path, config.longest_piece), config)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = word_logs(batch.column("word").to_pylist(), pieces)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs / np.log(10))], names=["word", "c", "logp"])

    scored = counts.mapInArrow(measure, "word binary, c long, logp double")
    back = listed.drop("n").join(scored, "word").select(F.col("block").alias("at"), "place", "c", "logp")
    end_base, end_score = np.log10((ends + 1) / (train + kinds + 1)), pieces.end / np.log(10)

    def sums(rows: pa.Table, found: pa.Table) -> pa.Table:
        n = found.num_rows
        c, logp = np.zeros(n, dtype=np.int64), np.zeros(n)
        at = found.column("place").to_numpy()
        c[at], logp[at] = found.column("c").to_numpy(), found.column("logp").to_numpy()
        base = np.log10((c + 1) / (train + kinds + 1))
        tokens = rows.column("tokens").combine_chunks()
        flat, size = tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy())
        edge = np.concatenate([[0], np.cumsum(size)])

        def total(value: np.ndarray) -> np.ndarray:
            if not len(flat):
                return np.zeros(len(size), dtype=value.dtype)
            out = np.add.reduceat(np.append(value[flat], value.dtype.type(0)), edge[:-1])
            out[size == 0] = 0
            return out

        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": rows.column("held_out"),
                "n_tokens": pa.array(size + 1, pa.int64()),
                "n_known": pa.array(total((c > 0).astype(np.int64)) + int(ends > 0), pa.int64()),
                "train_tokens": pa.array(np.full(len(size), train), pa.int64()),
                "base_score": total(base) + end_base,
                "score": total(logp) + end_score,
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(sums, schema)
