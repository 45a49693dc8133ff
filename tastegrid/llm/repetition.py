"""Quality rules on repetition: a suffix array per text, longest common prefixes, and the words they cover."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tastegrid.llm.common import Words, slices


@dataclass(frozen=True)
class RepetitionConfig:
    #: Shorter repeats than this many words do not count.
    least_words: int = 8
    #: Share of a text's words that repeats may cover, and the longest repeat allowed, in words.
    most_covered: float = 0.25
    longest: int = 100
    #: Rules that hold besides: fewest words, and percent of words in repeated five-word windows.
    fewest_words: int = 10
    repeat_percent: int = 20


#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
COLUMNS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "n_covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
}


def _ranks(key: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ranks from 1 of ``key`` in its order; whether all differ."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank, bool(new.all())


class Suffixes:
    """Suffix arrays of the word sequences of many texts at once, by prefix doubling.

    ``levels[k][i]`` ranks the ``2 ** k`` words from word ``i`` on among those of its text; a suffix that ends earlier
    has a rank of its own. Ranks of different texts differ, so texts never meet.
    """

    def __init__(self, words: Words):
        n = len(words.hash)
        self.end = words.bounds[1:][words.text] if n else np.zeros(0, dtype=np.int64)
        _, ids = np.unique(words.hash, return_inverse=True)
        rank, _ = _ranks(words.text.astype(np.int64) * (n + 1) + ids)
        self.levels = [rank.astype(np.int32)]
        here, longest = np.arange(n), int(np.diff(words.bounds).max(initial=0))
        while True:
            step = 1 << (len(self.levels) - 1)
            after = np.zeros(n, dtype=np.int64)
            inside = here + step < self.end
            after[inside] = rank[here[inside] + step]
            rank, done = _ranks(rank * (n + 1) + after)
            # The last level is needed for the order only once it tells all suffixes apart; windows need two levels.
            self.levels.append(rank.astype(np.int32))
            if (done or step >= longest) and len(self.levels) > 2:
                break
        self.order = np.argsort(rank)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length in words of the longest common prefix of the suffixes at ``a`` and ``b``."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        a_end, b_end = self.end[a], self.end[b]
        for k in range(len(self.levels) - 1, -1, -1):
            live = np.flatnonzero((a + (1 << k) <= a_end) & (b + (1 << k) <= b_end))
            same = live[self.levels[k][a[live]] == self.levels[k][b[live]]]
            for x in (a, b, length):
                x[same] += 1 << k
        return length

    def repeats(self) -> np.ndarray:
        """For each word, the longest substring from it on that its text has a second time.

        Neighbours in suffix order share the longest prefix, so this is the deepest common-prefix interval around it.
        """
        n = len(self.order)
        shared = np.zeros(n + 1, dtype=np.int64)
        if n > 1:
            shared[1:n] = self.common(self.order[:-1], self.order[1:])
        out = np.empty(n, dtype=np.int64)
        out[self.order] = np.maximum(shared[:-1], shared[1:])
        return out


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in the union of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line.strip():
            count += line in seen
            seen.add(line)
    return count


def measure(column: pa.Array, config: RepetitionConfig = RepetitionConfig()) -> dict[str, np.ndarray]:
    """All columns of ``COLUMNS`` for a column of texts."""
    words = Words(column)
    n, texts = len(words.start), len(words.offsets) - 1
    bounds = words.bounds

    def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[edges[1:]] - total[edges[:-1]]

    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    suffixes = Suffixes(words)
    window = np.flatnonzero(np.arange(n) + 5 <= suffixes.end)
    key = suffixes.levels[2][window].astype(np.int64) * (n + 1) + suffixes.levels[0][window + 4]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = window[count[which] > 1] if len(window) else window
    repeated = covered(twice, np.full(len(twice), 5), n)
    length = suffixes.repeats()
    long = np.flatnonzero(length >= config.least_words)
    spans = covered(long, length[long], n)
    n_words, n_repeat, n_covered = np.diff(bounds), per_text(repeated, bounds), per_text(spans, bounds)
    longest = np.zeros(texts, dtype=np.int64)
    np.maximum.at(longest, words.text[long], length[long])
    whole = words.data.tobytes()
    failed = (n_words < config.fewest_words) | (100 * n_repeat > config.repeat_percent * n_words)
    kept = ~failed & (n_covered <= config.most_covered * n_words) & (longest <= config.longest)
    return {
        "n_words": n_words,
        "word_chars": per_text(inside & ((words.data & 0xC0) != 0x80), words.offsets),
        "n_symbols": per_text(symbol[words.data], words.offsets),
        "n_dup_lines": np.array([duplicate_lines(whole[a:b]) for a, b in zip(words.offsets, words.offsets[1:])], dtype=np.int64),
        "n_repeat_words": n_repeat,
        "n_covered_words": n_covered,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": kept,
    }


def repetition_rules(docs: DataFrame, config: RepetitionConfig = RepetitionConfig(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the measures of ``COLUMNS``.

    A text is a sequence of words. Its suffix array gives for each word the longest stretch from there on that occurs
    twice; stretches of ``least_words`` or more are repeats, and ``kept`` asks that the union of their spans covers at
    most ``most_covered`` of the words, that none is longer than ``longest`` and that the base rules hold
    (``base_failed``). Null and empty texts have no words and fail the base rules. Each row is judged alone, repeated
    rows alike. Columns of the input named like a measure are replaced. An empty table gives no rows. A task holds about
    1 MB of text, or one longer text, at a time.
    """
    docs = docs.drop(*COLUMNS)
    names = list(COLUMNS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = measure(batch.column(text), config)
            new = [pa.array(found[c], COLUMNS[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    fields = [StructField(c, BooleanType() if kind == pa.bool_() else LongType()) for c, kind in COLUMNS.items()]
    return docs.mapInArrow(rows, StructType([*docs.schema.fields, *fields]))


def repetition_digest(docs: DataFrame, config: RepetitionConfig = RepetitionConfig()) -> DataFrame:
    """``doc_id`` and the measures of every document."""
    return repetition_rules(docs.select("doc_id", "text"), config).drop("text")
