"""Helpers shared by the operators: words of Arrow batches, groups in sorted streams, kept tables, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.session import scratch_path

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Spark patterns for a word and for the gap between words.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 4096


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, dtype=np.uint64)
    value = 1
    for i in range(count):
        out[i] = value
        value = value * base & (2**64 - 1)
    return out


_LOW = _powers(0x9E3779B97F4A7C15, _STEP)
_HIGH = pow(0x9E3779B97F4A7C15, _STEP, 2**64)
#: ASCII capitals to small letters, all other bytes unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer for 64-bit values; all bits of the input reach all bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of a column of texts: hash, byte span and text number of each, and the span of words of each text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = text_bytes(column)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        self.start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.end = np.flatnonzero(last) + 1
        # The words of text i are bounds[i]:bounds[i + 1].
        self.bounds = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        spans = np.diff(np.append(self.start, len(self.data)))
        place = np.arange(self.start[0], len(self.data)) - np.repeat(self.start, spans)
        tail = slice(self.start[0], None)
        value = _BYTE[self.data[tail]] * _LOW[place % _STEP]
        if (self.end - self.start).max() > _STEP:
            far = place >= _STEP
            value[far] *= np.array([pow(_HIGH, int(k), 2**64) for k in place[far] // _STEP], dtype=np.uint64)
        value[~inside[tail]] = 0
        length = (self.end - self.start).astype(np.uint64)
        return mix(np.add.reduceat(value, self.start - self.start[0]) + length * np.uint64(0xD6E8FEB86659FD93))

    def of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text, or a single text: bounds the working memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part, block = np.cumsum(size) // most_bytes, np.arange(batch.num_rows) // most_rows
        cuts = [0, *(np.flatnonzero(np.diff(part) | np.diff(block)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys in a stream sorted by them; only one run and one batch are held."""
    held: list[pa.RecordBatch] = []

    def key_of(batch, row):
        return tuple(batch.column(k)[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        if held and key_of(held[-1], held[-1].num_rows - 1) != key_of(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files, also after lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark) -> None:
    """Let Arrow batches end at 4 MB: the default of 64 MB or 10,000 rows is much for whole texts, once in the JVM and
    more than once in Python, in each task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column (compared without case) has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, so that a worker gives memory back: Arrow allocates from the system, which takes a
    freed batch back at once, and when the task ends what its tables and caches held is returned. Workers serve many tasks
    of many stages, and would else keep the largest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def bounded_sample(keys: DataFrame, by: list[str], each: dict[tuple, int]) -> DataFrame:
    """Of each group ``by`` that ``each`` names, so many of the rows of ``keys`` (or all), those with the smallest ``h``, a hash
    over 64 bits that no two rows of a group share. Each group is first cut to about a quarter more than that by the
    hash's range, so that only few rows of a group meet in one task."""
    counts = {tuple(r[c] for c in by): r["count"] for r in keys.groupBy(*by).count().collect()}
    wide = F.lit(0).cast("double")
    quota = F.lit(0)
    for group, wanted in each.items():
        here = F.lit(True)
        for c, value in zip(by, group):
            here = here & F.col(c).eqNullSafe(F.lit(value))
        share = min(1.0, (1.25 * wanted + 50) / max(1, counts.get(group, 0)))
        wide, quota = F.when(here, share).otherwise(wide), F.when(here, wanted).otherwise(quota)
    place = F.col("h").cast("double") / float(2**64) + 0.5
    few = keys.filter(place <= wide)
    ordered = Window.partitionBy(*by).orderBy("h")
    return few.withColumn("rank_in_sample", F.row_number().over(ordered)).filter(F.col("rank_in_sample") <= quota).drop("rank_in_sample")


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, spread: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression with a normal prior on each weight, by Newton steps; ``n`` counts the rows of ``x``."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + (w - prior) / spread**2
        curve = (x.T * (n * p * (1 - p))) @ x + np.diag(1 / spread**2)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of links ``(a, b)``: one row ``(node, component)`` per linked node, the smallest node.

    Alternating large-star and small-star steps; every step joins on one node column and merges links before they are
    shuffled. The loop ends when a step changes nothing; nodes and links stay in Spark.
    """
    links = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, step = _digest(links), 0
    while before[0]:
        step += 1
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_low, "a")
        links = joined.select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l"))
        links = keep(links.select("l.a", "l.b").filter("a <> b").distinct(), f"{name}-{step}")
        now = _digest(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 36)), F.lit(0)).alias("h")).head()
    return row["n"], row["h"]
