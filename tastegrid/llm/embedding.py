"""Embedding near-duplicates by an exact metric range join: pivots cut the space, the triangle inequality bounds copies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import components, groups, keep


@dataclass(frozen=True)
class RangeJoinConfig:
    cosine: float = 0.93
    #: A label gets one pivot for about so many distinct vectors.
    cell_rows: int = 1024
    #: Bounds of what the driver holds: vectors sampled by hash to choose pivots from, and pivots.
    sample_rows: int = 20_000
    most_pivots: int = 4_096
    #: Vectors of either side that one task compares.
    block_rows: int = 2048


def usable(embedding: str = "embedding", label: str = "label"):
    """Vectors that can be linked: labelled, without null or non-finite components, not zero."""
    v = F.col(embedding)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy().astype(np.float64).reshape(len(rows), -1)
    # Scaled first, so that squares of very large or small components stay in range.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def choose_pivots(classes: DataFrame, config: RangeJoinConfig) -> dict[str, np.ndarray]:
    """For each space (label and dimension) that is large enough, pivots far from each other, from a bounded sample."""
    sizes = classes.groupBy("space").count().filter(F.col("count") > config.cell_rows).orderBy(F.desc("count"), "space").limit(config.most_pivots).collect()
    total, pivots, left = sum(r["count"] for r in sizes), {}, config.most_pivots
    if not total:
        return pivots
    share = int((1 << 20) * min(1.0, config.sample_rows / total))
    large = classes.join(F.broadcast(classes.sparkSession.createDataFrame([(r["space"],) for r in sizes], "space string")), "space", "left_semi")
    sample = large.filter(F.pmod(F.xxhash64(F.lit("pivot"), "embedding"), F.lit(1 << 20)) < share).select("space", "embedding")
    found: dict[str, list] = {}
    for r in sample.orderBy(F.xxhash64("embedding"), "embedding").limit(2 * config.sample_rows).toLocalIterator():
        found.setdefault(r["space"], []).append(r["embedding"])
    for r in sizes:
        rows = found.get(r["space"], [])
        count = min(-(-r["count"] // config.cell_rows), len(rows), left)
        if count < 2:
            continue
        points = _unit(pa.array(rows, pa.list_(pa.float64())))
        chosen, gap = [0], _distances(points, points[:1])[:, 0]
        while len(chosen) < count:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _distances(points, points[chosen[-1:]])[:, 0])
        pivots[r["space"]] = points[chosen]
        left -= count
    return pivots


def cells(classes: DataFrame, pivots: dict[str, np.ndarray], config: RangeJoinConfig) -> DataFrame:
    """``space, cell, home, node, m, embedding``: each vector in the cell of its nearest pivot, and as a guest in each
    later cell that may hold a partner.

    With range r, a partner whose nearest pivot is q lies within r of x, so that d(x, q) <= d(x, p) + 2 r for the pivot
    p nearest to x. A pair of two cells meets in the later one.
    """
    reach = 2 * np.sqrt(2 - 2 * config.cosine) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = np.array(batch.column("space").to_pylist(), dtype=object)
            row, cell, home = [], [], []
            for name in dict.fromkeys(space):
                here = np.flatnonzero(space == name)
                points = pivots.get(name)
                if points is None:
                    row, cell, home = [*row, here], [*cell, np.zeros(len(here), dtype=np.int64)], [*home, np.ones(len(here), dtype=bool)]
                    continue
                for some in np.array_split(here, -(-len(here) // 1024)):
                    far = _distances(_unit(batch.column("embedding").take(pa.array(some))), points)
                    own = far.argmin(axis=1)
                    into = far <= far.min(axis=1, keepdims=True) + reach
                    into &= np.arange(len(points)) >= own[:, None]
                    i, c = np.nonzero(into)
                    row, cell, home = [*row, some[i]], [*cell, c], [*home, c == own[i]]
            taken = pa.array(np.concatenate(row))
            columns = [batch.column(k).take(taken) for k in ("space", "node", "m", "embedding")]
            names = ["space", "node", "m", "embedding", "cell", "home"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(cell), pa.int64()), pa.array(np.concatenate(home))], names=names)

    schema = "space string, node long, m long, embedding array<double>, cell long, home boolean"
    return classes.select("space", "node", "m", "embedding").mapInArrow(place, schema)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place in the component of each of ``n`` places linked by ``a, b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def joined(placed: DataFrame, config: RangeJoinConfig) -> DataFrame:
    """``node, n, root`` for each task in which a node has links: how many vectors it is linked with, and a node that it
    is connected with there. Every pair of a cell meets in one task; large cells are dealt over several."""
    size = placed.groupBy("space", "cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("guests"))
    rows = placed.join(size, ["space", "cell"])
    most = config.block_rows
    parts = F.greatest(F.lit(1), F.ceil(F.col("homes") / most)).cast("int")
    others = F.greatest(F.lit(1), F.ceil(F.col("guests") / most)).cast("int")
    rows = rows.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node"), F.when(F.col("home"), parts).otherwise(others)).cast("int")})
    # Task (i, j): homes of part i with homes of part j <= i; task (i, -1 - j): homes of part i with guests of part j.
    with_homes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.greatest("own", k).alias("i"), F.least("own", k).alias("j")))
    with_guests = F.transform(F.sequence(F.lit(0), others - 1), lambda k: F.struct(F.col("own").alias("i"), (-1 - k).alias("j")))
    with_guests = F.when(F.col("guests") > 0, with_guests).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("i"), (-1 - F.col("own")).alias("j")))
    tasks = F.explode(F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest)).alias("t")
    dealt = rows.select("space", "cell", "home", "node", "m", "embedding", "own", tasks).select("*", F.col("t.i").alias("i"), F.col("t.j").alias("j")).drop("t")
    dealt = dealt.repartition("space", "cell", "i", "j").sortWithinPartitions("space", "cell", "i", "j")
    least = config.cosine

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["space", "cell", "i", "j"]):
            home, own = group.column("home").to_numpy(), group.column("own").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left = np.flatnonzero(home & (own == i))
            right = np.flatnonzero(~home) if j < 0 else np.flatnonzero(home & (own == j))
            if not len(left) or not len(right):
                continue
            node, m = group.column("node").to_numpy(), group.column("m").to_numpy()
            unit = _unit(group.column("embedding"))
            a, b = [], []
            for some in np.array_split(left, -(-len(left) // 512)):
                x, y = np.nonzero(unit[some] @ unit[right].T >= least)
                x, y = some[x], right[y]
                once = node[x] < node[y] if i == j else np.ones(len(x), dtype=bool)
                a.append(x[once])
                b.append(y[once])
            a, b = np.concatenate(a), np.concatenate(b)
            if not len(a):
                continue
            links = np.bincount(a, weights=m[b], minlength=len(node)) + np.bincount(b, weights=m[a], minlength=len(node))
            label = _labels(len(node), a, b)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[label[some]])], names=["node", "n", "root"])

    return dealt.mapInArrow(compare, "node long, n long, root long")


def range_join(vectors: DataFrame, config: RangeJoinConfig = RangeJoinConfig(), id_: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two vectors are linked if their labels and dimensions are equal and their cosine, in double precision, is at least
    ``cosine``. Equal vectors of a label are one class with a count, so copies meet nobody one by one. Null, empty and
    zero vectors, those with null or non-finite components and those without a label are linked with nothing. A null id
    has no part in the smallest id; rows of a component of null ids have a null ``component_id`` and are kept. An empty
    table gives no rows; further columns are not read.

    Pivots come from a sample of bounded size and decide only how the work is cut, never the result.
    """
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", usable())
    space = F.concat_ws("/", F.size("embedding").cast("string"), "label").alias("space")
    by_vector = rows.filter("ok").groupBy(space, "embedding")
    classes = by_vector.agg(F.count("*").alias("m"), F.min("id").alias("low"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "range-classes")
    found = keep(joined(cells(classes, choose_pivots(classes, config), config), config), "range-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    component = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "range-components")
    known = classes.join(counts, "node", "left").join(component, "node", "left")
    known = known.withColumns({"n": F.coalesce("n", F.lit(0)) + F.col("m") - 1, "component": F.coalesce("component", "node")})
    lowest = known.groupBy("component").agg(F.min("low").alias("lowest"))
    known = known.join(lowest, "component").select(F.col("space").alias("s"), F.col("embedding").alias("v"), "n", "lowest")
    own = F.when(F.col("ok"), space)
    out = rows.withColumn("space", own).join(known, (F.col("space") == F.col("s")) & (F.col("embedding") == F.col("v")), "left")
    out = out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
