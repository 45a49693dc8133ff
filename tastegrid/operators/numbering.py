"""Exact row numbers within groups, also where one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.session import reuse

#: Rows that one task of the sorted range holds, and so few that smaller tables still use several tasks.
PART_ROWS, LEAST_ROWS = 500_000, 20_000
_INDEX_BITS = 33


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[str], position: str = "position", size: str | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """``df`` with each row's place in its group, from 0, in ascending ``order`` (null first), and the group's ``size``.

    No group lies in one task: the rows are sorted by sampled range cuts over (group, order, input place), each range
    numbers its own rows, and a row's place is its number in the range plus what earlier ranges hold of its group, which
    is one small row per group and range.  Equal rows get different places in an arbitrary order.  The sorted ranges are
    kept (``session.reuse``), so that numbers do not change when a task is run again.
    """
    taken = {c.lower() for c in df.columns}
    place, tie = (next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n.lower() not in taken) for name in ("place", "tie"))
    kept = reuse(df)
    rows = kept.count()
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-rows // part_rows), min(shuffles, -(-rows // min(part_rows, LEAST_ROWS))), 1)
    along = [*by, *order, tie]
    ranges = kept.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *along).sortWithinPartitions(*along)
    # The id of a row says which range it lies in and where; it is read back, never computed anew.
    ranges = reuse(ranges.drop(tie).withColumn(place, F.monotonically_increasing_id()))
    part, index = F.shiftright(place, _INDEX_BITS), F.col(place).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    keys = [f"_by{i}" for i in range(len(by))]
    held = ranges.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], part.alias("_part"), index.alias("_index"))
    held = held.groupBy(*keys, "_part").agg(F.min("_index").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    held = held.withColumn("_size", F.sum("_rows").over(Window.partitionBy(*keys)))
    same = part == F.col("_part")
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    numbers = {position: index - F.col("_first") + F.col("_before"), **({size: F.col("_size")} if size else {})}
    columns = [c for c in df.columns if c not in numbers]
    return ranges.join(held, same).select(*columns, *[v.alias(n) for n, v in numbers.items()])
