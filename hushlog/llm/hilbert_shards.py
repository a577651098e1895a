"""Shards cut from a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits; rows are sorted by the place of their cell on the Hilbert
curve and cut into runs of equal length, so that a shard covers a small box in every dimension and
readers can skip most shards by their minima and maxima.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlog.functions.checkpoints import stored
from hushlog.llm.arrow import free_names, without

#: Bits of a dimension. Three of them make at most 2**15 cells, whatever the table holds.
BITS = 5


def hashed(value: Column, bits: int = BITS) -> Column:
    """A name as a dimension: equal names share a bucket; null has one too."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")


def scaled(value: Column, bits: int = BITS) -> Column:
    """A positive size as a dimension: two buckets for each doubling from 8 on; null is the first."""
    steps = F.floor(2 * F.log2(F.greatest(value, F.lit(8)).cast("double"))) - 6
    return F.coalesce(F.least(steps, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def with_curve(cells: DataFrame, dims: Sequence[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """``cells`` with the Hilbert index of the integer columns ``dims``, each below ``2**bits``."""
    n = len(dims)
    keep = cells.columns
    *axes, turned = free_names(keep, n + 1, "x")
    df = cells.select("*", *[F.col(d).cast("int").alias(axis) for d, axis in zip(dims, axes)])
    x = [F.col(axis) for axis in axes]
    # turn the axes back level by level: flip the first axis, or exchange its low bits with another's
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = x[i].bitwiseAND(1 << level) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            first = x[0].bitwiseXOR(F.when(high, F.lit(low)).otherwise(swap))
            other = F.when(high, x[i]).otherwise(x[i].bitwiseXOR(swap))
            df = df.withColumns({axes[0]: first} if i == 0 else {axes[0]: first, axes[i]: other})
    for i in range(1, n):  # Gray code
        df = df.withColumn(axes[i], x[i].bitwiseXOR(x[i - 1]))
    turn = F.lit(0)
    for level in range(bits - 1, 0, -1):
        bit = x[n - 1].bitwiseAND(1 << level) != 0
        turn = turn.bitwiseXOR(F.when(bit, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn(turned, turn)
    df = df.withColumns({axes[i]: x[i].bitwiseXOR(F.col(turned)) for i in range(n)})
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(x[i], level).bitwiseAND(1).cast("long")
            index = F.shiftleft(index, 1).bitwiseOR(bit)
    return df.select(*keep, index.alias(name))


def with_shards(
    rows: DataFrame,
    dims: Sequence[Column],
    order: Sequence[str],
    n_shards: int,
    bits: int = BITS,
) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` (from 0) and ``slot`` (from 0 in each shard).

    Rows are taken by Hilbert index, then by the columns ``order``; the shards are runs of them
    whose lengths differ by one at most. Rows equal in all of these are interchangeable. Columns of
    these names are replaced; an empty table stays empty. Runs a job: the sorted rows are written
    to the shared folder once, in partitions of like size (a crowded cell is cut by ``order``), and
    only the partitions' row counts are put in sequence.
    """
    if len(dims) * bits > 15:
        raise ValueError("the table of cells must stay small: at most 15 bits in all")
    base = without(rows, ["curve", "shard", "slot"])
    *names, part, before, place = free_names(base.columns, len(dims) + 3, "d")
    base = base.select("*", *[d.alias(n) for d, n in zip(dims, names)])
    # at most 2**15 rows, by construction
    cells = with_curve(base.select(*names).distinct(), names, bits)
    placed = base.join(F.broadcast(cells), names).drop(*names)
    dealt = placed.repartitionByRange("curve", *order).withColumn(part, F.spark_partition_id())
    ordered = stored(dealt, "curve")
    parts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = F.row_number().over(Window.partitionBy(part).orderBy("curve", *order)) - 1
    # one row for each partition of the range sort
    ranked = ordered.withColumn(place, inside).join(F.broadcast(offsets), part)
    ranked = ranked.withColumn(place, F.col(before) + F.col(place))
    shard = F.expr(f"CAST((({place} + 1) * {n_shards} - 1) DIV {max(total, 1)} AS INT)")
    start = F.expr(f"(shard * CAST({total} AS BIGINT)) DIV {n_shards}")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", F.col(place) - start)
        .drop(part, before, place)
    )


def write_shards(sharded: DataFrame, folder: str) -> None:
    """Write a folder for each shard, its files in slot order; large shards take several files."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(folder)
