"""Order over whole tables without a window over all rows: numbers, running sums, deals, draws and neighbours.

Rows are dealt by ranges of the order and sorted within each range, so a task knows the number of each row in its range.
The ranges' sizes and sums are one row each; added up they are the offsets that make numbers and sums global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverflux.scratch import written

#: Rows of a range whose running sum one task computes at once.
BLOCK = 1 << 16
#: monotonically_increasing_id() holds the number of the partition above these bits and that of the row in them.
ROW_BITS = 33


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df as a table with range_ and at_: the range of the order that a row is in and its number there.

    Rows that agree in the order are told apart by a hash of all their columns, so results don't depend on how the
    table was read, but for rows that are equal in everything. The order is ascending and its nulls come first."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.withColumns({f"key{i}_": k for i, k in enumerate(keys)} | {"tie_": F.xxhash64(*df.columns)})
    by = [f"key{i}_" for i in range(len(keys))] + ["tie_"]
    dealt = named.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by)
    place = F.monotonically_increasing_id()
    return written(dealt.withColumn("place_", place).withColumns({"range_": F.shiftright("place_", ROW_BITS), "at_": F.col("place_").bitwiseAND((1 << ROW_BITS) - 1)}).drop("place_"))


def offsets(ranged: DataFrame, value: Column) -> DataFrame:
    """range_, before_: the sum of value over all ranges before each. There is a row for each partition of the table."""
    rows, total, out = ranged.groupBy("range_").agg(F.sum(value).alias("v")).collect(), 0, []
    for r in sorted(rows, key=lambda r: r["range_"]):
        out.append((r["range_"], total))
        total += r["v"] or 0
    kind = "double" if isinstance(total, float) else "long"
    return ranged.sparkSession.createDataFrame([(k, float(v) if kind == "double" else v) for k, v in out], f"range_ long, before_ {kind}")


def numbered(df: DataFrame, order: list[str | Column], name: str = "n", start: int = 1) -> DataFrame:
    """df with name: start, start + 1, ... in the order."""
    ranged = in_ranges(df, order)
    joined = ranged.join(F.broadcast(offsets(ranged, F.lit(1))), "range_")  # a row for each range
    return joined.withColumn(name, F.col("before_") + F.col("at_") + start).drop("range_", "at_", "before_")


def running_sum(df: DataFrame, order: list[str | Column], value: str, name: str = "upto") -> DataFrame:
    """df with name: the sum of value over all rows up to each in the order, itself included. Null values add nothing.

    A range is cut into blocks; a window sums up the rows of one block, another the blocks of one range."""
    ranged = in_ranges(df, order).withColumn("block_", F.floor(F.col("at_") / BLOCK))
    of = F.coalesce(F.col(value), F.lit(0))
    blocks = ranged.groupBy("range_", "block_").agg(F.sum(of).alias("v_"))
    earlier = Window.partitionBy("range_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_range_", F.coalesce(F.sum("v_").over(earlier), F.lit(0))).drop("v_")
    upto = Window.partitionBy("range_", "block_").orderBy("at_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(blocks, ["range_", "block_"]).join(F.broadcast(offsets(ranged, of)), "range_")  # a row for each range
    return joined.withColumn(name, F.sum(of).over(upto) + F.col("in_range_") + F.col("before_")).drop("range_", "at_", "before_", "block_", "in_range_")


def dealt(df: DataFrame, order: list[str | Column], k: int, name: str = "tile") -> DataFrame:
    """df with name, 1 to k: groups of consecutive rows of the order, as large as each other or the first ones larger by a row."""
    rows = written(numbered(df, order, "n_", 0))
    size, larger = divmod(rows.count(), k)
    edge = larger * (size + 1)
    tile = F.when(F.col("n_") < edge, F.floor(F.col("n_") / (size + 1))).otherwise(larger + F.floor((F.col("n_") - edge) / max(size, 1)))
    return rows.withColumn(name, (tile + 1).cast("int")).drop("n_")


def drawn(df: DataFrame, order: list[str | Column], weight: str, at: list[float]) -> DataFrame:
    """The row that each number of at (0 to below 1) falls on when the rows lie end to end in the order, as long as their
    weights: the first whose running sum exceeds the number's share of the total. Null weights and those of 0 or
    less are never drawn. A row drawn by several numbers comes once for each, with the number as draw."""
    rows = written(running_sum(df.where(F.col(weight) > 0), order, weight, "upto_"))
    total = rows.agg(F.max("upto_")).first()[0]
    if total is None:
        return df.limit(0).withColumn("draw", F.lit(0.0))
    # of the rows beyond each number the first: a minimum, so nothing is ordered again
    whole = F.struct("upto_", F.struct(*df.columns).alias("row"))
    first = rows.agg(*[F.min(F.when(F.col("upto_") > F.lit(u) * total, whole)).alias(f"d{i}") for i, u in enumerate(at)])
    picks = first.select(F.explode(F.array(*[F.struct(F.lit(float(u)).alias("draw"), F.col(f"d{i}").alias("x")) for i, u in enumerate(at)])).alias("p")).where("p.x is not null")
    return picks.select(*[F.col("p.x.row")[c].alias(c) for c in df.columns], "p.draw")


def in_blocks(df: DataFrame, number: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """df with block and inside: each block of size consecutive numbers, with the rows up to before numbers ahead of it and
    after behind it (inside is false for these), so that a window over a block sees what frames of that reach need."""
    size = max(size, before, after, 1)
    own = F.floor(F.col(number) / size)
    blocks = F.sequence(F.floor((F.col(number) - after) / size), F.floor((F.col(number) + before) / size))
    return df.withColumn("block", F.explode(blocks)).withColumn("inside", F.col("block") == own)
