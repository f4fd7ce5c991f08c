"""Running counts within a key that one key cannot overload: the rows of a key are cut at quantiles of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Most parts that the rows of one key are cut into.
PARTS = 256
#: Rows of a key that one task still sorts.
HEAVY = 1_000_000


def parts_of(df: DataFrame, order: str, parts: int) -> Column:
    """The number of a row's part: how many of the quantiles of `order`, a bounded list at the driver, lie below it."""
    if parts < 2:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q
    held = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast(ArrayType(df.schema[order].dataType))
    return (F.array_position(F.sort_array(F.array_append(held, F.col(order))), F.col(order)) - 1).cast("int")


def heaviest(df: DataFrame, by: list[str], heavy: int = HEAVY) -> bool:
    """Whether a key has over `heavy` rows."""
    return not df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).isEmpty()


def running_count(df: DataFrame, by: list[str], order: str, counted: Column, name: str, parts: int = 1) -> DataFrame:
    """df with `name`: how many rows of the same `by` with `counted` are at or before the row in `order`.

    With several parts, rows of a key are counted in parts of about equal size and the counts of the parts before are
    added; a part is what one task sorts. Rows of equal order must all be counted or none, or be told apart by it.
    """
    one = counted.cast("bigint")
    if parts == 1:
        return df.withColumn(name, F.sum(one).over(Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)))
    rows = df.withColumns({"__part": parts_of(df, order, parts), "__one": one})
    keys = [*by, "__part"]
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows of a key
    sums = rows.groupBy(*keys).agg(F.sum("__one").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    inside = F.sum("__one").over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__inside", inside).join(sums.select(*keys, "__before"), keys)
    return out.withColumn(name, F.col("__inside") + F.col("__before")).select(*df.columns, name)
