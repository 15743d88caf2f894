"""Joins and numberings in which no key, however frequent, fills a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release

#: A key with more than this share of all rows is hot; there are at most 1 / HOT of them.
HOT = 1e-3
#: Rows that a window sorts in one task.
LARGE = 1 << 20


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``weight`` how many ``rows`` have it.

    The weights add up to ``total`` at most, so hot keys are few, and their rows of ``table`` are broadcast; the other rows
    meet by a sorted join. ``how`` is inner or left. ``weight`` is dropped.
    """
    some = F.col(weight) > HOT * total
    hot, rest = F.broadcast(table.filter(some).drop(weight)), table.filter(~some).drop(weight)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest.hint("merge"), keys, how)
    return rows.join(hot, keys).unionByName(cold)


def ranks(keys: DataFrame, cols: str | list, out: str) -> DataFrame:
    """``keys`` with each row's 0-based place in the order of ``cols``, without a window over all rows.

    Range partitions are counted and numbered; rows then add what lies before their partition. Rows that tie
    get neighbouring places in any order. The result is materialized.
    """
    cols = [cols] if isinstance(cols, str) else cols
    spread = materialize(keys.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    before = spread.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*cols)) - 1
    # one row a partition
    named = spread.withColumn(out, inside).join(F.broadcast(before.select("_part", "_before")), "_part")
    done = materialize(named.withColumn(out, (F.col(out) + F.coalesce("_before", F.lit(0))).cast("long")).select(*keys.columns, out))
    release(spread)
    return done


def rank_within(df: DataFrame, group: str, order: list[str | Column], out: str = "rank") -> DataFrame:
    """``df`` with each row's 0-based place in its group, under ``order``.

    Groups are sorted in one task each as long as the largest has ``LARGE`` rows at most; otherwise all rows are
    numbered by ranges of (group, order), which divide a group too, and each group's first number is taken off.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= LARGE:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    numbered = ranks(df, [group, *order], "_rank")
    first = numbered.groupBy(group).agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    placed = lookup(numbered, first, [group], "_n", numbered.count())
    return placed.withColumn(out, (F.col("_rank") - F.col("_first")).cast("int")).select(*df.columns, out)
