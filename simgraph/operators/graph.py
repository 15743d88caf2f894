"""Connected components over an edge table: contraction inside partitions, then alternating stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .skew import lookup

#: Edges that one step inside a partition holds.
CHUNK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of 0..n-1 that each is connected with by the edges ``a``-``b``."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _sortable(e: DataFrame) -> bool:
    return isinstance(e.schema["u"].dataType, (T.IntegralType, T.StringType))


def _contracted(e: DataFrame, tops: bool = False) -> DataFrame:
    """Stars that connect what the edges of each chunk of a partition connect; every vertex stays known.

    Needs no shuffle. Vertices of other types than whole numbers and strings are left as they are. With ``tops`` the middle
    of a star has a row too, which names itself.
    """
    kind = e.schema["u"].dataType
    if not _sortable(e):
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def star(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        m = t.num_rows
        both = pa.concat_arrays([c for x in ("u", "v") for c in t[x].chunks])
        if isinstance(kind, T.StringType):
            at, ids = pd.factorize(both.to_numpy(zero_copy_only=False), sort=True)
        else:
            ids, at = np.unique(both.to_numpy(), return_inverse=True)
        lab = roots(at[:m], at[m:], len(ids))
        alone = np.bincount(lab, minlength=len(ids)) == 1
        use = np.flatnonzero((lab != np.arange(len(ids))) | alone | tops)
        return pa.RecordBatch.from_arrays([pa.array(ids[use], both.type), pa.array(ids[lab[use]], both.type)], ["u", "v"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield star(held)
                held, n = [], 0
        if held:
            yield star(held)

    return e.select("u", "v").mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def _hung(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with the least neighbour m of u; rows of hubs would otherwise meet in one task."""
    return lookup(rows, low, ["u"], "n", total)


def _low(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a vertex is hung on the least vertex of the neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = _hung(both.filter("v > u"), _low(both), 2 * total)
    return up.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Every neighbour below a vertex, and the vertex itself, is hung on the least of them."""
    low = _low(e)
    hung = _hung(e, low, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v")))


def _is_star(e: DataFrame) -> bool:
    """Whether every vertex that hangs on another does so on one only, which hangs on none."""
    none = F.lit(None).cast(e.schema["v"].dataType)
    marks = e.select(F.col("u").alias("x"), F.col("v").alias("y"), F.lit(False).alias("top"))
    marks = marks.union(e.select(F.col("v"), none, F.lit(True)))
    per = marks.groupBy("x").agg((F.coalesce(F.min("y") != F.max("y"), F.lit(False)) | (F.max("top") & (F.count("y") > 0))).alias("bad"))
    return per.filter("bad").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges``; a component is its least vertex.

    Edges are first contracted inside their partitions. What is left of them ends in one step if a single chunk holds it,
    as no round is cheaper than that. Else what is no star yet goes through large-star and small-star steps until it is: O(log^2 n) rounds, each two partial aggregations and two joins by vertex in
    which hubs are broadcast, so that no vertex fills a task. Each round is written to the shared folder, so
    lost executors cost no earlier round, and deleted when the next one is there. Self loops and null ends are
    ignored, except that a self loop makes its vertex known. Raises if ``max_rounds`` do not suffice.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    with Scratch() as s:
        first = s.table(_contracted(e))
        if _sortable(first) and first.count() <= CHUNK:
            return s.result(_contracted(first.coalesce(1), tops=True).toDF("vertex", "component"))
        cur = first.filter("u <> v")
        for turn in range(max_rounds + 1):
            if _is_star(cur):
                break
            if turn == max_rounds:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
            last = cur
            star = s.table(_large_star(last, last.count()))
            cur = s.table(_contracted(_small_star(star, star.count()))).filter("u <> v")
            s.drop(star)
        rows = first.select("u").union(first.select("v")).select("u", F.col("u").alias("v")).union(cur.select("u", "v"))
        return s.result(rows.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component")))
