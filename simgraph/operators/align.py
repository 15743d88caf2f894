"""Diagonal alignment of two sequences of frame vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of a tile; two tiles meet in one matrix product.
TILE = 512


def diagonal_overlap(pairs: DataFrame, frames: DataFrame, threshold: float, id_col: str = "asset_id", vector_col: str = "embedding") -> DataFrame:
    """``(a, b, offset, match_count, n_a, n_b, overlap_ratio)`` for every pair.

    Frames i of a and j of b match where their cosine reaches ``threshold``. The offset j - i with the most
    matches wins, the smallest on ties; gaps are allowed. Without a match it is null and the count 0.

    A sequence is packed into tiles of ``TILE`` frames, so that a pair of assets moves a few rows, not one a cell, and a
    sequence of any length is never whole in one task.
    """
    need = pairs.select(F.col("a").alias(id_col)).union(pairs.select("b")).distinct()
    f = frames.join(need, id_col).select(F.col(id_col).alias("asset"), F.col("frame_index").cast("long").alias("i"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    n = f.groupBy("asset").count()
    packed = f.groupBy("asset", F.floor(F.col("i") / TILE).alias("tile")).agg(F.collect_list("i").alias("i"), F.flatten(F.collect_list("v")).alias("v"))
    x = packed.select(F.col("asset").alias("a"), F.col("i").alias("ia"), F.col("v").alias("va"))
    y = packed.select(F.col("asset").alias("b"), F.col("i").alias("ib"), F.col("v").alias("vb"))
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("a", "b")}

    def unit(flat: pa.Array, rows: int) -> np.ndarray:
        m = flat.to_numpy(zero_copy_only=False).reshape(rows, -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                i, j = (b.column(c)[r].values.to_numpy() for c in (2, 4))
                hit = unit(b.column(3)[r].values, len(i)) @ unit(b.column(5)[r].values, len(j)).T >= threshold
                p, q = np.nonzero(hit)
                if len(p):
                    offset, count = np.unique(j[q] - i[p], return_counts=True)
                    at = pa.array(np.full(len(offset), r))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(offset), pa.array(count)], ["a", "b", "offset", "k"])

    met = pairs.select("a", "b").distinct().join(x, "a").join(y, "b").select("a", "b", "ia", "va", "ib", "vb")
    cells = met.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, offset long, k long")
    per = cells.groupBy("a", "b", "offset").agg(F.sum("k").alias("match_count"))
    best = per.groupBy("a", "b").agg(F.max_by(F.struct("offset", "match_count"), F.struct("match_count", -F.col("offset"))).alias("m"))
    out = pairs.select("a", "b").join(best, ["a", "b"], "left")
    out = out.join(n.select(F.col("asset").alias("a"), F.col("count").alias("n_a")), "a", "left").join(n.select(F.col("asset").alias("b"), F.col("count").alias("n_b")), "b", "left")
    count = F.coalesce("m.match_count", F.lit(0)).cast("int")
    ratio = F.coalesce(F.try_divide(count, F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))), F.lit(0.0))
    return out.select("a", "b", F.col("m.offset").cast("int").alias("offset"), count.alias("match_count"), "n_a", "n_b", ratio.alias("overlap_ratio"))


def verdict(aligned: DataFrame, min_frames: int, min_ratio: float) -> DataFrame:
    ok = (F.col("match_count") >= min_frames) & (F.col("overlap_ratio") >= min_ratio)
    return aligned.withColumn("is_duplicate", ok)
