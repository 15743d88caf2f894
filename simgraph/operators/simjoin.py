"""Cosine top-k joins and classification of their pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import dot, unit
from ..session import Scratch
from .skew import lookup

#: Vectors of a tile, those that visit it at once, and pivots that tell which tiles a vector need not meet, at most.
TILE, VISITORS, PIVOTS = 2048, 8192, 1024
#: Vectors of which expressions look at every pair; above, tiles do.
DIRECT = 2048


def topk_directed(vectors: DataFrame, k: int, floor: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``(a, b, similarity)``: for each a its k most similar others at ``floor`` or above, by similarity, then id.

    Pure expressions over every pair up to ``DIRECT`` vectors, or where ids are no whole numbers; beyond, the tiles of
    ``topk_blocks`` give the same rows. Similarities that are not a number are dropped.
    """
    kind = vectors.schema[id_col].dataType
    if isinstance(kind, T.IntegralType) and vectors.limit(DIRECT + 1).count() > DIRECT:
        return topk_blocks(vectors, k, floor, id_col, vector_col).withColumns({c: F.col(c).cast(kind) for c in ("a", "b")})
    v = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v"))
    x, y = v.select(F.col("id").alias("a"), F.col("v").alias("va")), v.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    sim = x.join(y, F.col("a") != F.col("b")).select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity"))
    sim = sim.filter((F.col("similarity") >= floor) & ~F.isnan("similarity"))
    return _best(sim, k)


def _best(sim: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return sim.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0).alias("v"))
    return v.filter("id is not null and v is not null").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length; zero vectors stay."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    if len(flat.value_lengths().unique()) > 1:
        raise ValueError("vectors differ in length")
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def topk_between(left: DataFrame, right: DataFrame, k: int, floor: float, id_col: str = "id", vector_col: str = "embedding", same: bool = False, tile: int = TILE) -> DataFrame:
    """``(a, b, similarity)``: for each a of ``left`` its k most similar b of ``right`` at ``floor`` or above, then by id.

    ``same`` says that both sides hold the same ids, and leaves out a = b. Vectors that are null or hold a null or
    non-finite number have no similarity; all others must have one length.

    Exact, by matrix products of tiles. Equal vectors are looked up once: of those that are equal only the least k + 1
    ids can be among any vector's best. The right side is dealt to tiles by its nearest pivot; a vector goes only to
    the tiles whose pivot is near enough, by the triangle inequality of angles, to hold anything at ``floor``. Each
    tile gives k rows a vector at most.
    """
    with Scratch() as s:
        mine, their = _usable(left, id_col, vector_col), _usable(right, id_col, vector_col)
        first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        their = s.table(their.withColumn("_r", first).filter(F.col("_r") <= k + 1).drop("_r"))
        mine = s.table(mine)
        kinds = s.table(mine.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("members")))
        n = their.count()
        if not n:
            return s.result(mine.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")))
        parts = max(1, -(-kinds.count() // VISITORS))
        going, waiting = _dealt(s, kinds.select(F.col("rep").alias("id"), "v"), their, n, floor, tile)
        going = going.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        waiting = waiting.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

        def meet(_, a, b):
            if not a.num_rows or not b.num_rows:
                return out.empty_table()
            b = b.sort_by("id")
            m, ib, got = _matrix(b["v"]), b["id"].to_numpy(), []
            for i in range(0, a.num_rows, tile):
                part = a.slice(i, tile)
                sim = _matrix(part["v"]) @ m.T
                top = np.argsort(-sim, axis=1, kind="stable")[:, : k + 1]
                r = np.repeat(np.arange(part.num_rows), top.shape[1])
                best = sim[r, top.ravel()]
                ok = best >= floor
                got.append(pa.table([pa.array(part["id"].to_numpy()[r][ok]), pa.array(ib[top.ravel()][ok]), pa.array(best[ok])], schema=out))
            return pa.concat_tables(got)

        met = going.groupBy("pivot", "tile", "part").cogroup(waiting.groupBy("pivot", "tile", "part")).applyInArrow(meet, "a long, b long, similarity double")
        best = s.table(_best(met, k + 1).withColumnRenamed("a", "rep"))
        whose = lookup(mine, kinds, ["v"], "members", mine.count()).select(F.col("id").alias("a"), "rep")
        pairs = whose.join(best, "rep").select("a", "b", "similarity")
        return s.result(_best(pairs.filter("a <> b") if same else pairs, k))


def _dealt(s: Scratch, mine: DataFrame, their: DataFrame, n: int, floor: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(visitors, tiles) of (id, v), both under the (pivot, tile) where they meet; ``their`` has ``n`` rows."""
    one = [F.lit(0).alias("pivot"), F.lit(0).alias("tile"), "id", "v"]
    if n <= tile:
        return mine.select(*one), their.select(*one)
    some = min(PIVOTS, -(-n // tile))
    # bounded by PIVOTS vectors
    pivots = _matrix(their.orderBy(F.xxhash64("id"), "id").limit(some).select("v").toArrow()["v"])

    def angles(col: pa.Array) -> np.ndarray:
        m = _matrix(col)
        a = np.arccos(np.clip(m @ pivots.T, -1, 1))
        a[~m.any(1)] = np.pi / 2  # a zero vector is at right angles to all
        return a

    def deal(batches):
        for b in batches:
            if b.num_rows:
                a = angles(b.column(1))
                at = a.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(a[np.arange(len(at)), at])], ["id", "v", "pivot", "angle"])

    dealt = s.table(their.mapInArrow(deal, "id long, v array<double>, pivot int, angle double"))
    sizes = dealt.groupBy("pivot").agg(F.max("angle").alias("far"), F.count("*").alias("n"), F.max(~F.exists("v", lambda x: x != 0)).alias("zero")).collect()  # a row a pivot
    reach = np.full(len(pivots), -np.inf)
    tiles = np.zeros(len(pivots), np.int64)
    for r in sizes:
        # nothing is known about where a zero vector lies, and it is similar by 0 to all
        reach[r.pivot], tiles[r.pivot] = (np.inf if r.zero and floor <= 0 else r.far), -(-r.n // tile)
    wide = np.arccos(np.clip(floor, -1, 1)) if floor > -1 else np.pi

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = angles(b.column(1)) <= wide + reach + 1e-6
            near[~_matrix(b.column(1)).any(1)] = floor <= 0
            row, at = np.nonzero(near & (tiles > 0))
            m = tiles[at]
            row, at, t = np.repeat(row, m), np.repeat(at, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            for i in range(0, len(row), 4096):
                part = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(at[part].astype(np.int32)), pa.array(t[part].astype(np.int32)), *(b.column(c).take(pa.array(row[part])) for c in (0, 1))], ["pivot", "tile", "id", "v"])

    going = mine.mapInArrow(visit, "pivot int, tile int, id long, v array<double>")
    count = F.element_at(F.lit([int(x) for x in tiles]), F.col("pivot") + 1)
    return going, dealt.select("pivot", F.pmod(F.xxhash64("id"), count).cast("int").alias("tile"), "id", "v")


def topk_blocks(vectors: DataFrame, k: int, floor: float, id_col: str = "id", vector_col: str = "embedding", block_rows: int = TILE) -> DataFrame:
    """The same rows as ``topk_directed`` by matrix products of tiles, see ``topk_between``."""
    return topk_between(vectors, vectors, k, floor, id_col, vector_col, same=True, tile=block_rows)


def undirected(directed: DataFrame) -> DataFrame:
    """One row a pair, smaller id first, with the greater similarity of both directions."""
    return directed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def classify(pairs: DataFrame, types: DataFrame, resolve: float, escalate: float, id_col: str = "asset_id") -> DataFrame:
    """Adds types and a status: resolved, or escalate where both are videos; other pairs are dropped."""
    ta = types.select(F.col(id_col).alias("a"), F.col("type").alias("type_a"))
    tb = types.select(F.col(id_col).alias("b"), F.col("type").alias("type_b"))
    videos = (F.col("type_a") == "video") & (F.col("type_b") == "video")
    status = F.when(F.col("similarity") >= resolve, "resolved").when(videos & (F.col("similarity") >= escalate), "escalate")
    return pairs.join(ta, "a").join(tb, "b").withColumn("status", status).filter("status is not null")
