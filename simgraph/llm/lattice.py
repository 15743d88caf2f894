"""Embedding near-duplicates by E8 lattice hashing.

A table projects a unit vector at random onto eight dimensions a block, scales it and decodes it to the
nearest point of the E8 lattice, block by block; the points' numbers make up its cell. Each vector is put
into its own cell and into the cells next to it that lie nearest, so that two vectors meet in a table if one's cell is
among the other's. Every pair that meets is verified by its cosine in double precision.

Equal vectors are one class from the start. Where the pairs of a cell that come near the similarity are few, each is
verified; where they are many, their members are a group, all of whose pairs are compared tile by tile.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.skew import lookup, ranks
from ..session import Scratch
from ._words import U, mix
from .jaccard import grouped, linked_rows, links_of, meetings, pairs_and_groups, runs

#: Members of a bucket or tile, and numbers in a tile's vectors, that one kernel compares at once.
TILE, TILE_NUMBERS = 1024, 1 << 22
#: Lengths of vectors that may be broadcast.
MANY = 10_000
BLOCK_DIM = 8


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for s in itertools.product((0.5, -0.5), repeat=8):
        if sum(x < 0 for x in s) % 2 == 0:
            out.append(np.array(s))
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    if len(odd):
        e = x[odd] - r[odd]
        k = np.abs(e).argmax(1)
        r[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: the even-sum integers or those shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


_MINIMAL = minimal_vectors()


class Tables:
    """Projections of one number of dimensions, the same on every machine."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int = 17) -> None:
        r = np.random.default_rng(seed + dim)
        self.proj = r.normal(0, scale, (tables, dim, BLOCK_DIM * blocks))
        self.tables, self.blocks, self.probes, self.seed = tables, blocks, probes, seed
        self.salt = r.integers(0, 1 << 63, (blocks, BLOCK_DIM), dtype=np.int64).view(U) | U(1)

    def _number(self, point: np.ndarray, block: int) -> np.ndarray:
        """A hash of lattice points; it is additive, so a step to a neighbour only adds its own."""
        return ((2 * point).astype(np.int64).view(U) * self.salt[block]).sum(-1, dtype=U)

    def cells(self, v: np.ndarray) -> np.ndarray:
        """Numbers of the cells of each unit vector: for each table its own, then the neighbours'."""
        n, out = len(v), np.empty((len(v), self.tables, 1 + self.probes), U)
        steps = [self._number(_MINIMAL, b) for b in range(self.blocks)]
        for t in range(self.tables):
            x = v @ self.proj[t]
            home, gain = np.zeros(n, U), np.empty((n, self.blocks * 240))
            for b in range(self.blocks):
                part = x[:, 8 * b : 8 * b + 8]
                p = decode(part)
                home += self._number(p, b)
                gain[:, 240 * b : 240 * b + 240] = (part - p) @ _MINIMAL.T
            near = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes] if self.probes else np.zeros((n, 0), int)
            out[:, t, 0] = home
            out[:, t, 1:] = home[:, None] + np.concatenate(steps)[near]
            out[:, t] = mix(out[:, t], t + 1)
        return out.reshape(n, -1)


def plan(n: int, dim: int, similarity: float, recall: float) -> tuple[int, float, int, int]:
    """(tables, scale, probes, blocks) for n vectors.

    A block more makes cells rarer, so blocks grow with the logarithm of n and the vectors that meet by chance stay
    few. The chance that two vectors at ``similarity`` meet in a table is measured on made ones, and tables
    are added until a pair is missed in all of them with probability 1 - ``recall`` at most.
    """
    blocks = 1 + int(np.log(max(n, 1) / 3e5) / np.log(60) + 1) if n > 3e5 else 1
    scale, probes = (0.6, 3) if blocks == 1 else (0.5, 4 * blocks)
    r = np.random.default_rng(1)
    a, o = r.normal(size=(2, 3000, max(dim, 2)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    t = Tables(max(dim, 2), 1, blocks, scale, probes)
    x, y = t.cells(a), t.cells(similarity * a + np.sqrt(max(0.0, 1 - similarity**2)) * o)
    p = np.clip(((y[:, :1] == x).any(1) | (x[:, :1] == y).any(1)).mean(), 0.01, 0.99)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - p))), scale, probes, blocks


def _vectors(col: pa.Array) -> list[np.ndarray]:
    """Unit vectors in double precision, of vectors that have a direction."""
    out = []
    for x in col:
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        v = v / np.abs(v).max()
        out.append(v / np.linalg.norm(v))
    return out


def similar_vectors(df: DataFrame, similarity: float = 0.9, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id)`` for every row.

    Vectors link where their cosine, in double precision, is ``similarity`` or more. ``n_links`` counts the other
    vectors linked directly, ``component_id`` is the least id that links reach. Vectors that are null, zero, or
    hold a null or non-finite component, and vectors of unlike length, link with nothing. Vectors of any length are
    read whole. Rows that repeat an id and vector count once and each get the result; an id with several vectors gets the least
    component of them and the sum of their links; rows without id come back with a null component and no links.
    An empty table gives an empty one; further columns are not read, whatever their names. A pair that no group
    holds is missed with probability 1 - ``recall`` at most.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.size("v") > 0
    good &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = rows.filter("id is not null and v is not null").filter(good).withColumn("v", F.transform("v", lambda x: x + 0.0))
    with Scratch() as s:
        classes = clean.groupBy("v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("members"))
        # classes are numbered by least id, so that the least number of a component has its least id
        classes = s.adopt(ranks(classes, ["rep", "v"], "c"))
        reps = classes.select("c", "v")
        edges = _edges(s, reps, similarity, recall)
        weights = classes.select("c", F.size("v").cast("long").alias("weight"))
        cells = meetings(s, edges, weights, TILE, TILE_NUMBERS)
        met = cells.join(classes.select("c", "members", "v"), "c").select("cell", "c", "members", "tile", "inner", "v")

        def link(batches):
            for t in grouped(batches, 0):
                yield from _links(t, similarity)

        exact = s.table(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "a long, b long, weight long"))
        links = exact.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("weight").alias("linked"))
        comps = s.adopt(connected_components(exact.filter("b is not null"), "a", "b")).withColumnsRenamed({"vertex": "c", "component": "root"})
        out = classes.join(links, "c", "left").join(comps, "c", "left").withColumn("root", F.coalesce("root", "c"))
        out = out.join(classes.select(F.col("c").alias("root"), F.col("rep").alias("component_id")), "root")
        out = s.table(out.select("v", "members", "component_id", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
        per = lookup(clean.select("id", "v").distinct(), out, ["v"], "members", classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0])
        per = per.groupBy("id").agg(F.min("component_id").alias("component_id"), F.sum("n_links").alias("n_links"))
        known = rows.filter("id is not null").select("id").join(per, "id", "left")
        known = known.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        return s.result(known.union(rows.filter("id is null").select("id", F.lit(0).cast("long"), F.lit(None).cast("long"))))


def _edges(s: Scratch, reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """``(a, b, dense)``: pairs that meet in a cell and come near the similarity, or stars of groups of such."""
    sizes = s.table(reps.groupBy(F.size("v").alias("dim")).count())

    # each length of vectors has tables of its own, planned where a vector of that length first comes
    sized = reps.join(F.broadcast(sizes) if sizes.count() <= MANY else sizes, F.size("v") == F.col("dim")).select("c", "v", "count")

    def cells(batches):
        made: dict[int, Tables] = {}
        for b in batches:
            ids, n = b.column(0), b.column(2)
            vs = _vectors(b.column(1))
            for d in sorted({len(v) for v in vs}):
                at = np.array([i for i, v in enumerate(vs) if len(v) == d])
                if d not in made:
                    if len(made) >= 8:
                        made.clear()
                    tables, scale, probes, blocks = plan(n[int(at[0])].as_py(), d, similarity, recall)
                    made[d] = Tables(d, tables, blocks, scale, probes)
                for i in range(0, len(at), 512):
                    part = at[i : i + 512]
                    cell = made[d].cells(np.stack([vs[x] for x in part])) ^ mix(np.full(1, d, U))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cell).view(np.int64).ravel()), ids.take(pa.array(np.repeat(part, cell.shape[1])))], ["bucket", "c"])

    def codes(batches):
        """Vectors as bytes, for a first look only."""
        for b in batches:
            out = [np.rint(v / np.abs(v).max() * 127).astype(np.int8).tobytes() for v in _vectors(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["c", "code"])

    picked = s.table(sized.mapInArrow(cells, "bucket long, c long").distinct())
    size = picked.groupBy("bucket").agg(F.count("*").alias("count")).filter("count > 1").withColumn("weight", F.col("count"))
    full = lookup(picked, size, ["bucket"], "weight", picked.count()).join(reps.mapInArrow(codes, "c long, code binary"), "c")
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    full = full.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    whole = F.when(F.col("tiles") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other")))
    full = full.select(whole.alias("cell"), "c", "code").repartition("cell").sortWithinPartitions("cell")

    def look(batches):
        for t in grouped(batches, 0):
            yield from _look(t, similarity)

    return s.table(full.mapInArrow(look, "a long, b long, dense boolean").distinct())


def _look(t: pa.Table, similarity: float):
    """Pairs of a bucket whose byte vectors come near the similarity."""
    ids = t["c"].to_numpy()
    code = [np.frombuffer(x, np.int8) for x in t["code"].to_pylist()]
    a, b, dense = [], [], []
    for i, j in zip(*runs(t["cell"].to_numpy()), strict=True):
        if j - i < 2 or len({len(c) for c in code[i:j]}) > 1:
            continue  # a cell's vectors have one length; two lengths share a number by accident only
        m = np.stack(code[i:j]).astype(np.float32)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        x, y, d = pairs_and_groups(m @ m.T >= similarity - 0.03)
        a.append(ids[i + x])
        b.append(ids[i + y])
        dense.append(d)
    if a:
        a, b, dense = np.concatenate(a), np.concatenate(b), np.concatenate(dense)
        keep = a != b
        p = np.unique(np.stack([np.maximum(a, b)[keep], np.minimum(a, b)[keep], dense[keep]], 1), axis=0)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2].astype(bool))], ["a", "b", "dense"])


def _links(t: pa.Table, similarity: float):
    """Exact links of a cell's members."""
    a, b, w = [], [], []
    for i, j in zip(*runs(t["cell"].to_numpy()), strict=True):
        p = t.slice(i, j - i)
        ids, first = np.unique(p["c"].to_numpy(), return_index=True)
        p = p.take(pa.array(first))
        vs = _vectors(p["v"].combine_chunks())
        if len(ids) < 2 or len({len(v) for v in vs}) > 1:
            continue
        weight, tile, inner = p["members"].to_numpy(), p["tile"].to_numpy(), p["inner"].to_numpy(zero_copy_only=False)
        v = np.stack(vs)
        cos = v @ v.T
        ok = cos >= similarity
        near = np.argwhere(np.abs(cos - similarity) < 1e-12)
        raw = p["v"].to_numpy() if len(near) else None
        for x, y in near:  # the borderline by the plain formula
            q, r = np.asarray(raw[x], float), np.asarray(raw[y], float)
            ok[x, y] = q @ r / (np.sqrt(q @ q) * np.sqrt(r @ r)) >= similarity
        np.fill_diagonal(ok, False)
        if not inner[0]:
            ok &= tile[:, None] != tile
        links_of(ok, ids, weight, a, b, w)
    yield from linked_rows(a, b, w)
